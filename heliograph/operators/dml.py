"""Changes to a catalog, each a pure function from old tables to new ones.

Parquet has no row updates, so a writer computes the new table and swaps it in:
the files go to a folder of their own, and a small file names the folder that is
current (``versions``; ``publish`` for a table on its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import NOTES_LIMIT
from .versions import Versions

#: what a save leaves as it was
KEPT = ("id", "favorite", "notes")


def upsert(old: DataFrame, new: DataFrame, key: str = "path", kept: tuple[str, ...] = KEPT) -> DataFrame:
    """old with the rows of new by key; an existing row keeps its id, favorite and notes.

    New keys get the ids that new carries, or null where it has none.  The
    shuffle is on the key alone, once on each side.
    """
    columns = old.columns
    theirs = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(theirs, F.col(key) == F.col(f"_n_{key}"), "full")
    out = []
    for c in columns:
        mine, yours = F.col(c), F.col(f"_n_{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        if c in kept:
            out.append(F.when(F.col("_old"), mine).otherwise(yours).alias(c))
        else:
            out.append((F.when(F.col("_new"), yours).otherwise(mine) if c in new.columns else mine).alias(c))
    return both.select(*out)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and the rows of new whose key it lacks (one for each key)."""
    fresh = new.join(old.select(key), key, "left_anti").dropDuplicates([key])
    return old.unionByName(fresh.select(*old.columns))


def guarded_replace(appearances: DataFrame, items: DataFrame, offered: DataFrame) -> DataFrame:
    """appearances with the offered ones (path, modified, bytes, version, descriptor) that still fit their item's file."""
    current = items.select(F.col("id").alias("photo_id"), "path", "modified", "bytes")
    good = offered.join(current, ["path", "modified", "bytes"]).select("photo_id", "modified", "bytes", "version", "descriptor")
    return appearances.join(good.select("photo_id"), "photo_id", "left_anti").unionByName(good.select(*appearances.columns))


def remove_folder(items: DataFrame, appearances: DataFrame, thumbnails: DataFrame, folders: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without a folder, its items, their descriptors, and thumbnails that nothing shows any more."""
    left = items.filter(F.col("folder") != folder)
    return left, cascade(appearances, left), prune_thumbnails(thumbnails, left), folders.filter(F.col("path") != folder)


def cascade(appearances: DataFrame, items: DataFrame) -> DataFrame:
    return appearances.join(items.select(F.col("id").alias("photo_id")), "photo_id", "left_semi")


def prune_unseen(items: DataFrame, seen: DataFrame, reachable: DataFrame) -> DataFrame:
    """items without those of reachable folders (folder) that were not seen (folder, path)."""
    gone = items.join(reachable, "folder", "left_semi").join(seen, ["folder", "path"], "left_anti").select("id")
    return items.join(gone, "id", "left_anti")


def prune_thumbnails(thumbnails: DataFrame, items: DataFrame) -> DataFrame:
    return thumbnails.join(items.select(F.col("thumb").alias("key")), "key", "left_semi")


def orphan_thumbnails(thumbnails: DataFrame, items: DataFrame) -> DataFrame:
    return thumbnails.join(items.select(F.col("thumb").alias("key")), "key", "left_anti")


def set_notes(items: DataFrame, ids: Column, notes: Column) -> DataFrame:
    return items.withColumn("notes", F.when(ids, F.substring(notes, 1, NOTES_LIMIT)).otherwise(F.col("notes")))


def set_favorite(items: DataFrame, ids: Column, favorite: Column) -> DataFrame:
    return items.withColumn("favorite", F.when(ids, favorite).otherwise(F.col("favorite")))


def first_root_wins(files: DataFrame, ordinal: str = "ordinal", path: str = "path") -> DataFrame:
    """Of files found below several roots, the one of the first root."""
    order = Window.partitionBy(path).orderBy(ordinal)
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def content_addressed(rows: DataFrame, data: str) -> DataFrame:
    """key (SHA-256) and data, each content once."""
    return rows.select(F.sha2(F.col(data).cast("binary"), 256).alias("key"), F.col(data).alias("data")).dropDuplicates(["key"])


def shared_results(rows: DataFrame, hash_column: str, known: DataFrame, result: str) -> DataFrame:
    """rows with ``result`` from known (hash, result), and ``reused``: whether it came from there or from an earlier row alike."""
    order = Window.partitionBy(hash_column).orderBy("id")
    out = rows.withColumn("_first", F.row_number().over(order) == 1).join(known, hash_column, "left")
    return out.withColumn("reused", F.col(result).isNotNull() | ~F.col("_first")).drop("_first")


def publish(df: DataFrame, root: str) -> str:
    """Write a new version of a table below root and make it current; returns its folder."""
    versions = Versions(df.sparkSession, root)
    folder, _ = versions.stage("table", df)
    versions.commit({"table": folder})
    return f"{root}/{folder}"


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a published table."""
    return Versions(spark, root).table("table")
