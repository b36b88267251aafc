"""Incremental indexing: what a scan has to do, and what it did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ERRORS = 30


def classify(files: DataFrame, entries: DataFrame, force: bool = False, appearance_only: bool = False) -> DataFrame:
    """files (path, modified, bytes) with ``status`` and ``embed``.

    status: new, changed, stale_vector, stale_appearance, unchanged, and for a
    pass over descriptors alone unknown (no item yet) and skipped (changed file).
    """
    known = entries.select(F.col("path").alias("_path"), F.col("id").alias("item_id"), F.col("modified").alias("_m"), F.col("bytes").alias("_b"), "embedding_current", "appearance_current")
    rows = files.join(known, F.col("path") == F.col("_path"), "left")
    exists = F.col("item_id").isNotNull()
    same = exists & F.struct("modified", "bytes").eqNullSafe(F.struct(F.col("_m"), F.col("_b")))
    vector, look = F.coalesce("embedding_current", F.lit(False)), F.coalesce("appearance_current", F.lit(False))
    if appearance_only:
        status = F.when(~exists, "unknown").when(~same, "skipped").when(look, "unchanged").otherwise("stale_appearance")
        embed: Column = F.lit(False)
    else:
        status = F.when(~exists, "new").when(~same, "changed").when(F.lit(force) | ~vector, "stale_vector").when(~look, "stale_appearance").otherwise("unchanged")
        embed = F.lit(force) | ~same | ~vector
    return rows.select(*[F.col(c) for c in files.columns], "item_id", status.alias("status"), embed.alias("embed"))


def summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("embed").cast("long")).alias("to_embed"))


def jobs(classified: DataFrame) -> DataFrame:
    return classified.filter(~F.col("status").isin("unchanged", "unknown", "skipped"))


def split_errors(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(results that worked, the others): one bad image does not stop the rest."""
    return results.filter(F.col(error).isNull()), results.filter(F.col(error).isNotNull())


def error_log(errors: DataFrame, order: str, most: int = MOST_ERRORS) -> DataFrame:
    """The first errors, for a person to read."""
    return errors.orderBy(order).limit(most)


def report(rows: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
