"""Pages of an ordered result: its rows stored in order once, with a directory of how many are in each file.

A page then reads the files that it lies in, usually one, wherever in the order it
is: page 1000 costs what page 2 does, and nothing is kept in memory between them.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import delete, shared_folder


@dataclass(frozen=True)
class Directory:
    """files: (path, number of rows before it, number of its first row in the stored numbering), in order."""

    rows: DataFrame
    folder: str
    files: tuple[tuple[str, int, int], ...]
    total: int

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset + limit, in order."""
        stop = min(max(0, offset) + max(0, limit), self.total)
        start = max(0, offset)
        if start >= stop:
            return self.rows.limit(0).drop("_at")
        before = [n for _, n, _ in self.files]
        first, last = bisect_right(before, start) - 1, bisect_right(before, stop - 1) - 1
        place = lambda k, row: F.lit(self.files[k][2] + row - before[k]).cast("long")
        rows = self.rows.sparkSession.read.schema(self.rows.schema).parquet(*[path for path, _, _ in self.files[first : last + 1]])
        return rows.filter(F.col("_at").between(place(first, start), place(last, stop - 1))).orderBy("_at").drop("_at")

    def forget(self) -> None:
        delete(self.rows.sparkSession, self.folder)


def stored(rows: DataFrame, by: list[Column]) -> Directory:
    """The rows in the order of some columns, which must tell them apart, in the session's shared folder."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    # numbers grow from part to part and have no gap within one
    rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    back = spark.read.schema(rows.withColumn("_at", F.lit(0).cast("long")).schema).parquet(folder)
    found = back.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("at")).orderBy("at").collect()  # a row a file
    files, total = [], 0
    for r in found:
        files.append((r["path"], total, r["at"]))
        total += r["n"]
    return Directory(back, folder, tuple(files), total)


def digests(directory: Directory, values: list[str], size: int, cut: int | None = None) -> DataFrame:
    """page, n and digest of each page of an ordered result: SHA-256 over its rows' own digests, in order.

    cut: a number of rows at which the page that holds it is parted; the first part keeps the page's number, the second is left out.
    """
    spark = directory.rows.sparkSession
    files = F.broadcast(spark.createDataFrame(list(directory.files), "path string, before long, first long"))  # a row a file
    text = [F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values]
    own = F.sha2(F.concat(*[x for t in text for x in (F.octet_length(t).cast("string"), F.lit(":"), t)]).cast("binary"), 256)
    rows = directory.rows.select(F.col("_metadata.file_path").alias("path"), "_at", own.alias("own")).join(files, "path")
    rows = rows.select((F.col("before") + F.col("_at") - F.col("first")).alias("pos"), "own")
    rows = rows if cut is None else rows.filter(F.col("pos") < cut)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"])
    return rows.groupBy(F.floor(F.col("pos") / size).alias("page")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(entries, "").cast("binary"), 256).alias("digest"))


def continuation(shown: Directory, now: Directory, values: list[str], size: int) -> DataFrame:
    """One row that says how a view of the shown result goes on: action, same_pages, n_shown, n_now.

    ``append`` where all that is shown is a prefix of the present result, so that only rows behind it are added; else ``reset``, and
    same_pages leading pages need not be drawn again.
    """
    a = digests(shown, values, size).select("page", F.col("digest").alias("a"))
    b = digests(now, values, size, shown.total).select("page", F.col("digest").alias("b"))
    pages = -(-shown.total // size)
    first = F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("page")))
    unlike = a.join(b, "page", "left").agg(first.alias("first"))
    return unlike.select(
        F.when(F.col("first").isNull(), F.lit("append")).otherwise(F.lit("reset")).alias("action"),
        F.coalesce("first", F.lit(pages)).cast("long").alias("same_pages"),
        F.lit(shown.total).cast("long").alias("n_shown"),
        F.lit(now.total).cast("long").alias("n_now"),
    )
