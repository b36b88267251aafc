"""A folder watched as a stream: new files are classified, decoded and saved batch by batch; listings of it tell of removals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.files import FILE_SCHEMA, described, supported

RESCAN_SECONDS = 60
#: parts of a folder's paths that keep their own listing, so that no task holds a whole folder
BUCKETS = 64
LISTING = T.StructType([*[T.StructField(n, T.StringType()) for n in ("folder", "path")], *[T.StructField(n, T.LongType()) for n in ("modified", "bytes", "listing")], T.StructField("bucket", T.IntegerType())])
CHANGE = T.StructType([T.StructField("listing", T.LongType()), T.StructField("path", T.StringType()), T.StructField("change", T.StringType())])


def watched(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The files that appear below a folder, with path, name, fingerprint and content."""
    raw = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return described(supported(raw), folder)


def indexed(files: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``save`` on each batch.

    A batch that was cut short is given again with the same number, so ``save``
    must be a replacement (an upsert by path), not an addition.
    """
    writer = files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{RESCAN_SECONDS} seconds")).start()


def batch_errors(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNotNull())


def listed(found: DataFrame, folder: str, listing: int) -> DataFrame:
    """The rows of one listing of a folder, from its files (path, modified, bytes): what ``differences`` reads.

    Each bucket of paths gets a row without a path, so that it hears of a listing that has none of its files any more.
    """
    columns = [F.lit(folder).alias("folder"), "path", F.col("modified").cast("long").alias("modified"), F.col("bytes").cast("long").alias("bytes"), F.lit(listing).cast("long").alias("listing")]
    rows = found.select(*columns, F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    nothing = found.sparkSession.range(BUCKETS).select(F.lit(folder).alias("folder"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("modified"), F.lit(None).cast("long").alias("bytes"), F.lit(listing).cast("long").alias("listing"), F.col("id").cast("int").alias("bucket"))
    return rows.unionByName(nothing)


class _Differences(StatefulProcessor):
    """The last listing of a bucket of a folder's paths; a newer one is held against it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "path string", "modified long, bytes long")
        self.last = handle.getValueState("last", "listing long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for listing, own in pd.concat(list(rows)).groupby("listing"):  # in the order of listings
            if self.last.exists() and listing <= self.last.get()[0]:
                continue  # a listing that came late tells nothing new
            now = {r.path: (int(r.modified), int(r.bytes)) for r in own.dropna(subset=["path"]).itertuples()}
            gone = [path for (path,) in self.known.keys() if path not in now]
            for path in gone:
                self.known.removeKey((path,))
            out += [(listing, path, "removed") for path in gone]
            for path, print_ in now.items():
                before = self.known.getValue((path,)) if self.known.containsKey((path,)) else None
                if before != print_:
                    self.known.updateValue((path,), print_)
                    out.append((listing, path, "added" if before is None else "changed"))
            self.last.update((int(listing),))
        yield pd.DataFrame(out, columns=["listing", "path", "change"])

    def close(self) -> None:
        pass


def differences(listings: DataFrame) -> DataFrame:
    """listing, path and change (added, changed or removed) from a stream of ``listed`` rows, each listing against the one before.

    A renamed file is one that is removed and one that is added.
    """
    return listings.groupBy("folder", "bucket").transformWithStateInPandas(_Differences(), CHANGE, "append", "none")
