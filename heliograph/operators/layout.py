"""How rows lie in tasks."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: inputs below the first are not worth a shuffle; above the second, for each core, a table has as many splits as there is work
LEAST_BYTES, MOST_BYTES = 4 << 20, 64 << 20
#: bytes of input behind one part of a table that is dealt out; from the second on a size is not known
PART_BYTES, UNKNOWN_BYTES = 8 << 20, 1 << 60


def shared_folder(spark: SparkSession) -> str:
    """Where tables go that a session makes for itself: the folder that driver and executors share.  Only a local session may go without the setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="heliograph-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts within have a tag, by which another thread may cancel them."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, bytes and time of change of the files of a table: what tells one version of it from another."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listing = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while listing.hasNext():
        f = listing.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a frame reads, as the optimiser knows them (a table of unknown size counts as huge)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def dealt(df: DataFrame, key: str, held: bool = False) -> DataFrame:
    """df, in as many parts as there are cores where its input is small: a file of one row group is read by one task, and so would be worked on by one.

    Parts are of PART_BYTES of input at most, so there are more where the input is larger.  A large input has splits
    enough and is left as it is, but where its rows are held in another form than they are read (held), of which a split may be too much.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, input_bytes(df)
    if size < LEAST_BYTES or size >= UNKNOWN_BYTES or size > MOST_BYTES * cores and not held:
        return df
    return df.repartition(max(cores, -(-size // PART_BYTES)), key)
