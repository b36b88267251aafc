"""Where intermediate tables go, how many tasks a step should take, and joins on keys that many rows share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark deletes the shuffle files of a SQL execution at its end where this is set
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: a key is hot if it has over 1 / HOT of all rows, and over LEAST_HOT; so there are under HOT hot keys, however large the input
HOT, LEAST_HOT = 4096, 256
#: inputs below the first are not worth a shuffle, those above the second, for each core, have splits enough
LEAST_BYTES, MOST_BYTES = 4 << 20, 8 << 20

_open: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session, which is one machine, may go without a setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="heliograph-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs that are run within go when each is done."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    The new frame has no lineage before the files, so a lost executor costs no
    recomputation and a sampled or random step is evaluated once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _open:
        _open[-1].append((spark, path))
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``stored`` returned, once nothing will read them again."""
    for df in frames:
        delete(df.sparkSession, df._stored_at)


def release(spark: SparkSession) -> None:
    """What finished steps left in the driver goes: Spark drops the broadcasts and plans of frames that are gone when the driver's garbage is collected.

    For the ends of steps with wide plans; the driver's heap would else grow to its limit before it is collected.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end every table stored within, but for the frames given to the function that it yields.

    An operator returns a plan over its tables; so its caller, who knows when the result has been read, ends the scratch.
    """
    made: list[tuple[SparkSession, str]] = []
    spared: set[str] = set()

    def spare(df: DataFrame) -> DataFrame:
        spared.add(df._stored_at)
        return df

    _open.append(made)
    try:
        yield spare
    finally:
        _open.remove(made)
        for spark, path in made:
            if path not in spared:
                delete(spark, path)
            elif _open:
                _open[-1].append((spark, path))


def row_key(*columns: Column) -> Column:
    """128 bits that name the values of some columns: two hashes that begin unlike."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))


def spread_join(many: DataFrame, one: DataFrame, key: str, counts: DataFrame, by: Column, how: str = "inner") -> DataFrame:
    """many (also with a null key) joined with one, which has a row for each key; left or inner.

    counts has the key and ``n``, about how many rows of many have it.  Rows of
    a hot key are dealt into parts by a hash of ``by``, and the other side's row goes to each
    part, so a task's share does not grow with the number of rows that a key has.
    """
    spark = many.sparkSession
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).head()
    limit = max(total // HOT, LEAST_HOT)
    if most <= limit:
        return many.join(one, key, how)
    found = counts.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("parts")).collect()  # under HOT rows
    hot_key, parts, part = unused(many.join(one, key, how), "_hot", "_parts", "_part")
    hot = F.broadcast(spark.createDataFrame(found, counts.select(F.col(key).alias(hot_key), F.lit(1).alias(parts)).schema))
    dealt = many.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(by), F.col(parts)).cast("int"), F.lit(0))).drop(hot_key, parts)
    copied = one.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts) - 1, F.lit(0))))).drop(hot_key, parts)
    return dealt.join(copied, [key, part], how).drop(part)


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of df, from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df in as many parts as there are cores where it is small: a file of one row group is one task.  A large input has splits enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if LEAST_BYTES <= plan_bytes(df) <= MOST_BYTES * cores else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many marks behind it as it takes to differ from df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
