"""Files: image folders, vocabularies, manifests, settings and a synthetic source."""

from __future__ import annotations

import configparser
import json
import os
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import orientation

FILE_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
#: formats that Spark's image source decodes
FORMATS = ("png", "jpg", "jpeg", "gif", "bmp")
#: EXIF is the first segment of a JPEG file, or follows one or two others; a segment has at most 65537 bytes
EXIF_WITHIN = 2 + 3 * 65537


def supported(files: DataFrame, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Files whose suffix, in any case, is a known format."""
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*formats))


def described(files: DataFrame, folder: str) -> DataFrame:
    """path, folder, name, modified (epoch milliseconds), bytes, content."""
    return files.select("path", F.lit(folder).alias("folder"), F.substring_index("path", "/", -1).alias("name"), F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def canonical(spark: SparkSession, folder: str) -> str:
    """One spelling of a folder: with its scheme, without relative steps, symbolic links (where the file system resolves them) or a slash at the end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = fs.makeQualified(at)
    if at.toUri().getScheme() == "file":
        return "file:" + os.path.realpath(at.toUri().getPath())
    return (fs.resolvePath(at) if fs.exists(at) else at).toString()


def scan(spark: SparkSession, folders: list[str], with_content: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """(files, reachable folders, errors): folders that can't be read are reported, and are not reachable.

    Folders are taken in order, each in its canonical spelling; a file below two of them belongs to the first.
    """
    reachable, errors, out = [], [], None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for k, folder in enumerate(dict.fromkeys(canonical(spark, f) for f in folders)):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
            errors.append(f"{folder} cannot be read; what is known of it stays")
            continue
        reachable.append(folder)
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        if not with_content:
            rows = rows.drop("content").withColumn("content", F.lit(None).cast("binary"))
        rows = described(supported(rows), folder).withColumn("ordinal", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], "path string, folder string, name string, modified long, bytes long, content binary, ordinal int")
    return out, reachable, errors


def turns(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """path and turn (2 to 8) of the JPEG files below a folder, or among files, that are stored turned or mirrored."""

    @F.arrow_udf("int")
    def stated(heads: pa.Array) -> pa.Array:
        return pa.array([orientation(h.as_py()) for h in heads], pa.int32())

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(where)
    return rows.select("path", stated(F.substring("content", 1, EXIF_WITHIN)).alias("turn")).filter("turn > 1")


def images(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """path, width, height, channels, data (BGR or BGRA rows as stored), turn and error of the images below a folder, or of files.

    Spark's decoder reads PNG, JPEG, GIF and BMP, not WebP or SVG.  Width and
    height are those of the image as it is shown; ``turn`` is the EXIF orientation of a JPEG (1: as stored),
    which ``pixels`` follows.  For files that the caller names, a list on the driver, what is turned goes to every
    task; for a folder, Spark chooses the join.
    """
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(where).select("image.*")
    bad = F.col("width") < 1
    path = F.regexp_replace("origin", "^file:/+", "file:/")  # as the binaryFile source writes it
    turned = turns(spark, where)
    if isinstance(where, list):
        turned = F.broadcast(turned)
    rows = rows.withColumn("path", path).join(turned, "path", "left")
    turn, lying = F.coalesce("turn", F.lit(1)), F.coalesce(F.col("turn") > 4, F.lit(False))
    width, height = F.when(lying, F.col("height")).otherwise(F.col("width")), F.when(lying, F.col("width")).otherwise(F.col("height"))
    return rows.select("path", width.alias("width"), height.alias("height"), F.col("nChannels").alias("channels"), "data", turn.alias("turn"), F.when(bad, F.lit("could not be decoded")).alias("error"))


def thumbnails_of(items: DataFrame, thumbnails: DataFrame, prefix: str = "thumb:") -> DataFrame:
    """id and data: the stored preview where the item names one, else null (its file is to be read)."""
    keyed = F.when(F.col("thumb").startswith(prefix), F.col("thumb"))
    return items.select("id", keyed.alias("key")).join(thumbnails, "key", "left").select("id", "key", "data")


def vocabulary(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """(token ids, merges) of a JSON file with model.vocab and model.merges; a merge is a pair or 'a b'."""
    model = json.loads(Path(path).read_text("utf-8"))["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    return model["vocab"], merges


def manifest_text(path: str, most: int = 64 << 10) -> str:
    if os.path.getsize(path) > most:
        raise ValueError("the manifest is too long")
    return Path(path).read_text("utf-8")


def read_settings(path: str) -> dict[str, str]:
    parser = configparser.ConfigParser()
    parser.read(path)
    return {f"{s}/{k}" if s != "General" else k: v for s in parser.sections() for k, v in parser[s].items()}


def write_settings(path: str, values: dict[str, str]) -> None:
    parser = configparser.ConfigParser()
    for key, value in values.items():
        section, _, name = key.rpartition("/")
        section = section or "General"
        if not parser.has_section(section):
            parser.add_section(section)
        parser[section][name] = value
    with open(path, "w") as f:
        parser.write(f)


def synthetic_vectors(spark: SparkSession, n: int = 40_000, dimensions: int = 512, seed: int = 42) -> DataFrame:
    """vec_id and embedding: vectors of uniform numbers in [-1, 1) at length 1, the same on every run."""
    from ..functions.vectors import normalized

    uniform = lambda k: F.pmod(F.xxhash64("vec_id", k, F.lit(seed)), F.lit(1 << 53)) / float(1 << 52) - 1.0
    rows = spark.range(n).withColumnRenamed("id", "vec_id").withColumn("raw", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), uniform))
    return rows.select("vec_id", F.transform(normalized("raw"), lambda x: x.cast("float")).alias("embedding"))
