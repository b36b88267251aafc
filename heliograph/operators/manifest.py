"""Release manifests: validation, choice of a package, and checks of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import newer, package_name, version

MOST_BYTES, MOST_PACKAGE = 64 << 10, 2 << 30
ASSET = T.StructType([T.StructField("name", T.StringType()), T.StructField("state", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("digest", T.StringType()), T.StructField("browser_download_url", T.StringType())])
MANIFEST = T.StructType([T.StructField("schema", T.IntegerType()), T.StructField("tag_name", T.StringType()), T.StructField("draft", T.BooleanType()), T.StructField("prerelease", T.BooleanType()), T.StructField("assets", T.ArrayType(ASSET))])


def choose(manifests: DataFrame, column: str, product: str, repository: str, target: str, current: str) -> DataFrame:
    """manifests with ``problem`` (null: none), ``update`` (name, sha256, url, size of the package) and ``is_newer``.

    A missing draft or prerelease is not false.  The asset of the wanted name
    must be the only one, uploaded, of a whole size up to MOST_PACKAGE, with a
    SHA-256 and the address that goes with its name.
    """
    m = F.from_json(F.col(column), MANIFEST)
    rows = manifests.withColumn("_m", m)
    release = F.substring("_m.tag_name", 2, 64)
    rows = rows.withColumn("_version", F.when(F.col("_m.tag_name").startswith("v"), release).otherwise(F.lit("")))
    rows = rows.withColumn("_name", package_name(product, F.col("_version"), F.lit(target)))
    well = (F.octet_length(column) <= MOST_BYTES) & (F.col("_m.schema") == 1) & (F.col("_m.draft") == F.lit(False)) & (F.col("_m.prerelease") == F.lit(False)) & F.col("_m.assets").isNotNull() & version("_version").isNotNull()
    rows = rows.withColumn("_own", F.filter("_m.assets", lambda a: a["name"] == F.col("_name")))
    url = F.concat(F.lit(f"https://github.com/{repository}/releases/download/"), F.col("_m.tag_name"), F.lit("/"), F.col("_name"))
    asset = F.get(F.col("_own"), F.lit(0))
    fits = (F.size("_own") == 1) & (asset["state"] == "uploaded") & asset["digest"].rlike("^sha256:[a-f0-9]{64}$") & (asset["size"] > 0) & (asset["size"] <= MOST_PACKAGE) & (asset["size"] == F.floor(asset["size"])) & (asset["browser_download_url"] == url)
    problem = F.when(~F.coalesce(well, F.lit(False)), "the manifest is not valid").when(F.size("_own") == 0, "the release has nothing for this platform").when(~F.coalesce(fits, F.lit(False)), "the package is not as it should be")
    rows = rows.withColumn("problem", problem)
    update = F.struct(F.col("_version").alias("version"), asset["name"].alias("name"), F.substring(asset["digest"], 8, 64).alias("sha256"), url.alias("url"), asset["size"].cast("long").alias("size"))
    rows = rows.withColumn("update", F.when(F.col("problem").isNull(), update))
    return rows.withColumn("is_newer", F.col("problem").isNull() & newer("_version", F.lit(current))).drop("_m", "_version", "_name", "_own")


def newest(spark: SparkSession, text: str, product: str, repository: str, target: str, current: str) -> Row | None:
    """The package that one manifest offers beyond the current version, None if it is not newer; ValueError with the problem otherwise."""
    row = choose(spark.createDataFrame([(text,)], "text string"), "text", product, repository, target, current).head()
    if row.problem:
        raise ValueError(row.problem)
    return row.update if row.is_newer else None


def differing(expected: DataFrame, remote: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Expected assets that are missing remotely or differ in any column."""
    theirs = remote.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_r_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return expected.join(theirs, F.col(key) == F.col("_k"), "left").filter(F.col("_k").isNull() | ~same).select(*expected.columns, F.col("_k").isNull().alias("missing"))


def checksums(files: DataFrame, name: str, content: str) -> DataFrame:
    """Lines 'sha256  name' of a checksum file."""
    return files.select(F.concat_ws("  ", F.sha2(F.col(content).cast("binary"), 256), F.col(name)).alias("line"))


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files (path, length, content) held against expected (path, size, sha256): path and ok."""
    want = expected.select("path", "size", "sha256")
    return files.join(want, "path").select("path", ((F.col("length") == F.col("size")) & (F.sha2("content", 256) == F.col("sha256"))).alias("ok"))
