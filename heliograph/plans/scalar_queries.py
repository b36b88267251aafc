"""Scalar functions, JSON, and event-time operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text, vectors
from ..sources import catalog as C
from ..sources.catalog import run_sql, table
from ..streaming import events
from . import sql as S
from .base import query


@query("SELECT doc_id, substr(text, 1, 700) AS short FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 700).alias("short"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def simplify_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.simplified("text").alias("text"))


@query(f"{S.views('items')} SELECT id, regexp_extract(name, '\\.([^.]*)$', 1) AS suffix, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM items")
def stem_suffix(spark: SparkSession, d: str) -> DataFrame:
    return C.items(spark, d).select("id", text.suffix("name").alias("suffix"), text.stem("name").alias("stem"))


@query("SELECT page_id, sha256(encode(html)) AS digest FROM pages")
def sha256_hex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


_SIZES = "SELECT o_orderkey, cast(o_orderkey AS bigint) * (o_custkey + 13) * 7919 + 333 AS n FROM orders"


@query(
    f"""SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN 'GB' WHEN n >= 1048576 THEN 'MB' ELSE 'KB' END AS unit, round(n / CASE WHEN n >= 1073741824 THEN 1073741824.0::DOUBLE WHEN n >= 1048576 THEN 1048576.0::DOUBLE ELSE 1024.0::DOUBLE END, 1) AS amount FROM ({_SIZES})"""
)
def format_file_size(spark: SparkSession, d: str) -> DataFrame:
    """The unit and number that are shown; the text is put together by ``scalars.file_size``."""
    n = (F.col("o_orderkey") * (F.col("o_custkey") + 13) * 7919 + 333).alias("n")
    rows = table(spark, d, "orders").select("o_orderkey", n).withColumn("shown", scalars.file_size("n"))
    scale = F.when(F.col("n") >= 1 << 30, F.lit(float(1 << 30))).when(F.col("n") >= 1 << 20, F.lit(float(1 << 20))).otherwise(F.lit(1024.0))
    return rows.select("o_orderkey", F.substring_index("shown", " ", -1).alias("unit"), scalars.rounded(F.col("n") / scale, 1).alias("amount"))


@query("SELECT event_id, strftime(ts, '%b %-d, %Y') AS shown FROM events")
def format_modified(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalars.modified_text(F.unix_millis(F.col("ts").cast("timestamp"))).alias("shown"))


_LAST = "lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, {_LAST} IS NULL OR epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', {_LAST}))::BIGINT >= 86400 AS due FROM events")
def daily_due(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").withColumn("last", last)
    return rows.select("event_id", scalars.due_daily("last", "ts").alias("due"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 97 - o_orderkey % 13 > 0 THEN greatest(1, floor((floor((o_custkey * 1000) * (500 - o_orderkey % 97)::DOUBLE / (o_orderkey % 97 - o_orderkey % 13) / 1000) + 59) / 60))::BIGINT END AS minutes FROM orders"""
)
def eta_minutes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    key = F.col("o_orderkey")
    return rows.select("o_orderkey", scalars.eta_minutes(F.col("o_custkey") * 1000, key % 97, F.lit(500), key % 13).alias("minutes"))


@query(
    """SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS root, round(atan2(l_tax - 0.04, l_discount - 0.05), 6) AS angle, floor(l_quantity / 7)::BIGINT AS part, l_orderkey % 7 AS rest, least(greatest(l_quantity, 10), 40) AS held, round(l_extendedprice, 1) AS rounded FROM lineitem"""
)
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scalars.rounded(F.sqrt("l_extendedprice"), 6).alias("root"),
        scalars.rounded(F.atan2(c("l_tax") - 0.04, c("l_discount") - 0.05), 6).alias("angle"),
        F.floor(c("l_quantity") / 7).alias("part"),
        (c("l_orderkey") % 7).alias("rest"),
        scalars.clamp("l_quantity", 10.0, 40.0).alias("held"),
        scalars.rounded("l_extendedprice", 1).alias("rounded"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN t < 1 THEN ((1.5::DOUBLE * t - 2.5::DOUBLE) * t) * t + 1 WHEN t < 2 THEN (((-0.5::DOUBLE * t + 2.5::DOUBLE) * t) - 4) * t + 2 ELSE 0 END, 6) AS w FROM (SELECT l_orderkey, l_linenumber, abs(l_discount * 50 - 2.5::DOUBLE) AS t FROM lineitem)"""
)
def cubic_kernel(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalars.rounded(scalars.cubic_weight(F.col("l_discount") * 50 - 2.5), 6).alias("w"))


_VERSIONS = "SELECT p_partkey, concat(p_size % 4, '.', p_partkey % 12, '.', p_partkey % 101, CASE WHEN p_partkey % 19 = 0 THEN '-beta' ELSE '' END) AS v FROM part"
_STRICT = r"'^(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})$'"


@query(
    f"""SELECT p_partkey, v, CASE WHEN regexp_matches(v, {_STRICT}) THEN list_transform(string_split(v, '.'), lambda x: x::INT) > [1, 10, 0] END AS newer FROM ({_VERSIONS})"""
)
def semver_compare(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.catalog import run_sql

    return run_sql(spark, d, _VERSIONS).select("p_partkey", "v", scalars.newer("v", F.lit("1.10.0")).alias("newer"))


_TARGETS = "SELECT p_partkey, concat(p_size % 4, '.', p_partkey % 12, '.1') AS v, CASE p_partkey % 5 WHEN 0 THEN 'linux-x64' WHEN 1 THEN 'linux-x64-deb' WHEN 2 THEN 'linux-arm64-arch' WHEN 3 THEN 'windows-x64' ELSE 'macos-arm64' END AS t FROM part"


@query(
    f"""SELECT p_partkey, CASE WHEN t LIKE '%-deb' THEN concat('Heliograph-', v, '-', left(t, length(t) - 4), '.deb') WHEN t LIKE '%-arch' THEN concat('Heliograph-', v, '-', left(t, length(t) - 5), '.pkg.tar.zst')
    WHEN t LIKE 'windows-%' THEN concat('Heliograph-', v, '-Setup-', split_part(t, '-', 2), '.exe') WHEN t LIKE 'macos-%' THEN concat('Heliograph-', v, '-', t, '.dmg') ELSE concat('Heliograph-', v, '-', t, '.tar.gz') END AS package FROM ({_TARGETS})"""
)
def package_names(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.catalog import run_sql

    return run_sql(spark, d, _TARGETS).select("p_partkey", scalars.package_name("Heliograph", "v", "t").alias("package"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, json_extract_string(props, '$.missing') IS NULL AS absent FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "k long, missing string")
    return table(spark, d, "events").select("event_id", props["k"].alias("k"), props["missing"].isNull().alias("absent"))


@query("SELECT user_id, max(event_id) AS generation, max_by(event_type, event_id) AS value FROM events GROUP BY user_id")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return events.latest_wins(table(spark, d, "events"), "user_id", F.col("event_id"), F.col("event_type"))


@query(
    """WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM o)
    SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n, max_by(event_type, ts) AS value FROM g GROUP BY user_id, burst"""
)
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events.debounced(table(spark, d, "events"), "user_id", "ts", "1 hour", F.col("event_type"))


# text, vectors and files through the functions that the engine uses them with

_DECOMPOSED = "SELECT doc_id, replace(replace(replace(replace(text, 'é', concat('e', chr(769))), 'ü', concat('u', chr(776))), 'ä', concat('a', chr(776))), 'ñ', concat('n', chr(771))) AS t FROM documents"


@query(f"SELECT doc_id, nfc_normalize(t) AS composed FROM ({_DECOMPOSED})")
def nfc_names(spark: SparkSession, d: str) -> DataFrame:
    # a mark is named by its letter: chr() of SQL ends at 255
    sql = _DECOMPOSED
    for code in (769, 771, 776):
        sql = sql.replace(f"chr({code})", f"'{chr(code)}'")
    return run_sql(spark, d, sql).select("doc_id", text.composed("t").alias("composed"))


@query("SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def fold_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.fold("text").alias("folded"))


@query("SELECT vec_id, octet_length(encode('')) + 4 * len(embedding) AS n_bytes, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v, true AS whole FROM embeddings")
def blob_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("blob", vectors.pack("embedding"))
    back = vectors.unpack("blob")
    return rows.select("vec_id", F.octet_length("blob").alias("n_bytes"), scalars.rounded_all(back, 6).alias("v"), vectors.finite("embedding").alias("whole"))


_MANIFESTS = """SELECT p_partkey, concat('{"schema":', CASE p_partkey % 9 WHEN 1 THEN '2' ELSE '1' END, ',"tag_name":"', CASE p_partkey % 9 WHEN 2 THEN '' ELSE 'v' END, p_size, '.', p_partkey % 7, '.0",',
    CASE p_partkey % 9 WHEN 3 THEN '' ELSE '"draft":false,' END, '"prerelease":', CASE p_partkey % 9 WHEN 4 THEN 'true' ELSE 'false' END, ',"assets":[{"name":"App-', p_size, '.', p_partkey % 7, '.0-linux-',
    CASE p_partkey % 9 WHEN 5 THEN 'arm' ELSE 'x64' END, '.tar.gz","state":"', CASE p_partkey % 9 WHEN 6 THEN 'new' ELSE 'uploaded' END, '","size":', p_partkey + 1, CASE p_partkey % 9 WHEN 7 THEN '.5' ELSE '' END,
    ',"digest":"sha256:', repeat('ab', 32), '","browser_download_url":"https://github.com/o/r/releases/download/v', p_size, '.', p_partkey % 7, '.0/App-', p_size, '.', p_partkey % 7, '.0-linux-x64.tar.gz"}]}') AS manifest, p_size FROM part"""


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 9 IN (1, 2, 3, 4) THEN 'the manifest is not valid' WHEN p_partkey % 9 = 5 THEN 'the release has nothing for this platform' WHEN p_partkey % 9 IN (6, 7) THEN 'the package is not as it should be' END AS problem,
    CASE WHEN p_partkey % 9 IN (0, 8) THEN p_partkey + 1 END AS size, p_partkey % 9 IN (0, 8) AND [p_size, p_partkey % 7, 0] > [25, 3, 0] AS is_newer FROM ({_MANIFESTS})"""
)
def manifest_choice(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.manifest import choose

    sql = _MANIFESTS.replace("{", "{{").replace("}", "}}")  # braces are marks of the formatter
    rows = choose(run_sql(spark, d, sql), "manifest", "App", "o/r", "linux-x64", "25.3.0")
    return rows.select("p_partkey", "problem", F.col("update.size").alias("size"), "is_newer")


@query("SELECT concat('/d/', doc_id) AS path, doc_id % 7 NOT IN (2, 5) AS ok FROM documents WHERE text IS NOT NULL")
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    """Size and whole content of files against what is expected; some are expected otherwise."""
    from ..operators.manifest import verified

    rows = table(spark, d, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("/d/"), "doc_id").alias("path"), "doc_id", F.col("text").cast("binary").alias("content"))
    files = rows.select("path", F.octet_length("content").cast("long").alias("length"), "content")
    size = F.octet_length("content").cast("long") + (F.col("doc_id") % 7 == 2).cast("long")
    wanted = F.sha2(F.when(F.col("doc_id") % 7 == 5, F.lit(b"?")).otherwise(F.col("content")), 256)
    return verified(files, rows.select("path", size.alias("size"), wanted.alias("sha256")))


@query(f"WITH items AS ({C.ITEMS_SQL}), t AS ({C.THUMBNAILS_SQL}) SELECT id, t.key, decode(t.data) AS preview FROM items LEFT JOIN t ON t.key = items.thumb AND items.thumb LIKE 'thumb:%'")
def thumbnail_fetch(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.files import thumbnails_of

    rows = thumbnails_of(C.items(spark, d), C.thumbnails(spark, d))
    return rows.select("id", "key", F.col("data").cast("string").alias("preview"))


@query("SELECT event_id, greatest(least(value, 50.0::DOUBLE), 10.0::DOUBLE) AS clamped FROM events")
def clamped_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", scalars.clamp("value", 10.0, 50.0).alias("clamped"))
