"""A catalog over the star-schema test tables.

The same SQL text makes the view in Spark and in the SQL that checks it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import search_name
from ..operators.layout import exists, files, shared_folder
from ..operators.segments import Segments, built
from ..schema import Catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_NAME = """concat(coalesce(replace(p.p_name,' ','_'),'doc'), '_', cast(d.doc_id AS varchar(20)),
         CASE d.doc_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.PNG' ELSE '.webp' END)"""
ITEMS_SQL = f"""SELECT d.doc_id AS id, concat('/lib/', d.source, '/', {_NAME}) AS path, concat('/lib/', d.source) AS folder, {_NAME} AS name,
  concat('thumb:', cast(d.doc_id % 97 AS varchar(20))) AS thumb,
  cast(16 + (d.doc_id * 7) % 257 AS int) AS width, cast(16 + (d.doc_id * 5) % 131 AS int) AS height,
  d.n_chars AS bytes, cast(d.doc_id % 31 AS bigint) AS modified, d.doc_id % 5 = 0 AS favorite,
  CASE WHEN d.doc_id % 6 = 0 THEN coalesce(p.p_name,'') ELSE '' END AS tags, d.text AS ocr,
  CASE WHEN l.quality = 1 THEN concat('good ', coalesce(split_part(p.p_name,' ',2),'')) WHEN l.toxic = 1 THEN 'toxic note' ELSE '' END AS notes,
  CASE WHEN d.doc_id % 10 = 9 THEN NULL WHEN d.doc_id % 10 = 8 THEN 'foreign' WHEN d.doc_id % 10 = 7 THEN 'legacy-v1' WHEN d.doc_id % 10 = 6 THEN 'gpu-v3' ELSE 'cpu-v3' END AS model,
  CASE WHEN d.doc_id % 17 = 3 THEN NULL ELSE e.embedding END AS embedding
FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""
APPEARANCES_SQL = """SELECT i.id AS photo_id, i.modified + CASE WHEN i.id % 13 = 0 THEN 1 ELSE 0 END AS modified, i.bytes AS bytes,
  cast(CASE WHEN i.id % 11 = 0 THEN 0 ELSE 1 END AS int) AS version, e.embedding AS descriptor
FROM items i JOIN embeddings e ON e.vec_id = i.id WHERE i.id % 3 <> 0"""
#: thumbnails: a key for every document; items show the first 97 of them
THUMBNAILS_SQL = "SELECT concat('thumb:', cast(doc_id AS varchar(20))) AS key, encode(concat('preview ', cast(doc_id AS varchar(20)))) AS data FROM documents"
FOLDERS_SQL = "SELECT DISTINCT concat('/lib/', source) AS path FROM documents"

_indexes: dict[tuple[str, str], Segments] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """SQL over the named frames, and over the test tables that it mentions."""
    import re

    needed = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    args = needed | frames
    for name in args:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, **args)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items, with ``search_name`` derived as a save would."""
    rows = run_sql(spark, sf_dir, ITEMS_SQL)
    names = rows.columns
    return rows.withColumn("search_name", search_name("name")).select(*names[:4], "search_name", *names[4:])


def indexed(spark: SparkSession, sf_dir: str) -> Segments:
    """The full-text index of the items, which lies in the session's shared folder: made where the session has none of the tables' present files.

    The first who asks pays for it, as a scan would when it saves; later queries read the postings of their terms.
    """
    used = [files(spark, f"{sf_dir}/{name}.parquet") for name in ("documents", "part", "labels")]
    key = (spark.sparkContext.applicationId, hashlib.sha256(repr(used).encode()).hexdigest())
    if key not in _indexes or not all(exists(spark, f"{folder}/totals/_SUCCESS") for folder in _indexes[key].folders):
        _indexes[key] = built(spark, f"{shared_folder(spark)}/text-index", items(spark, sf_dir).drop("embedding"))
    return _indexes[key]


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, APPEARANCES_SQL, items=run_sql(spark, sf_dir, ITEMS_SQL))


def thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, THUMBNAILS_SQL.replace("20)))) AS data", "20))), 'UTF-8') AS data"))


def catalog(spark: SparkSession, sf_dir: str, index: bool = False, whole: bool = True) -> Catalog:
    """The tables; index: with the full-text index, else texts are searched by a scan; whole: with more than the items."""
    rows, own = items(spark, sf_dir), indexed(spark, sf_dir).index() if index else None
    return Catalog(rows, appearances(spark, sf_dir), thumbnails(spark, sf_dir), run_sql(spark, sf_dir, FOLDERS_SQL), own) if whole else Catalog(rows, index=own)
