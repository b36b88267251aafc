"""Vector functions, labels and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.scalars import rounded, rounded_all
from ..operators import evaluate, labels
from ..schema import DIMENSIONS, Similarity
from ..sources.catalog import table
from . import sql as S
from .base import query

_PAIRS = "(SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.select("vec_id", F.col("embedding").alias("a")).join(nxt, "vec_id")


@query(f"SELECT vec_id, round({S.dot('a', 'b')}, 6) AS dot FROM {_PAIRS}")
def vector_dot(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", rounded(V.dot("a", "b"), 6).alias("dot"))


@query(f"SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt({S.norm2('embedding')}), 6)) AS v FROM embeddings")
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", rounded_all(V.normalized("embedding"), 6).alias("v"))


def _projection_sql(kind: Similarity) -> str:
    f = S.focused("embedding", kind)
    return f"SELECT vec_id, list_transform({f}, lambda x: round(x::DOUBLE / sqrt({S.norm2(f)}), 6)) AS v FROM embeddings"


def _projection(spark: SparkSession, d: str, kind: Similarity) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", rounded_all(V.projected("embedding", kind, DIMENSIONS), 6).alias("v"))


@query(_projection_sql(Similarity.SHAPE))
def project_shape(spark: SparkSession, d: str) -> DataFrame:
    return _projection(spark, d, Similarity.SHAPE)


@query(_projection_sql(Similarity.COLOR))
def project_color(spark: SparkSession, d: str) -> DataFrame:
    return _projection(spark, d, Similarity.COLOR)


def _focus_sql(kind: Similarity) -> str:
    a, b = S.focused("a", kind), S.focused("b", kind)
    return f"round({S.dot(a, b)} / sqrt({S.norm2(a)} * {S.norm2(b)}), 6)"


@query(f"SELECT vec_id, {_focus_sql(Similarity.SHAPE)} AS shape, {_focus_sql(Similarity.COLOR)} AS color FROM {_PAIRS}")
def appearance_similarity(spark: SparkSession, d: str) -> DataFrame:
    kinds = {k.value: rounded(V.focused_similarity("a", "b", k, DIMENSIONS), 6).alias(k.value) for k in (Similarity.SHAPE, Similarity.COLOR)}
    return _pairs(spark, d).select("vec_id", *kinds.values())


_BANK = f"""means AS (SELECT label::VARCHAR AS name, list_transform(range(1, {DIMENSIONS + 1}), lambda k: m[k]) AS m FROM (SELECT label, [{', '.join(f'avg(embedding[{k}]::DOUBLE)' for k in range(1, DIMENSIONS + 1))}] AS m FROM embeddings GROUP BY label)),
bank AS (SELECT name, list_transform(m, lambda x: x / sqrt({S.norm2('m')})) AS b FROM means)"""


@query(
    f"""WITH {_BANK}, s AS (SELECT e.vec_id, b.name, round({S.dot('e.embedding', 'b.b')}, 9) AS s FROM embeddings e, bank b),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, name) AS n, max(s) OVER (PARTITION BY vec_id) AS best FROM s)
    SELECT e.vec_id, coalesce(l.labels, '') AS labels FROM embeddings e LEFT JOIN (SELECT vec_id, string_agg(name, ', ' ORDER BY n) AS labels FROM r WHERE n <= {labels.MOST} AND s >= greatest({labels.LEAST}::DOUBLE, best - {labels.BEHIND}::DOUBLE) GROUP BY vec_id) l USING (vec_id)"""
)
def zero_shot_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    # one row a label: the bank is as long as the list of labels
    bank = sorted((r["name"], list(r["bank"])) for r in labels.mean_bank(e, "label", "embedding", DIMENSIONS).collect())
    return labels.zero_shot(e, bank)


_K = 5


@query(
    f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, a.label AS own, b.label AS family, round({S.dot('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM s),
    q AS (SELECT query, max(CASE WHEN n = 1 THEN (own = family)::INT END) AS first, sum((own = family)::INT)::DOUBLE / {_K} AS recall FROM r WHERE n <= {_K} GROUP BY query)
    SELECT round(avg(first), 6) AS precision_at_1, round(avg(recall), 6) AS recall_at_k, count(*) AS queries FROM q"""
)
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    nearest = evaluate.nearest_others(e, _K)
    out = evaluate.retrieval_quality(nearest, e.select(F.col("vec_id").alias("id"), F.col("label").alias("family")), _K)
    return out.select(rounded("precision_at_1", 6).alias("precision_at_1"), rounded("recall_at_k", 6).alias("recall_at_k"), "queries")
