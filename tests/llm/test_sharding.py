import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heliograph.llm import sharding as sh


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 997, 1000, 4096, 10_007])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sh.permute(F.col("id"), n, seed=3)).collect()]
    assert sorted(got) == list(range(n))


def test_permutation_mixes_and_follows_the_seed(spark):
    a, b, c = ([r[0] for r in spark.range(1000).orderBy("id").select(sh.permute(F.col("id"), 1000, s)).collect()] for s in (1, 1, 2))
    assert a == b != c
    assert sum(abs(x - i) < 20 for i, x in enumerate(a)) < 100


def check(rows, n_rows, n_shards):
    assert len(rows) == n_rows
    by = Counter(r.shard for r in rows)
    sizes = [by.get(k, 0) for k in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1
    for k in range(n_shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


def test_every_row_once(nasty, nasty_rows):
    rows = sh.shard_documents(nasty, 16).collect()
    check(rows, len(nasty_rows), 16)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in nasty_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_reruns_and_partitionings_agree(nasty):
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32, r.shard, r.slot)
    a = sorted(map(key, sh.shard_documents(nasty).collect()))
    assert a == sorted(map(key, sh.shard_documents(nasty.repartition(7, "text")).collect()))


def test_many_rows_alike(spark):
    sh_span, sh.SPAN = sh.SPAN, 10
    try:
        rows = sh.shard_documents(spark.range(57).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("text"))).collect()
    finally:
        sh.SPAN = sh_span
    check(rows, 57, 16)


def test_empty(nothing):
    assert sh.shard_documents(nothing).collect() == []


def test_no_python_in_the_plan(nasty):
    assert "Python" not in sh.shard_documents(nasty)._jdf.queryExecution().toString()
