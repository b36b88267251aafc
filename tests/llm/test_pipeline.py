from collections import Counter

import pytest

import corpus_pipeline as cp
from heliograph.llm import quality_model

from .conftest import SCHEMA, rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Test tables with every odd case, and labels for some of them."""
    root = f"file://{tmp_path_factory.mktemp('sf')}"
    table = [(*r[:5],) for r in rows(4)] + [(200 + i, f"word{i} *** " * 60, "en", "junk", 1) for i in range(20)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60)] + [(200 + i, 0, 0) for i in range(15)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, table[10][1]), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    left = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if k < len(cp.STAGES) - 1:
            assert out.columns == names
            out = spark.createDataFrame(out.collect(), docs.schema)
        left[name] = (docs, out)
        docs = out
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    before, after = map(ids, left["quality_classifier"])
    scores = Counter(r.doc_id for r in quality_model.scores(left["quality_classifier"][0], spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted)
    assert after == scores and sum(after[200 + i] for i in range(20)) <= 2
    before, after = map(ids, left["near_dedup"])
    assert not {61, 62, 63, 64, 65, 66, 67, 68, 69} & set(after) and {60, 4} <= set(after)
    before, after = map(ids, left["decontamination"])
    assert 10 not in after and set(before) - set(after) == {10}
    last = left["sharding"][1].collect()
    assert len(last) == left["sharding"][0].count()
    by = Counter(r.shard for r in last)
    assert max(by.values()) - min(by.get(k, 0) for k in range(16)) <= 1


def test_run_is_the_stages(spark, folder):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "mixing", "sharding"]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.shard, r.slot)
    a, b = (sorted(map(key, cp.run(spark, folder).collect())) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("k", range(5))
def test_empty_and_clashing_columns(spark, folder, nothing, nasty, k):
    name, stage = cp.STAGES[k]
    assert stage(spark, nothing, folder).collect() == []
    out = stage(spark, nasty, folder)
    assert out.count() > 0
    if k < 4:
        assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
