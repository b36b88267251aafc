import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from heliograph.llm import mixing as mx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(nasty, nasty_rows):
    rows = mx.mix(nasty).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r[0], size(r[1])) for r in nasty_rows)
    sizes = Counter()
    for r in nasty_rows:
        sizes[r[3]] += size(r[1])
    want = water_fill(sizes)
    got = {(r.source_size, round(r.target, 6)) for r in rows}
    assert got == {(sizes[s], round(t, 6)) for s, t in want.items()}
    for r in rows:
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        assert len(r.positions) == (r.taken // r["size"] if r["size"] else 0)
        assert all(0 <= p <= 1 for p in r.positions) and sorted(r.positions) == list(r.positions)


def test_targets_are_met(spark):
    rows = [(i, "w " * (5 + i % 40), f"s{i % 7}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(lambda: [0, 0, 0])
    out = {r.doc_id: r for r in mx.mix(df).collect()}
    for i, t, s in rows:
        by[s][0] += out[i].taken
        by[s][1] = out[i].target
    for taken, target, _ in by.values():
        assert abs(taken - target) <= 50
    again = {r.doc_id: (r.taken, r.positions) for r in mx.mix(df.repartition(9)).collect()}
    assert again == {i: (r.taken, r.positions) for i, r in out.items()}


@pytest.mark.parametrize("few", [False, True])
def test_targets_of_many_sources(spark, few):
    import random

    rng = random.Random(6)
    sizes = {f"host{i}": rng.choice([0, 1, 5, 5, 40, 300, 9000]) for i in range(400)} | {None: 70}
    got = {r.source: r.target for r in mx.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5), few=few).collect()}
    want = water_fill(sizes)
    assert len(got) == 401 and all(abs(got[s] - t) <= 1e-6 * max(t, 1) for s, t in want.items())


def test_rows_alike_and_without_ids(spark):
    rows = [(None, f"w{i} " * 10, "a") for i in range(40)] + [(3, "same words here", "a")] * 50 + [(9, "w " * 900, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mx.mix(df).collect()
    placed = [r.position for r in out if r.doc_id is None and r.position is not None]
    assert len(out) == len(rows) and len(set(placed)) == len(placed) > 10
    want = sum(len(r.positions) for r in out if r["size"])
    assert mx.mixed_documents(df).count() == want


def test_caps_are_shared_again(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 10, "c")]
    out = {r.doc_id: r.target for r in mx.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out == {1: 30.0, 2: 960.0, 3: 30.0}


@pytest.mark.parametrize("knots", mx.SCHEDULES)
def test_schedule_inverts(spark, knots):
    def demand(t):
        total = 0.0
        for (t0, f0), (t1, f1) in zip(knots, knots[1:], strict=False):
            if t > t0:
                u = min(t, t1)
                f = f0 + (f1 - f0) * (u - t0) / (t1 - t0)
                total += (u - t0) * (f0 + f) / 2
        return total

    assert abs(demand(1.0) - 1) < 1e-12
    got = spark.range(101).select((F.col("id") / 100).alias("s"), mx.time_of(F.col("id") / 100, knots).alias("t")).collect()
    for r in got:
        assert abs(demand(r.t) - r.s) < 1e-9


def test_light_sources_come_first(spark):
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    means = {r.target: r.m for r in mx.mix(df).select("target", F.explode("positions").alias("p")).groupBy("target").agg(F.avg("p").alias("m")).collect()}
    low, mid, high = (means[t] for t in sorted(means))
    assert low < mid < high


def test_mixed_documents(nasty, nasty_rows):
    plan = {}
    for r in mx.mix(nasty).collect():
        plan[r.doc_id, r["size"]] = plan.get((r.doc_id, r["size"]), 0) + len(r.positions)
    out = mx.mixed_documents(nasty)
    assert out.columns == nasty.columns
    got = Counter((r.doc_id, len(WORD.findall(r.text))) for r in out.collect())
    assert got == Counter({k: v for k, v in plan.items() if v})


def test_empty(nothing):
    assert mx.mix(nothing).collect() == []
    assert mx.mixed_documents(nothing).collect() == []


def test_many_rows_alike(spark, monkeypatch):
    """Each has its own place in the mix, and they are counted before they are ordered."""
    monkeypatch.setattr(mx, "SPAN", 7)
    docs = spark.range(400).select(F.when(F.col("id") < 200, F.lit(None)).otherwise(F.lit(5)).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("one").alias("source"))
    docs = docs.unionByName(spark.range(50).select((F.col("id") + 10).alias("doc_id"), F.lit("two words").alias("text"), F.lit("other").alias("source")))
    rows = mx.mix(docs).collect()
    assert len(rows) == 450 and sum(r["size"] for r in rows) == 1300
    by = {s: sum(r.taken for r in rows if r.source_size == s) for s in (1200, 100)}
    assert abs(by[1200] - next(r.target for r in rows if r.source_size == 1200)) <= 3 and abs(by[100] - next(r.target for r in rows if r.source_size == 100)) <= 2
    taken = [p for r in rows if r["size"] == 3 for p in r.positions]
    assert len(set(taken)) == len(taken) > 300
    assert mx.mixed_documents(docs).count() == sum(len(r.positions) for r in rows)
