import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm import near_dup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=80):
    """(doc_id, n, component, kept) by comparing all pairs of texts."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= threshold * len(sets[i] | sets[j]) and sets[j]:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return Counter((d, len(sets[i]), d if not sets[i] else least[root(i)], (d == least[root(i)]) if sets[i] else True) for i, (d, _) in enumerate(rows))


def got(df, threshold=80):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.components(df, threshold).collect())


def test_nasty(nasty, nasty_rows):
    assert got(nasty) == brute([(r[0], r[1]) for r in nasty_rows])


def chains(seed):
    """Families of edited copies whose ends are far apart, and texts that share a passage only."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, passage = [], [word() for _ in range(60)]
    for _ in range(6):
        text = [word() for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(12):
            rows.append(" ".join(text))
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = word()
    rows += [" ".join(passage + [word() for _ in range(rng.randint(8, 40))]) for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_shared_passages(spark, seed):
    rows, threshold = chains(seed), 75 + 10 * (seed % 2)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), threshold) == brute(rows, threshold)


def test_large_groups_in_small_blocks(spark):
    rows = chains(3)
    block, nd.BLOCK = nd.BLOCK, 7
    try:
        assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    finally:
        nd.BLOCK = block


def clouds(seed):
    """Texts that share most of a template, beside real copies of some of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(2):
        template = [word() for _ in range(90)]
        for _ in range(40):
            text = template + [word() for _ in range(rng.randint(20, 40))]
            rows.append(" ".join(text))
            if rng.random() < 0.4:
                text[-rng.randint(1, 9)] = word()
                rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("threshold", [80, 85])
def test_wide_buckets_meet_by_rare_shingles(spark, monkeypatch, threshold):
    met = []
    rare = nd._rare
    monkeypatch.setattr(nd, "WIDE", 3)
    monkeypatch.setattr(nd, "BLOCK", 5)
    monkeypatch.setattr(nd, "_rare", lambda *x: met.append(rare(*x)) or met[-1])
    rows = clouds(threshold)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), threshold) == brute(rows, threshold)
    assert met


def test_rare_shingles_of_similar_sets_meet(spark):
    rng = np.random.default_rng(2)
    heavy = rng.integers(0, 2**62, 60, dtype=np.uint64)
    sets = []
    for _ in range(40):
        a = np.unique(np.r_[heavy[rng.random(60) < 0.95], rng.integers(0, 2**62, 15, dtype=np.uint64)])
        sets += [a, np.unique(np.r_[a[rng.random(len(a)) < 0.93], rng.integers(0, 2**62, 3, dtype=np.uint64)])]
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "id long, set binary")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "id long, n long")
    buckets = {}
    for r in nd._rare(df, sizes, 80).collect():
        buckets.setdefault(r.bucket, set()).add(r.id)
    met = {(i, j) for b in buckets.values() for i in b for j in b if i < j}
    every = [(i, j) for j in range(len(sets)) for i in range(j)]
    alike = {(i, j) for i, j in every if nd.similar(sets[i], sets[j], 80)}
    assert alike and alike <= met and len(met) < len(every) / 4


def test_texts_without_ids(spark, monkeypatch):
    """Unlike texts under no id, or under one, are told apart; copies are spread over parts."""
    from heliograph.llm import cluster

    monkeypatch.setattr(cluster, "LEAST_HOT", 4)
    monkeypatch.setattr(cluster, "HOT", 16)
    rows = [(None if i % 3 else 7, t) for i, t in chains(5)] + [(1000 + i, "one two three four five six seven") for i in range(30)] + [(None, "alike alike " * 9)] * 20
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_sketch_concentrates():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 400, 5000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 10] = rng.integers(0, 2**63, n // 10, dtype=np.uint64)
        x, y = nd.sketch(np.unique(a)), nd.sketch(np.unique(b))
        assert (x != ~np.uint64(0)).all()
        real = (n - n // 10) / (n + n // 10)
        assert abs((x == y).mean() - real) < 0.16


def test_sketch_is_the_definition():
    """Round by round, without batching of rounds."""
    elements = np.unique(np.random.default_rng(4).integers(0, 2**63, 9, dtype=np.uint64))
    want = np.full(nd.T, ~np.uint64(0))
    for r in range(2 * nd.T):
        h = nd.tv.mix64(elements ^ nd._SEEDS[r])
        for v in h:
            bin_ = int(v >> np.uint64(57)) if r < nd.T else r - nd.T
            want[bin_] = min(want[bin_], (v & nd._LOW) | (np.uint64(r) << np.uint64(56)))
        if r < nd.T and (want >> np.uint64(56) < nd.T).all():
            break
    assert (nd.sketch(elements) == want).all()


def test_keep_one(nasty, nasty_rows):
    kept = nd.keep_one(nasty)
    assert kept.columns == nasty.columns
    rows = kept.collect()
    full = [r for r in rows if shingles(r.text)]
    want = {(c, n) for (d, n, c, k) in brute([(r[0], r[1]) for r in nasty_rows]) if n}
    assert len(full) == len({(r.doc_id, len(shingles(r.text))) for r in full}) and len(full) <= len(want)
    assert sum(not shingles(r.text) for r in rows) == sum(not shingles(r[1]) for r in nasty_rows)
    assert len(got(kept)) and all(c == d for d, _, c, _ in got(kept) if d is not None)


def test_empty(nothing):
    assert nd.components(nothing).collect() == []
    assert nd.keep_one(nothing).collect() == []


def test_rows_of_pairs_of_blocks_grow_with_the_members(spark):
    """A bucket of unlike components beside a large one: each member in a few pairs of blocks, whatever the bucket's size."""
    made = {}
    for n in (3000, 6000):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("bucket"), "id", F.when(F.col("id") < n // 3, F.lit(0)).otherwise(F.col("id")).alias("comp"), F.lit(0).cast("long").alias("top"), F.lit(128).alias("w"))
        pairs = nd._blocks(rows, "w").select("x", "y", "mine", "id", "comp").toPandas()
        made[n] = len(pairs)
        others = pairs[pairs["comp"] > 0].groupby("id")["mine"].first()
        # each two of the others, and each of them with the largest component, meet in one task at least
        met = {(a, b) for a, b in zip(pairs["x"], pairs["y"], strict=True)}
        blocks, large = set(others), set(pairs[pairs["comp"] == 0]["mine"])
        assert len(others) == n - n // 3 and {(min(a, b), max(a, b)) for a in blocks for b in blocks | large} <= met
    assert made[3000] <= 8 * 3000 and made[6000] <= 8 * 6000


def test_shared_counts_are_those_of_the_sets(monkeypatch):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 300, int(r.integers(1, 120)))).astype(np.uint64) for _ in range(60)] + [np.array([10**9], np.uint64)]
    i, j = np.triu_indices(len(sets), 1)
    want = [len(np.intersect1d(sets[p], sets[q])) for p, q in zip(i, j, strict=True)]
    for most in (nd.BITS_BYTES, 512):  # at once, and 64 bits at a time
        monkeypatch.setattr(nd, "BITS_BYTES", most)
        assert nd.shared(sets, i, j).tolist() == want
    wide = [np.unique(np.r_[np.uint64(k), 10 + np.arange(2, dtype=np.uint64) + 2 * np.uint64(k // 2)]) for k in range(8000)]
    a, b = np.arange(0, 8000, 2), np.arange(1, 8000, 2)  # elements are very many beside those of a set
    assert nd.shared(wide, a, b).tolist() == [len(np.intersect1d(wide[p], wide[q])) for p, q in zip(a, b, strict=True)]
    assert nd.shared(sets, i[:0], j[:0]).tolist() == []


def test_steps_that_are_read_again_are_stored(spark):
    """What is left of a block comes as whole rows from files, so no later plan makes it again, and the driver plans few exchanges at once."""
    low = bytes(nd.T)
    rows = [(1, 10, 10, 10, 4, low), (1, 11, 11, 10, 4, low), (2, 12, 12, 12, 4, low), (2, 13, 13, 12, 400, low)]
    out = nd._promising(spark.createDataFrame(rows, "bucket long, id long, comp long, top long, n long, low binary"), 80)
    assert out.inputFiles() and sorted(map(tuple, out.collect())) == rows[:2]
