import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from heliograph.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, tk string, found int"


def brute(rows):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for s in range(len(b) - 199):
            seen[b[s : s + 200]] += 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)  # columns with clashing names
    got = sd.remove_repeats(df).collect()
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got]


def key(x):
    return (x[0] is None, x[0] or 0, x[1:])


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh ijé\n"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [noise(rng.choice([60, 150, 199, 200, 201, 260, 400, 900])) for _ in range(8)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.35:
                text += rng.choice(passages)
            elif kind < 0.5:
                unit = noise(rng.choice([1, 2, 5, 37, 90, 161, 200, 230]))
                text += unit * (rng.choice([100, 250, 420, 700]) // len(unit) + 1)
            elif kind < 0.65:
                p = rng.choice(passages)
                cut = rng.randrange(len(p))
                text += p[cut:] + noise(3)
            else:
                text += noise(rng.choice([5, 80, 300]))
        rows.append((i, text))
    rows += [(100, rows[5][1]), (100, rows[5][1]), (100, rows[7][1]), (None, rows[9][1]), (None, None), (101, None), (102, "")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_long_text_in_pieces(spark):
    rng = random.Random(9)
    part = "".join(rng.choice("abcdefghij") for _ in range(500))
    filler = lambda n: "".join(rng.choice("klmnopqrst") for _ in range(n))
    text = filler(sd.CHUNK * 2 + 100) + part + filler(sd.CHUNK) + part + "z" * 1000 + filler(100)
    rows = [(1, text), (2, filler(300) + part[100:450])]
    assert sorted(run(spark, rows)) == sorted(brute(rows))


def test_empty(spark):
    assert run(spark, []) == []


def test_spans_and_bytes(spark):
    part = "x1y2z3" * 40
    df = spark.createDataFrame([(1, "AA" + part), (2, part + "BB")], "doc_id long, text string")
    got = {r.doc_id: r for r in sd.remove_repeats(df, with_bytes=True).collect()}
    assert bytes(got[1].kept) == b"AA" and bytes(got[2].kept) == b"BB"
    assert [(s.start, s.end) for s in got[1].spans] == [(2, 242)]


def test_rows_whose_short_hashes_agree(spark):
    """Unlike texts of one 32-bit hash, under one id and under none: the lone one keeps every byte."""
    from pyspark.sql import functions as F

    texts = spark.range(200_000).select(F.concat(*[F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 256) for k in "abcde"]).alias("t"))
    a, b = next(r["x"] for r in texts.groupBy(F.hash("t").alias("h")).agg(F.sort_array(F.collect_list("t")).alias("x")).filter("size(x) > 1").orderBy("h").collect())
    rows = [(5, a[:-1] + "A"), (6, a), (6, b), (1, a), (None, b[:-1] + "B"), (None, a), (None, "p" + b[::-1])]
    for lone in (5, 6, None):
        some = [(lone, a), (lone, b), (1, a)]
        got = {(r[0], r[1], r[4]): r[2] for r in run(spark, some)}
        assert got[lone, 320, hashlib.sha256(b.encode()).hexdigest()] == 0
        assert sorted(run(spark, some), key=key) == sorted(brute(some), key=key)
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_hot_buckets_in_parts(spark, monkeypatch):
    """One passage in most texts, in unlike surroundings: its buckets are dealt out."""
    from heliograph.llm import cluster

    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(230)
    rows = [(i, noise(rng.choice([0, 40, 170])) + passage + noise(rng.choice([0, 90, 210]))) for i in range(60)]
    monkeypatch.setattr(cluster, "LEAST_HOT", 4)
    monkeypatch.setattr(cluster, "HOT", 40)
    assert sorted(run(spark, rows)) == sorted(brute(rows))
