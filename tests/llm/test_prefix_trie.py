import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliograph.llm import cluster
from heliograph.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, pos int, digest string, block int, depth int, n int"


def brute(rows):
    """Nodes as the contract words them: every sequence, every subtree."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for node, who in members.items():
        below = [v for v in members if v[: len(node)] == node]
        children = [v for v in below if len(v) == len(node) + 1]
        leaf = lambda v: not any(w[:-1] == v for w in members if w)
        saved = sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v)
        ending = ",".join(str(c) for c in sorted(who) if paths[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(children), sum(map(leaf, below)), saved, hashlib.sha256(ending.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def talks(seed=0, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(100, 100 + n // 2), *range(205, 210), 301, 302, -1, -7, -100, -203]:
        if c in (300, 100) and seed % 2:
            continue  # a base that is absent
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "user", "bot", None]), rng.choice(["a", "a", "b", "cé😀", None, ""])))
    rows += [(3, None, "user", "first"), (3, None, None, "first"), (4, 2, "user", "tie"), (4, 2, "bot", "tie"), (4, 2, "bot", "tie"), (None, 1, "user", "lost"), (None, None, None, None)]
    return [(*r, 1, "x", 2, 3, 4) for r in rows]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = talks(seed)
    assert got(pt.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_long_conversations_in_blocks_and_spans(spark, monkeypatch):
    """Conversations over many blocks that branch off late, and copies of one; hot keys dealt into parts."""
    monkeypatch.setattr(pt, "BLOCK", 4)
    monkeypatch.setattr(pt, "SPAN", 3)
    monkeypatch.setattr(cluster, "LEAST_HOT", 2)
    monkeypatch.setattr(cluster, "HOT", 50)
    long = [("user", str(k % 3)) for k in range(40)]
    rows = [(0, k, r, t) for k, (r, t) in enumerate(long)]
    for c, stop in ((1, 40), (2, 33), (3, 8), (4, 4), (5, 5), (107, 40), (108, 40)):
        rows += [(c, k, r, t) for k, (r, t) in enumerate(long[:stop])] + [(c, 100 + k, "user", f"{c % 2}") for k in range(c % 4)]
    rows = [(*r, 1, "x", 2, 3, 4) for r in rows]
    assert got(pt.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_one_conversation_in_many_parts(spark):
    rows = [(7, k, "user", "x") for k in range(4000)]
    turns = pt.ordered_turns(spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA)).collect()
    assert sorted(r.pos for r in turns) == list(range(4000))
    alike = spark.range(4000).select(F.lit(7).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    assert sorted(r.pos for r in pt.ordered_turns(alike).collect()) == list(range(4000))
    nodes = pt.trie(alike).collect()
    assert len(nodes) == 4001 - zlib.crc32(b"7") % 6 and {r.n_leaves for r in nodes} == {1}  # with no base its first h turns go


def test_rows_grow_with_turns_and_not_with_their_square(spark):
    """A chain without branches is exploded to no ancestors."""
    rows = [(0, k, "user", str(k)) for k in range(3000)]
    nodes = {r.depth: r for r in pt.trie(spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA)).collect()}
    assert len(nodes) == 3001 and nodes[3000].ends_sha256 == hashlib.sha256(b"0").hexdigest() and nodes[1].ends_sha256 == pt.NONE


def test_turnless(spark):
    rows = [(101, 1, "user", "x", 1, "x", 2, 3, 4)]  # h of 101 is over 0 and its base absent
    assert zlib.crc32(b"101") % 6 > 0
    assert got(pt.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == Counter([(101, 0, None, 1, 0, 1, 0, hashlib.sha256(b"101").hexdigest())])


def test_pieces(monkeypatch):
    monkeypatch.setattr(pt, "PIECE", 3)
    ids = [(b"a", k) for k in range(8)] + [(b"b", 5)] + [(b"c", k) for k in range(-4, 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.binary()), pa.array([x[1] for x in part], pa.int64())], names=["digest", "conv_id"]) for part in (ids[:5], ids[5:6], ids[6:])]
    pieces = pa.Table.from_batches(pt._pieces(iter(batches)))
    assert max(s.count(",") for s in pieces["ids"].to_pylist()) == 2
    got = pa.Table.from_batches(pt._hashed(iter(pieces.select(["digest", "ids"]).to_batches(max_chunksize=2)))).to_pylist()
    want = defaultdict(list)
    for node, c in ids:
        want[node].append(str(c))
    assert {r["digest"]: r["ends_sha256"] for r in got} == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_empty(spark):
    assert pt.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pt.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", 2, 3, 4)], SCHEMA)).collect() == []
