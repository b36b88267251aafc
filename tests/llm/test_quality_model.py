import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from heliograph.llm import quality_model as qm
from heliograph.llm import textvec as tv


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = ["river", "stone", "the", "of", "light", "paper", "a", "in", "table", "letter", "and", "garden"]
    docs, labels = [], []
    for i in range(600):
        n = rng.randint(20, 120)
        good = rng.random() < 0.75
        text = " ".join(rng.choice(words) for _ in range(n))
        if not good:
            text = rng.choice([lambda t: " ".join(w + "***" for w in t.split()), lambda t: " | ".join(t.split()), lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w for w in t.split()[:6] for _ in range(15))])(text)
        docs.append((i, text, "x"))
        if i % 4:
            labels.append((i, int(good), 0))
    docs += [(600, None, "x"), (601, "", "x"), (None, "river stone", "x"), (602, "x " * 100_000, "x"), (5, docs[5][1], "x")]
    labels += [(None, 1, 0), (603, 0, 0), (604, None, 0), (5, 0, 0), (5, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = qm.scores(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id is not None and r.doc_id < 600 and r.doc_id != 5}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert sum((r.predicted == 1) == (truth[r.doc_id] == 1) for r in held) / len(held) > 0.9
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)


def test_reruns_agree(corpus):
    docs, labels = corpus
    key = lambda r: (r.doc_id is None, r.doc_id or 0, round(r.score, 9))
    assert sorted(map(key, qm.scores(docs, labels).collect())) == sorted(map(key, qm.scores(docs.repartition(5), labels).collect()))


def test_held_out_labels_are_not_seen(corpus, spark):
    docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = ({(r.doc_id, round(r.score, 9)) for r in qm.scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_word_vectors_against_counting(spark):
    texts = ["a b c a", "b c!! d", None, "", "a a a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    places, signs = qm.index_vectors()
    sums, n = {}, {}
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        ids = qm.tokens(raw, np.array([0, len(raw)]))[0].tolist()
        for i, w in enumerate(ids):
            n[w] = n.get(w, 0) + 1
            own = sums.setdefault(w, np.zeros(qm.DIM))
            for j in range(max(0, i - qm.WINDOW), min(len(ids), i + qm.WINDOW + 1)):
                if j != i:
                    for k in (0, 1):
                        own[places[k][ids[j]]] += signs[k][ids[j]]
    rows = sorted(sums)
    context = np.array([sums[w] / (2 * qm.WINDOW * n[w]) for w in rows])
    weight = np.array([n[w] for w in rows])[:, None]
    context -= (context * weight).sum(0) / weight.sum()
    for r, w in enumerate(rows):
        for k in (0, 1):
            context[r, places[k][w]] += 0.5 * signs[k][w]
    context /= np.sqrt((context**2).sum(1, keepdims=True))
    assert np.allclose(qm.word_vectors(df)[rows], context, atol=1e-5)


def test_pooling_in_pieces():
    vectors = np.random.default_rng(1).normal(size=(qm.BUCKETS, qm.DIM)).astype(np.float32)
    texts = ["one two three", None, "", "word " * 70_000, "a b"]
    got = qm.pooled(pa.array(texts), vectors)
    for t, row in zip(texts, got, strict=True):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        v = vectors[qm.tokens(raw, np.array([0, len(raw)]))[0]].astype(np.float64)
        if len(v):
            assert np.allclose(row[: qm.DIM], v.sum(0) / (len(v) + qm.CALM), atol=1e-3)
            assert np.allclose(row[qm.DIM : 2 * qm.DIM], (v[1:] * v[:-1]).sum(0) / (len(v) + qm.CALM), atol=1e-3)
        else:
            assert not row.any()


def test_calibration_and_degenerate_labels(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in qm.scores(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert {r.score for r in qm.scores(df, one).collect()} == {1.0}
    assert qm.scores(df.limit(0), one).collect() == []


def test_keep_good(corpus):
    docs, labels = corpus
    kept = qm.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in qm.scores(docs, labels).collect() if r.predicted)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want


def test_hashing_spans():
    raw = np.frombuffer("ab cd ab".encode(), np.uint8)
    h, rows, s, e = tv.words(raw, np.array([0, 5, 8]))
    assert (s.tolist(), e.tolist(), rows.tolist()) == ([0, 3, 6], [2, 5, 8], [0, 0, 1])
    assert h[0] == h[2] != h[1]


def test_hashing_long_texts_in_pieces():
    rng = np.random.default_rng(8)
    text = b" ".join(bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in [*rng.integers(1, 9, 300), tv.LONG * 3 + 5, 7, tv.LONG, tv.LONG + 1])
    raw = np.frombuffer(text, np.uint8)
    whole, _, s, e = tv.words(raw, np.array([0, len(raw)]))
    piece, tv.PIECE = tv.PIECE, 100
    try:
        assert (tv.hash_spans(raw, s, e) == whole).all() and len(set(whole.tolist())) >= 290
    finally:
        tv.PIECE = piece
    changed = raw.copy()
    changed[int(s[300]) + tv.LONG + 3] ^= 1
    assert (tv.hash_spans(changed, s, e) != whole).nonzero()[0].tolist() == [300]


# independent versions: pooling token by token, a network by numeric gradients, and the temperature by search


def naive_pool(text, vectors):
    kind = lambda b: 0 if b in b" \t\n\x0b\x0c\r" else 1 if chr(b).isalnum() and b < 128 or b >= 128 else 2
    raw, ids, at = (text or "").encode(), [], 0
    while at < len(raw):
        end = at
        while end < len(raw) and kind(raw[end]) == kind(raw[at]):
            end += 1
        if kind(raw[at]):
            span = np.frombuffer(raw, np.uint8)
            ids.append(int(tv.hash_spans(span, np.array([at]), np.array([end]))[0] & np.uint64(qm.BUCKETS - 1)))
        at = end
    mean, pairs = np.zeros(qm.DIM), np.zeros(qm.DIM)
    for k, i in enumerate(ids):
        mean += vectors[i]
        if k:
            pairs += vectors[i] * vectors[ids[k - 1]]
    if ids:
        mean, pairs = mean / (len(ids) + qm.CALM), pairs / (len(ids) + qm.CALM)
    return np.r_[mean, pairs, pairs.sum()]


def test_pooling_token_by_token():
    vectors = np.random.default_rng(1).normal(size=(qm.BUCKETS, qm.DIM)).astype(np.float32)
    texts = ["one two  three", None, "", " \n", "a*b ***c é,ü 12", "same same same", "word " * 700 + "end"]
    got = qm.pooled(pa.array(texts), vectors)
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, naive_pool(text, vectors), atol=2e-4)


def test_network_against_numeric_gradients(monkeypatch):
    monkeypatch.setattr(qm, "STEPS", 4)
    monkeypatch.setattr(qm, "HIDDEN", 3)
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(40, 5)), (rng.random(40) < 0.6).astype(float)
    x[:, 0] += y
    aside = np.arange(40) % 5 == 0
    net = qm.Network(x, y, aside, seed=7)
    mean, scale = x[~aside].mean(0), x[~aside].std(0) + 1e-6
    z, t = np.clip((x[~aside] - mean) / scale, -8, 8), y[~aside]
    draw = np.random.default_rng(7)
    p = np.concatenate([draw.normal(0, 5**-0.5, (5, 3)).ravel(), np.zeros(3), draw.normal(0, 3**-0.5, 3), np.zeros(1)])

    def logit(p, z):
        return np.tanh(z @ p[:15].reshape(5, 3) + p[15:18]) @ p[18:21] + p[21]

    def loss(p):
        u = logit(p, z)
        return np.mean(np.logaddexp(0, u) - t * u) + qm.DECAY / 2 * (np.sum(p[:15] ** 2) + np.sum(p[18:21] ** 2))

    m = v = np.zeros(22)
    for step in range(1, 5):
        g = np.array([(loss(p + e) - loss(p - e)) / 2e-6 for e in np.eye(22) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - qm.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    own = np.concatenate([a.ravel() for a in net.layers])
    assert np.allclose(own, p, atol=1e-4)
    # the temperature: the best of a finer search is no better than a step of the grid
    u, goal = logit(p, np.clip((x[aside] - mean) / scale, -8, 8)), y[aside]
    nll = lambda s: np.mean(np.logaddexp(0, u / s) - goal * u / s)
    fine = min(np.linspace(0.25, 8, 20_000), key=nll)
    assert abs(np.log(net.temperature / fine)) <= np.log(8 / 0.25) / 60 + 1e-3
    scores = 1 / (1 + np.exp(-logit(p, np.clip((x - mean) / scale, -8, 8)) / net.temperature))
    assert np.allclose(net.score(x), scores, atol=1e-3)


def test_many_rows_under_a_labelled_id(spark, corpus):
    """One row of an id teaches, the same one on every run, however many there are."""
    docs, labels = corpus
    extra = spark.createDataFrame([(6, f"river stone number {k}", "x") for k in range(300)], docs.schema)
    many = docs.unionByName(extra)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, round(r.score, 9))
    assert sorted(map(key, qm.scores(many, labels).collect())) == sorted(map(key, qm.scores(many.repartition(7), labels).collect()))
