"""Quality classifier: random-indexing word vectors and a small network.

Tokens are runs of letters, digits and bytes above ASCII, or runs of other
marks; they are hashed into BUCKETS.  Each bucket has a sparse random index
vector.  A word vector is the sum, over ALL documents, of the index vectors of
the tokens within WINDOW places of it; the sums are of integers, so they do not
depend on the order of tasks.  A document pools its tokens' vectors: their mean,
the mean product of neighbours, place by place, and its sum over the places (how
alike neighbours are).  Means are drawn towards 0 as by CALM tokens of nothing,
so that a handful of words says little.  A two-layer numpy network learns from at most MOST_LABELS
labelled documents (those whose id hashes lowest), a part of them set aside to
calibrate the temperature of its probabilities.

Sizes: the vectors are BUCKETS x (DIM + 1) numbers whatever the corpus, about
9 MB, and so are the partial sums of a task; the number of tasks that sum grows
with the input (one per SUM_BYTES).

Defined cases: a null or empty text has the zero vector and the score of that;
a null id hashes as the empty text (held out, as crc32 0); of several labels of
an id the largest quality counts, null ones do not; of several documents under a
labelled id the one whose features sort first teaches; without labels of both
classes every score is the share of good labels (0.5 without labels); repeated
rows score alike; no rows give no rows; other columns, whatever their names, are
ignored by ``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .cluster import plan_bytes

BUCKETS, DIM, WINDOW = 1 << 15, 32, 2
MOST_LABELS = 20_000
FOLDS = 5
CALM = 8
FEATURES = 2 * DIM + 1
HIDDEN, STEPS, RATE, DECAY = 24, 400, 0.02, 1e-3
THRESHOLD = 0.3
SUM_BYTES = 256 << 20
CHUNK = 1 << 20


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[tv.SEPARATOR] = 0


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every token."""
    starts, ends = tv.runs(_KIND[raw], offsets)
    hashes = tv.hash_spans(raw, starts, ends)
    return (hashes & tv.U64(BUCKETS - 1)).astype(np.int64), np.searchsorted(offsets, starts, "right") - 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The two non-zero places of each bucket's index vector, and their signs."""
    h = tv.mix64(np.arange(BUCKETS, dtype=np.uint64) + tv.U64(1))
    a = (h % tv.U64(DIM)).astype(np.int64)
    b = (a + 1 + ((h >> tv.U64(20)) % tv.U64(DIM - 1)).astype(np.int64)) % DIM
    signs = np.stack([1.0 - 2.0 * ((h >> tv.U64(50)) & tv.U64(1)), 1.0 - 2.0 * ((h >> tv.U64(51)) & tv.U64(1))])
    return np.stack([a, b]), signs


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total, count = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, offsets, raw in tv.chunks(batch.column(0), CHUNK):
            ids, rows = tokens(raw, offsets)
            count += np.bincount(ids, minlength=BUCKETS)
            for step in range(1, WINDOW + 1):
                near = np.flatnonzero(rows[:-step] == rows[step:])
                left, right = ids[near], ids[near + step]
                for word, beside in ((left, right), (right, left)):
                    for k in (0, 1):
                        total += np.bincount(word * DIM + places[k][beside], weights=signs[k][beside], minlength=BUCKETS * DIM)
    used = np.flatnonzero(count)
    sums = total.reshape(BUCKETS, DIM)[used].astype(np.int64)
    for i in range(0, len(used), 4096):
        part = slice(i, i + 4096)
        columns = [pa.array(used[part]), pa.array(count[used[part]]), *[pa.array(sums[part, k]) for k in range(DIM)]]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n", *[f"v{k}" for k in range(DIM)]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM vectors learnt from every text of docs."""
    spark = docs.sparkSession
    names = [f"v{k}" for k in range(DIM)]
    texts = docs.select("text")
    # an unknown size counts as huge; more parts than there are change nothing
    parts = min(max(2 * spark.sparkContext.defaultParallelism, plan_bytes(texts) // SUM_BYTES), 1_000_000)
    sums = texts.coalesce(parts).mapInArrow(_context_sums, "bucket long, n long, " + ", ".join(f"{x} long" for x in names))
    table = sums.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).toArrow()
    out = np.zeros((BUCKETS, DIM))
    if table.num_rows:
        at, n = table["bucket"].to_numpy(), table["n"].to_numpy()
        context = np.stack([table[x].to_numpy() for x in names], 1) / (2 * WINDOW * n[:, None])
        context -= (context * n[:, None]).sum(0) / n.sum()
        places, signs = index_vectors()
        for k in (0, 1):
            np.add.at(context, (np.arange(len(at)), places[k][at]), 0.5 * signs[k][at])
        out[at] = context / np.maximum(np.sqrt((context**2).sum(1, keepdims=True)), 1e-9)
    return out.astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The FEATURES of each text."""
    out = np.zeros((len(column), FEATURES), np.float32)
    for first, offsets, raw in tv.chunks(column, CHUNK):
        ids, rows = tokens(raw, offsets)
        if not len(ids):
            continue
        own, starts = np.unique(rows, return_index=True)
        # pieces bound the gathered matrix, however long a text is
        for i in range(0, len(ids), 1 << 16):
            some = vectors[ids[i : i + (1 << 16)]]
            cuts = np.unique(np.r_[0, starts[(starts > i) & (starts < i + len(some))] - i])
            at = first + rows[i + cuts]
            out[at, :DIM] += np.add.reduceat(some, cuts, axis=0)
            before = vectors[ids[i - 1 : i] if i else ids[:1]]
            pairs = some * np.concatenate([before, some[:-1]])
            pairs[starts[(starts >= i) & (starts < i + len(some))] - i] = 0
            out[at, DIM : 2 * DIM] += np.add.reduceat(pairs, cuts, axis=0)
        out[first + own] /= (np.diff(np.r_[starts, len(ids)]) + CALM)[:, None]
    out[:, 2 * DIM] = out[:, DIM : 2 * DIM].sum(1)
    return out


class Network:
    """Standardised input, one hidden layer of tanh, a logit over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, seed: int = 3) -> None:
        self.prior = float(y.mean()) if len(y) else 0.5
        self.trained = len(np.unique(y[~aside])) == 2
        self.temperature = 1.0
        if not self.trained:
            return
        fit = x[~aside].astype(np.float64)
        self.mean, self.scale = fit.mean(0), fit.std(0) + 1e-6
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        z, t = np.clip((fit - self.mean) / self.scale, -8, 8), y[~aside]
        for step in range(1, STEPS + 1):
            h = np.tanh(z @ p[0] + p[1])
            e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - t) / len(t)
            back = np.outer(e, p[2]) * (1 - h * h)
            grads = [z.T @ back + DECAY * p[0], back.sum(0), h.T @ e + DECAY * p[2], np.array([e.sum()])]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.layers = p
        if len(np.unique(y[aside])) == 2:
            logit, goal = self.logit(x[aside]), y[aside]
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, -np.where(goal == 1, logit, -logit) / s)) for s in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.layers[0] + self.layers[1]) @ self.layers[2] + self.layers[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(np.clip(-self.logit(x) / self.temperature, -60, 60)))


def _sample(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int) -> Network:
    """A network fitted to at most ``most`` labelled documents outside the held-out fold."""
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = marked.filter(fold(F.col("doc_id")) != 0).withColumn("order", F.xxhash64("doc_id"))
    chosen = usable.orderBy("order", "doc_id").limit(most).select(F.col("doc_id").alias("label_id"), "quality", "order")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b.column(3), shared.value)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), flat], names=["doc_id", "quality", "order", "x"])

    # the chosen ids are at most MOST_LABELS rows of three numbers, so they can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "quality", "order", "text")
    # of several rows of an id the one whose features sort first teaches, so at most ``most`` rows come back
    got = rows.mapInArrow(pool, "doc_id long, quality int, order long, x array<float>").groupBy("doc_id", "quality", "order").agg(F.min("x").alias("x")).toArrow()
    if not got.num_rows:
        return Network(np.zeros((0, FEATURES)), np.zeros(0), np.zeros(0, bool))
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, FEATURES)
    order = np.argsort(got["doc_id"].to_numpy())
    y = (got["quality"].to_numpy()[order] == 1).astype(np.float64)
    return Network(x[order], y, got["order"].to_numpy()[order] % 5 == 0)


def fitted(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs)
    return vectors, _sample(docs, labels, vectors, most_labels)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = model.value
        for b in batches:
            s = np.asarray(network.score(pooled(b.column(2), vectors)), np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_labels: int = MOST_LABELS) -> DataFrame:
    """The rows of docs, all their columns, that the classifier predicts to be good.  Only texts go to Python, only scores come back."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most_labels))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        vectors, network = model.value
        return pa.array(np.asarray(network.score(pooled(texts, vectors)), np.float64))

    return docs.filter(score(F.col("text")) >= threshold)
