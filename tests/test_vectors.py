import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import vectors as V
from heliograph.operators import evaluate, labels, search
from heliograph.schema import Similarity
from heliograph.sources.files import synthetic_vectors


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=n).astype(np.float32).tolist(), rng.normal(size=n).astype(np.float32).tolist()) for i, n in enumerate([*range(0, 70, 7), 512, 512])]
    return rows, spark.createDataFrame(rows, "id int, a array<float>, b array<float>")


def test_dot(pairs):
    rows, df = pairs
    got = {r.id: r.d for r in df.select("id", V.dot("a", "b").alias("d")).collect()}
    for i, a, b in rows:
        assert got[i] == pytest.approx(float(np.dot(np.array(a, np.float64), np.array(b, np.float64))), abs=1e-9)


def test_normalized(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), (None,)], "v array<float>")
    rows = [r[0] for r in df.select(V.normalized("v")).collect()]
    assert rows[0] == pytest.approx([0.6, 0.8]) and rows[1:] == [None, None, None]
    with pytest.raises(Exception, match="no direction"):
        df.filter("v[0] = 0").select(V.normalized("v", strict=True)).collect()


@pytest.mark.parametrize("kind", [Similarity.SHAPE, Similarity.COLOR])
def test_projection_equals_focused_similarity(spark, kind):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(rng.normal(size=512).tolist(), rng.normal(size=512).tolist()) for _ in range(101)] + [([0.0] * 512, [1.0] * 512)], "a array<float>, b array<float>")
    rows = df.select(V.dot(V.projected("a", kind, 512), V.projected("b", kind, 512)).alias("x"), V.focused_similarity("a", "b", kind, 512).alias("y")).collect()
    assert all(abs(r.x - r.y) < 1e-6 for r in rows) and rows[-1].x == 0


def test_groups():
    assert V.parts(Similarity.SHAPE, 512) == [(192, 64), (320, 192)] and V.parts(Similarity.COLOR, 64) == [(0, 24), (32, 8)]


def test_blob_codec(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>").select(V.pack("v").alias("b"))
    assert [bytes(r.b) if r.b else None for r in df.collect()] == [np.array([1.5, -2.0], "<f4").tobytes(), None]
    assert [r[0] for r in df.select(V.unpack("b")).collect()] == [[1.5, -2.0], None]
    assert df.select(V.unpack(F.lit(b"abc"))).head()[0] is None


def test_blob_codec_on_odd_rows(spark):
    rng = np.random.default_rng(4)
    vectors = [None if i % 7 == 0 else rng.normal(size=i % 5).astype(np.float32).tolist() for i in range(200)]
    blobs = [None if v is None else np.array(v, "<f4").tobytes() + (b"x" if i % 11 == 0 else b"") for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, b) for i, (v, b) in enumerate(zip(vectors, blobs, strict=True))], "i int, v array<float>, b binary").repartition(3)
    rows = {r.i: r for r in df.select("i", V.pack("v").alias("p"), V.unpack("b").alias("u")).collect()}
    for i, v in enumerate(vectors):
        assert (rows[i].p and bytes(rows[i].p)) == (None if v is None else np.array(v, "<f4").tobytes())
        assert rows[i].u == (None if v is None or i % 11 == 0 else v)


def test_normalising_takes_time_in_proportion(spark):
    """Four times the dimensions cost about four times as much, not sixteen."""
    import time

    def seconds(d):
        df = synthetic_vectors(spark, 1500, d).repartition(4).cache()
        df.count()
        good = V.usable("embedding", None, d)
        work = [V.normalized("embedding"), V.normalized_or_zero("embedding", good, d), V.projected("embedding", Similarity.SHAPE, d), V.focused_similarity("embedding", "embedding", Similarity.COLOR, d)]
        best = []
        for _ in range(3):
            began = time.perf_counter()
            df.select(*work).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        df.unpersist()
        return min(best)

    seconds(64)
    assert seconds(2048) < 8 * seconds(512) + 0.3


def test_values_are_computed_once(spark):
    df = spark.range(1).select(V.let(F.col("id") + 1, lambda x: F.transform(F.array(F.lit(1), F.lit(2)), lambda y: x + y)).alias("v"))
    assert df.head().v == [2, 3]
    assert spark.range(1).select(V.literal([0.1, -1e-17, 3.0]).alias("v")).head().v == [0.1, -1e-17, 3.0]


def test_labels(spark):
    bank = [("cat", [1.0, 0.0]), ("dog", [0.0, 1.0]), ("cow", [0.999, 0.04]), ("ant", [0.98, 0.199])]
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.1, 0.1]), (3, [0.0, -1.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.labels for r in labels.zero_shot(df, bank).collect()}
    assert got == {1: "cat, cow, ant", 2: "", 3: ""}


def test_label_bank():
    assert len(labels.NAMES) == len(set(labels.NAMES)) == 90
    bank = labels.embedded_bank(lambda t: [float(len(t))] if t != "a photo of a cat" else None)
    assert len(bank) == 89 and bank[0] == ("a person", [19.0])


def test_nearest_others_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    for blocks in (1, 5):
        got = {(r["query"], r["rank"]): r["id"] for r in evaluate.nearest_others(df, 3, blocks=blocks).collect()}
        for i in range(60):
            s = np.round(v @ v[i], 9)
            s[i] = -np.inf
            assert [got[i, k] for k in (1, 2, 3)] == np.lexsort((np.arange(60), -s))[:3].tolist()


def test_synthetic_source(spark):
    rows = synthetic_vectors(spark, 50, 16).collect()
    again = synthetic_vectors(spark, 50, 16).repartition(3).orderBy("vec_id").collect()
    assert rows == again and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)


ODD = [[3.0, 4.0, 0.0, 1.0], [0.0] * 4, [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], None, [1.0, 2.0], [1.0, None, 1.0, 1.0], [1e-7] * 4, [1e-30] * 4, [1e30] * 4, [-1.0, 0.5, 0.25, 2.0]]


@pytest.mark.parametrize("kind", list(Similarity))
def test_scores_by_batch_and_by_expression_agree(spark, kind):
    rng = np.random.default_rng(5)
    vectors = ODD + [rng.normal(size=4).astype(np.float32).tolist() for _ in range(300)]
    df = spark.createDataFrame([(i, v, ["cpu-v3", "foreign", None][i % 3 if i > 20 else 0]) for i, v in enumerate(vectors)], "id int, v array<float>, model string").repartition(3)
    query = rng.normal(size=len(vectors[0]) if kind in (Similarity.SUBJECT, Similarity.APPEARANCE) else sum(n for _, n in V.parts(kind, 4))).tolist()
    good = V.usable("v", "model", 4)
    unit = V.projected(V.normalized_or_zero("v", good, 4), kind, 4)
    known = F.coalesce(F.col("model").isin("cpu-v3"), F.lit(False))
    rows = df.select("id", good.alias("g"), F.when(good, V.dot(unit, V.literal(query))).otherwise(0.0).alias("d"), V.scored("v", known, query, 4, kind).alias("s")).collect()
    assert [r.id for r in rows if r.g != r.s.available or abs(r.d - r.s.score) > 1e-12] == []
    assert 50 < sum(r.g for r in rows) < 150


def test_products(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [0.0, -1.0])], "id int, v array<float>")
    assert {r.id: r.p for r in df.select("id", V.products("v", [[1.0, 1.0], [0.5, 0.0], [0.0, 3.0]]).alias("p")).collect()} == {1: [3.0, 0.5, 6.0], 2: None, 3: None, 4: [-1.0, 0.0, -3.0]}


@pytest.mark.parametrize("norm", [None, "n"])
def test_top_k_over_batches(spark, norm):
    """Against a full sort, with equal vectors across batches, lengths that let batches be left out, and vectors of other lengths."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 8)).astype(np.float32) * np.linspace(0.01, 3, 4000)[::-1, None].astype(np.float32)
    v[1000:1040] = v[17]
    rows = [(i, x.tolist(), float(np.sqrt((x.astype(float) ** 2).sum()))) for i, x in enumerate(v)] + [(5000, [1.0], 1.0), (5001, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n double").coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    try:
        for query in (v[17], v[3], -v[900]):
            scores = np.einsum("ij,j->i", v.astype(float), query.astype(float))
            for k in (1, 10, 100):
                got = [r.vec_id for r in search.top_k(df, query.astype(float).tolist(), k, 8, norm=norm).collect()]
                assert got == np.lexsort((np.arange(4000), -scores))[:k].tolist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
