import pytest
from pyspark.sql import functions as F

from heliograph.llm import cluster


def test_stored_and_discarded(spark, tmp_path):
    df = cluster.stored(spark.range(5).selectExpr("id", "id * 2 AS v"), "probe")
    assert df.count() == 5 and "probe-" in df.inputFiles()[0]
    other = cluster.stored(spark.range(2), "probe")
    cluster.discard(df)
    assert other.count() == 2
    assert cluster.stored(spark.range(0), "probe").count() == 0


def test_names_that_differ(spark):
    df = spark.createDataFrame([(1, 2)], "_Tag int, x int")
    assert cluster.unused(df, "_tag", "_tag", "y") == ["_tag_", "_tag__", "y"]


def test_unknown_sizes_are_numbers(spark):
    assert cluster.plan_bytes(spark.range(10)) > 0


def test_shuffle_files_go(spark, tmp_path):
    before = spark.conf.get(cluster.SWEEP, None)
    cluster.stored(spark.range(1000).repartition(4, "id"), "probe")
    assert spark.conf.get(cluster.SWEEP, None) == before


def test_scratch_deletes_what_is_not_spared(spark):
    with cluster.scratch() as outer:
        with cluster.scratch() as spare:
            a, b = cluster.stored(spark.range(3), "probe"), spare(cluster.stored(spark.range(4), "probe"))
        assert b.count() == 4
        files = lambda df: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        fs = files(a).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert not fs.exists(files(a)) and fs.exists(files(b)) and outer
    assert not fs.exists(files(b))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cluster.shared_folder(Session())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, monkeypatch, how):
    monkeypatch.setattr(cluster, "LEAST_HOT", 10)
    monkeypatch.setattr(cluster, "HOT", 20)
    rows = [(None if i % 50 == 0 else 7 if i % 3 else i, i) for i in range(600)]
    many = spark.createDataFrame(rows, "k long, _part long").repartition(3)
    one = spark.createDataFrame([(k, f"x{k}") for k in range(0, 600, 2)] + [(7, "x7")], "k long, v string")
    counts = many.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = cluster.spread_join(many, one, "k", counts, F.col("_part"), how)
    assert sorted(map(str, out.collect())) == sorted(map(str, many.join(one, "k", how).collect()))
    assert out.columns == ["k", "_part", "v"]
    assert "_hot" in cluster.spread_join(many, one, "k", counts, F.col("_part"), how)._jdf.queryExecution().toString()


def test_row_keys_tell_unlike_rows_apart(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None), (1, None), (1, "a")]
    df = spark.createDataFrame(rows, "i long, t string").select(cluster.row_key(F.col("i"), F.col("t")).alias("k"))
    assert len({(r.k.a, r.k.b) for r in df.collect()}) == 6
