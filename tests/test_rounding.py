"""Rounding as in SQL, to the sign of nothing."""

import math
import os
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from heliograph.functions.scalars import rounded, rounded_all
from heliograph.plans import registry
from heliograph.sources.catalog import TABLES


def bits(x):
    return struct.pack("<d", x)


def test_rounding_keeps_the_sign_of_what_becomes_nothing(spark):
    values = [-4e-7, 4e-7, -0.0, 0.0, -5e-7, 0.1234565, -1.0000005, 2.5, -1e300, float("inf"), float("-inf"), 123456789.1234567]
    rows = spark.createDataFrame([(i, x, [x]) for i, x in enumerate(values)], "i int, x double, v array<double>")
    got = rows.select("i", rounded("x", 6).alias("a"), rounded(F.col("x") * 1, 6).alias("b"), rounded_all("v", 6)[0].alias("c")).orderBy("i").collect()
    con = duckdb.connect()
    for r, x in zip(got, values, strict=True):
        want = con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchall()[0][0]
        assert [bits(r[c]) for c in "abc"] == [bits(want)] * 3, x
    odd = spark.sql("SELECT double('NaN') AS x, CAST(NULL AS double) AS y, CAST(NULL AS array<double>) AS v").select(rounded("x", 6).alias("x"), rounded("y", 6).alias("y"), rounded_all("v", 6).alias("v")).head()
    assert math.isnan(odd["x"]) and odd["y"] is None and odd["v"] is None


@pytest.mark.parametrize("name", ["blob_codec", "catalog_appearance", "catalog_semantic", "project_color", "project_shape", "vector_normalize"])
def test_small_negative_places_are_as_in_sql(spark, sf, tmp_path, name):
    """Every place is small beside the first, so that many are rounded to nothing; the sign counts."""
    for table in TABLES:
        os.symlink(f"{sf}/{table}.parquet", tmp_path / f"{table}.parquet")
    os.unlink(tmp_path / "embeddings.parquet")
    rows = spark.range(60).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k % 16 == 0, F.lit(1.0)).otherwise((k % 8 - 4) * 1e-7).cast("float")).alias("embedding"), F.lit(1).alias("label"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet{'/*.parquet' if table == 'embeddings' else ''}'")
    query = con.sql(registry.oracle_sql()[name])
    want = query.fetchall()
    key, v = query.columns[0], "v" if "v" in query.columns else "vector"
    place = query.columns.index(v)
    got = {r[key]: [bits(x) for x in r[v]] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert got == {r[0]: [bits(x) for x in r[place]] for r in want}
    assert any(bits(-0.0) in x for x in got.values())
