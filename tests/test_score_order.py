"""Scores are sums in the order of places, as in SQL, so that ties are broken alike."""

import numpy as np
from pyspark.sql import functions as F

from heliograph.functions import vectors as V


def test_scores_are_sums_in_order(spark):
    rng = np.random.default_rng(5)
    m, q = rng.normal(size=(200, 64)).astype(np.float32), rng.normal(size=64)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "i int, v array<float>")
    got = {r["i"]: r["s"]["score"] for r in rows.select("i", V.scored("v", F.lit(True), q, 64).alias("s")).collect()}
    for i, v in enumerate(m.astype(float).tolist()):
        norm = 0.0
        for x in v:
            norm += x * x
        want = 0.0
        for x, y in zip(v, q.tolist(), strict=True):
            want += float(np.float32(x / np.sqrt(norm))) * y
        assert got[i] == want
