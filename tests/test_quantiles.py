"""Quantiles by counting against Spark's, which keeps all values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import statistics as A

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


@pytest.mark.parametrize("buckets", [2, 1024])
def test_quantiles_of_odd_columns(spark, monkeypatch, buckets):
    monkeypatch.setattr(A, "BUCKETS", buckets)
    rng = np.random.default_rng(4)
    n = 400
    columns = {
        "normal": rng.normal(size=n),
        "few": rng.integers(0, 3, n).astype(float),
        "one": np.full(n, 7.5),
        "wide": rng.choice([-1.7e308, 1.7e308, 0.0, 1e-300], n),
        "skewed": np.exp(rng.normal(size=n) * (5 if buckets == 2 else 20)),
        "gaps": np.where(rng.uniform(size=n) < 0.2, np.nan, rng.normal(size=n)),
    }
    rows = [[None if name == "gaps" and math.isnan(x) else float(x) for name, x in zip(columns, row)] for row in zip(*columns.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3).withColumn("whole", F.lit(3)).withColumn("none", F.lit(None).cast("int"))
    names = [*columns, "whole"]
    got = A.exact_quantiles(df, [*names, "none"], SHARES)
    expected = df.agg(*[F.percentile(c, F.array(*map(F.lit, SHARES))).alias(c) for c in names]).first()
    for c in names:
        assert got[c] == list(expected[c]), c
    assert got["none"] == [None] * len(SHARES)


def test_quantiles_beyond_numbers(spark):
    inf = math.inf
    df = spark.createDataFrame([(x,) for x in (-inf, -inf, 1.0, 2.0, 4.0, inf, math.nan)], "x double")
    got = A.exact_quantiles(df, ["x"], (0.0, 0.25, 0.5, 0.75, 1.0))["x"]
    assert got[0] == -inf and got[2] == 2.0 and math.isnan(got[4]) and got[3] == inf
    assert A.exact_quantiles(df.limit(0), ["x"], (0.5,)) == {"x": [None]}
    row = A.describe(df.limit(0), ["x"]).first()
    assert row["count"] == 0 and row.p50 is None
