"""Percentiles of groups of any size against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import order_stats
from evalspark.operators.order_stats import percentiles

QS, NAMES = [0.0, 0.05, 0.5, 0.95, 1.0], ["p0", "p5", "p50", "p95", "p100"]


def want(values):
    v = [x for x in values if x is not None]
    return [float(x) for x in np.percentile(v, [100 * q for q in QS])] if v else [0.0] * 5


@pytest.mark.parametrize("spread", [0, 1 << 20])
def test_groups_of_all_shapes(spark, monkeypatch, spread):
    monkeypatch.setattr(order_stats, "SPREAD", spread)
    rng = np.random.default_rng(7)
    groups = {
        "many": rng.normal(size=6000).tolist(), "wild": (rng.choice([-1, 1], 3000) * 10.0 ** rng.uniform(-300, 300, 3000)).tolist(), "equal": [3.5] * 4000, "few values": rng.choice([1.0, 2.0, 2.5], 4000).tolist(),
        "nearly all equal": [0.0] * 3000 + rng.uniform(size=200).tolist(), "two": [1.0] * 1500 + [2.0] * 1500, "small": [1.0, None, 4.0], "none": [None, None], None: rng.exponential(size=2500).tolist(), "zeros": [-0.0, 0.0] * 1000,
    }
    rows = spark.createDataFrame([(k, float(x) if x is not None else None) for k, v in groups.items() for x in v], "k string, v double").repartition(7)
    got = {r.k: [r[n] for n in NAMES] for r in percentiles(rows, ["k"], "v", QS, NAMES, limit=100).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k] == pytest.approx(want(values), rel=1e-12, abs=1e-300), k


def test_nan_and_infinity(spark):
    values = [float(i) for i in range(300)] + [math.inf] * 100 + [-math.inf] * 100 + [math.nan] * 100
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = percentiles(rows, [], "v", [0.0, 0.5, 0.7, 0.99], ["a", "b", "c", "d"], limit=50).first()
    assert got.a == -math.inf and got.b == 199.5 and got.c == math.inf and math.isnan(got.d)


def test_empty(spark):
    rows = spark.createDataFrame([], "k string, v double")
    assert percentiles(rows, ["k"], "v", [0.5], ["p"]).count() == 0


def test_ten_million_distinct_values_in_one_group(spark):
    """No task holds more than a bucket: what is collected in one row has ``limit`` values at most."""
    n, step = 10_000_000, 7_919_999  # a permutation of 0 .. n - 1
    rows = spark.range(n).select(F.lit("all").alias("k"), (F.col("id") * step % n).cast("double").alias("v"))
    got = percentiles(rows, ["k"], "v", [0.05, 0.95], ["low", "high"]).first()
    assert (got.low, got.high) == pytest.approx((0.05 * (n - 1), 0.95 * (n - 1)), rel=1e-12)
