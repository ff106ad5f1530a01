"""Order statistics by intervals and counts equal sorting, whatever the sketches say."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featpipe.operators import features as FE
from featpipe.plans import selection

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def _want(values, p):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    at = p * (len(v) - 1)
    lo, hi = v[math.floor(at)], v[math.ceil(at)]
    return lo if at == math.floor(at) else lo + (at - math.floor(at)) * (hi - lo)


def _same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_sorting(spark, seed):
    r = random.Random(seed)
    rows = []
    for g, n in (("a", 4000), ("b", 7), (None, 300), ("one", 1), ("ties", 900)):
        draw = {"ties": lambda: float(r.choice([1, 1, 1, 2])), "b": lambda: r.choice([float("nan"), -1.5, 3.0])}.get(
            g, lambda: r.choice([r.gauss(0, 1), r.lognormvariate(0, 30), -1e300, 0.0]))
        rows += [(g, draw()) for _ in range(n)]
    rows += [("a", None), ("empty", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double")
    got = {x.g: [x[f"p{k}"] for k in range(len(PROBS))] for x in FE.exact_quantiles(df, "x", PROBS, ["g"], [f"p{k}" for k in range(len(PROBS))]).collect()}
    assert set(got) == {"a", "b", None, "one", "ties"}
    for g, values in got.items():
        own = [x for k, x in rows if k == g and x is not None]
        assert all(_same(v, _want(own, p)) for v, p in zip(values, PROBS, strict=True)), g


def test_many_small_groups_and_a_heavy_one(spark):
    r = random.Random(5)
    rows = [(0 if k % 3 == 0 else r.randrange(1, 60), r.random()) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {x.g: x.med for x in FE.exact_quantiles(df, "x", [0.5], ["g"], ["med"]).collect()}
    assert len(got) > 2 * 4  # more groups than are selected one by one
    for g, med in got.items():
        assert med == pytest.approx(_want([x for k, x in rows if k == g], 0.5), rel=1e-12)


def test_intervals_are_narrowed_until_they_are_small(spark):
    df = spark.range(200_000).select(F.pow((F.col("id") * 7919 % 200_003).cast("double"), 3).alias("v"))
    values = np.sort((np.arange(200_000, dtype=np.float64) * 7919 % 200_003) ** 3)
    calls = []
    narrowed = selection._narrowed
    selection._narrowed = lambda *a: (calls.append(1), narrowed(*a))[1]
    try:
        ((_, n, at),) = selection.order_statistics(df, [], [0.3, 0.777], inside=50)
    finally:
        selection._narrowed = narrowed
    assert calls and n == 200_000
    for p, pair in at.items():
        assert pair == (values[math.floor(p * (n - 1))], values[math.ceil(p * (n - 1))])


def test_wrong_sketches_cost_passes_not_results(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    sketched, first = selection._sketched, []

    def off(rows, keys, fractions):
        out = sketched(rows, keys, fractions)
        if first:
            return out
        first.append(1)
        return out.withColumn("q", F.transform("q", lambda x: x + 700))  # the intervals miss their ranks

    monkeypatch.setattr(selection, "_sketched", off)
    ((_, n, at),) = selection.order_statistics(df, [], [0.5, 0.25])
    assert at == {0.5: (2499.0, 2500.0), 0.25: (1249.0, 1250.0)}


def test_the_column_does_not_cross_the_network(spark):
    """What is shuffled for one target: counts and the values of its interval."""
    df = spark.range(100_000).select(F.rand(1).alias("v"))
    lo, hi = 0.499, 0.501
    counts = selection._targets(df, [], [{"lo": lo, "hi": hi, "t": 0}]).groupBy("t", "v").count()
    assert counts.count() < 0.01 * 100_000
    assert FE.exact_quantiles(df.where("v > 2"), "v", [0.5]).count() == 0
