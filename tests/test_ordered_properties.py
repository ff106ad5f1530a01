"""Property test: range-split running aggregates and lag equal Spark's plain windows for
random keys (with NULL keys and one hot key), random values and random range counts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from featpipe.plans import ordered

rows = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", None]),
              st.one_of(st.none(), st.integers(-50, 50))),
    min_size=1, max_size=120)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, buckets=st.integers(2, 9))
def test_running_and_lag_equal_plain_window(spark, data, buckets):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(data)], "id int, k string, v int")
    specs = [("rn", "count", "*", True), ("s", "sum", "v", True), ("mn", "min", "v", False), ("mx", "max", "v", True)]
    got = ordered.running(df, ["k"], ["id"], specs, n_buckets=buckets)
    got = ordered.lag(got, ["k"], ["id"], "v", "prev", n_buckets=buckets)
    w = Window.partitionBy("k").orderBy("id")
    inc, exc = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    exp = df.select("*", F.count(F.lit(1)).over(inc).alias("rn"), F.sum("v").over(inc).alias("s"),
                    F.min("v").over(exc).alias("mn"), F.max("v").over(inc).alias("mx"), F.lag("v").over(w).alias("prev"))
    cols = ["id", "rn", "s", "mn", "mx", "prev"]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == \
        sorted(tuple(r[c] for c in cols) for r in exp.collect())


groups_values = st.lists(
    st.tuples(st.sampled_from(["hot", "hot", "hot", "b", "c"]),
              st.one_of(st.none(), st.integers(-20, 20).map(float))),
    min_size=1, max_size=150)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=groups_values, buckets=st.integers(2, 7))
def test_exact_quantiles_equal_numpy(spark, data, buckets):
    import numpy as np

    from featpipe.operators import features as FE

    df = spark.createDataFrame(list(data), "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"p{i}"] for i in range(len(probs))]
           for r in FE.exact_quantiles(df, "v", probs, ["g"], [f"p{i}" for i in range(len(probs))],
                                       n_buckets=buckets).collect()}
    want = {}
    for g in {g for g, _ in data}:
        vals = [v for gg, v in data if gg == g and v is not None]
        if vals:
            want[g] = [float(np.quantile(vals, p)) for p in probs]  # linear interpolation
    assert set(got) == set(want)
    for g in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[g], want[g])), (g, got[g], want[g])
