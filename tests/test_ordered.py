"""Range-split window results equal the plain single-window results, also with a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from featpipe.plans import ordered


def _data(spark, n=3000):
    # one key holds about a third of the rows; values repeat; some NULL values
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 17).cast("string")))
        .alias("k"),
        ((F.col("id") * 7919) % 101).cast("double").alias("v"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 13).alias("nv"),
    )


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_row_number_matches_window(spark):
    d = _data(spark)
    got = ordered.row_number(d, ["k"], ["id"], "rn", n_buckets=7)
    w = Window.partitionBy("k").orderBy("id")
    exp = d.withColumn("rn", F.row_number().over(w))
    assert _rows(got, ["id", "rn"]) == _rows(exp, ["id", "rn"])


def test_global_row_number_with_tie_breaker(spark):
    d = _data(spark)
    got = ordered.row_number(d, [], ["v", "id"], "rn", n_buckets=5)
    exp = d.withColumn("rn", F.row_number().over(Window.orderBy("v", "id")))
    assert _rows(got, ["id", "rn"]) == _rows(exp, ["id", "rn"])


def test_running_sum_min_max(spark):
    d = _data(spark)
    specs = [("s", "sum", "nv", True), ("mn", "min", "v", False), ("mx", "max", "nv", True), ("c", "count", "nv", False)]
    got = ordered.running(d, ["k"], ["id"], specs, n_buckets=6)
    w = Window.partitionBy("k").orderBy("id")
    inc = w.rowsBetween(Window.unboundedPreceding, 0)
    exc = w.rowsBetween(Window.unboundedPreceding, -1)
    exp = d.select("*", F.sum("nv").over(inc).alias("s"), F.min("v").over(exc).alias("mn"),
                   F.max("nv").over(inc).alias("mx"), F.count("nv").over(exc).alias("c"))
    cols = ["id", "s", "mn", "mx", "c"]
    assert _rows(got, cols) == _rows(exp, cols)


def test_lag_matches_window(spark):
    d = _data(spark)
    got = ordered.lag(d, ["k"], ["v", "id"], "nv", "prev", n_buckets=9)
    exp = d.withColumn("prev", F.lag("nv").over(Window.partitionBy("k").orderBy("v", "id")))
    assert _rows(got, ["id", "prev"]) == _rows(exp, ["id", "prev"])


def test_dense_index_strings_null_last(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "x string")
    got = {r["x"]: r["idx"] for r in ordered.dense_index(df, "x", "idx", n_buckets=3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, None: 3}


def test_bucketing_spans_hot_key(spark):
    d = _data(spark)
    b = ordered.with_buckets(d, "id", 8)
    assert b.where(F.col("k") == "hot").select("_fp_bucket").distinct().count() >= 6


def test_date_and_timestamp_keys_with_nulls(spark):
    import datetime as dt

    rows = [(i, None if i % 7 == 0 else dt.date(2024, 1, 1 + i % 3),
             None if i % 5 == 0 else dt.datetime(2024, 1, 1, i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, d date, t timestamp_ntz")
    for key in ("d", "t"):
        got = ordered.row_number(df, [key], ["id"], "rn", n_buckets=5)
        exp = df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("id")))
        assert _rows(got, ["id", "rn"]) == _rows(exp, ["id", "rn"])
