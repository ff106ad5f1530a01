from pyspark.sql import functions as F

from featpipe.operators import splits


def test_stratified_split_is_partition_and_proportional(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = splits.stratified_split(df, "y", "id")
    assert s.count() == 1000
    per = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    # rows 1..n per class; rn % 10 < 8 -> training
    n1, n0 = 334, 666
    assert per[(1, "training")] == sum(1 for i in range(1, n1 + 1) if i % 10 < 8)
    assert per[(0, "training")] == sum(1 for i in range(1, n0 + 1) if i % 10 < 8)


def test_hash_split_stable_per_entity(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("user"), F.col("id"))
    s = splits.hash_split(df, "user", (7, 2, 1))
    assert s.groupBy("user").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert {r["split"] for r in s.select("split").distinct().collect()} <= {"training", "validation", "test"}


def test_random_split_exact_sizes(spark):
    df = spark.range(1234).select("id")
    s = splits.random_split_exact(df, "id", 0.2, 42)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["validation"] == int(1234 * 0.2)
    assert counts["training"] == 1234 - int(1234 * 0.2)


def test_training_stats_use_training_rows_only(spark):
    df = spark.createDataFrame([(1, 1.0, "training"), (2, 3.0, "training"), (3, 100.0, "validation")],
                               "id int, x double, split string")
    st = splits.training_stats(df, ["x"])
    assert st["x"][0] == 2.0


def test_hash_split_xxhash64_option(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("user"))
    s = splits.hash_split(df, "user", (8, 2), method="xxhash64")
    assert s.groupBy("user").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    share = s.where("split = 'training'").count() / 2000
    assert 0.6 < share < 0.95
