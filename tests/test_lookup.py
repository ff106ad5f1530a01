"""Lookups in tables of any size: results equal a plain join, frequent values stay out of the shuffle."""

import pytest
from pyspark.sql import functions as F

from featpipe.operators import features as FE
from featpipe.operators import lookup, scoring


def skewed(spark, n=40_000):
    """Half of the rows hold one text, a sixth NULL, the others a value each; repeated rows and clashing names included."""
    i = F.col("id")
    key = F.when(i % 2 == 0, F.lit("often")).when(i % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), i.cast("string")))
    return spark.range(0, n, 1, 8).select((i % 1000).alias("value"), key.alias("key"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("null_safe", [True, False])
def test_all_routes_give_the_plain_join(spark, null_safe):
    df = skewed(spark, 6_000)
    table = df.select("key").distinct().where("key IS NULL OR key <> 'k1'").select(F.col("key").alias("t_key"), F.length("key").alias("t_len"))
    same = df["key"].eqNullSafe(table["t_key"]) if null_safe else df["key"] == table["t_key"]
    want = rows(df.join(table, same, "left").select("value", "key", "t_len"))
    for limit in (1 << 20, 500, 10, -1):  # all broadcast, frequent rows only, not even these, none
        assert rows(lookup.look_up(df, "key", table, "t_key", 100_000, 12, null_safe, limit)) == want


def test_frequent_values_are_not_shuffled(spark):
    df = skewed(spark)
    table = df.select(F.col("key").alias("t_key")).distinct().withColumn("t_n", F.length("t_key")).checkpoint()
    out = lookup.look_up(df, "key", table, "t_key", 1 << 30, 12, limit=4096)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2 and "strategy=broadcast" in plan
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 40_000
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]  # one task of a plain join would hold half of all rows
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_frequent_hashes(spark):
    df = skewed(spark)
    got = lookup.frequent_hashes(df, F.col("key"), 4)
    want = df.select(F.xxhash64(F.lit("often")), F.xxhash64(F.lit(None).cast("string"))).first()
    assert sorted(got) == sorted(want)
    assert lookup.frequent_hashes(df.limit(0), F.col("key"), 4) == []


def test_key_types_may_differ(spark):
    df = spark.range(2_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("int").alias("idx"))
    table = spark.range(5, 1_500).select(F.col("id").alias("t"), (F.col("id") * 2).alias("v"))
    got = lookup.look_up(df, "idx", table, "t", 1 << 30, 16, limit=1024)
    assert rows(got) == rows(df.join(table, df["idx"] == table["t"], "left").select("idx", "v"))


def test_zero_and_negative_zero_are_one_key(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)] * 500 + [(float(i),) for i in range(1, 300)], "x double")
    table = spark.createDataFrame([(float(i), i) for i in range(300)], "t double, v int")
    got = lookup.look_up(df, "x", table, "t", 1 << 30, 16, limit=1024)
    assert got.where("v = 0").count() == 1000 and got.where("v IS NULL").count() == 0


def test_encoders_beyond_the_limit(spark):
    df = skewed(spark, 6_000)
    vocab = FE.fit_label_encoder(df.where("key IS NULL OR key <> 'k1'"), "key")
    assert rows(FE.label_encode(df, "key", vocab, limit=1024)) == rows(FE.label_encode(df, "key", vocab))
    with pytest.raises(FE.FeatureError, match="k1"):
        FE.label_encode(df, "key", vocab, handle_unknown="error", limit=1024)
    enc = FE.fit_target_encoder(df.where("value < 500"), "key", "value", smoothing=3.0)
    assert rows(FE.target_encode(df, enc, limit=1024)) == rows(FE.target_encode(df, enc))
    empty = df.limit(0)
    assert FE.label_encode(empty, "key", vocab, limit=1024).count() == 0


def test_embedding_of_frequent_and_missing_indexes(spark):
    df = spark.range(4_000).select(F.when(F.col("id") % 3 == 0, 2).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).alias("idx"))
    table = spark.range(3_000).select(F.col("id").alias("i"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    got = scoring.embedding_lookup(df, "idx", table, "i", "vec", "emb", 2, limit=1024)
    for r in got.collect():
        inside = r["idx"] is not None and r["idx"] < 3_000
        assert r["emb"] == ([float(r["idx"]), 1.0] if inside else [0.0, 0.0])
    assert got.count() == 4_000


def test_many_categories_become_a_sparse_vector_by_default(spark):
    from featpipe.operators.feature_graph import fit_processors

    df = spark.range(1_200).select(F.concat(F.lit("c"), "id").alias("c"))
    st, = fit_processors(df, [("onehot", ["c"], {})])
    assert isinstance(st["params"]["c"], FE.Vocabulary)
    v = FE.one_hot_sparse(df.where("c = 'c7'"), "c", st["params"]["c"]).first()["c_onehot"]
    assert v.size == 1_200 and list(v.values) == [1.0]
    new = spark.createDataFrame([("unseen",), (None,)], "c string")
    assert [r["c_onehot"].numNonzeros() for r in FE.one_hot_sparse(new, "c", st["params"]["c"]).collect()] == [0, 0]
    with pytest.raises(FE.FeatureError, match="unseen"):
        FE.one_hot_sparse(new, "c", st["params"]["c"], handle_unknown="error")
    with pytest.raises(FE.FeatureError):
        fit_processors(df, [("onehot", ["c"], {"sparse": False})])
