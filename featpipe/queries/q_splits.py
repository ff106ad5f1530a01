"""Split queries (SPL1-SPL6, WIN1) on orders and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from featpipe.functions.columns import round_to
from featpipe.operators import splits
from featpipe.queries import query
from featpipe.sources.tables import read_table

# Flagship (SPL6): orders -> drop NULL inputs -> stratified 80/20 split by status ordered by
# o_orderkey -> mean/std from training rows only -> scaled features + target + split.
FLAGSHIP_FEATURES = ["o_totalprice", "order_day", "priority_level"]


def orders_features(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("order_day"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority_level"),
    )


FLAGSHIP_ORACLE = """
WITH base AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS order_day,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_level
  FROM orders),
split_data AS (
  SELECT *, CASE WHEN MOD(ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 10) < 8
                 THEN 'training' ELSE 'validation' END AS split
  FROM base
  WHERE o_totalprice IS NOT NULL AND order_day IS NOT NULL AND priority_level IS NOT NULL
    AND o_orderstatus IS NOT NULL),
train_stats AS (
  SELECT AVG(o_totalprice) AS p_mean, STDDEV(o_totalprice) AS p_std,
         AVG(order_day) AS d_mean, STDDEV(order_day) AS d_std,
         AVG(priority_level) AS l_mean, STDDEV(priority_level) AS l_std
  FROM split_data WHERE split = 'training')
SELECT o_orderkey,
       round((o_totalprice - p_mean) / NULLIF(p_std, 0), 6) AS totalprice_z,
       round((order_day - d_mean) / NULLIF(d_std, 0), 6) AS order_day_z,
       round((priority_level - l_mean) / NULLIF(l_std, 0), 6) AS priority_z,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target,
       split
FROM split_data CROSS JOIN train_stats
"""


@query("spl6_scaled_training_set", "SPL6 SPL1 SPL5 SPL7 WIN1 PRJ4", oracle=FLAGSHIP_ORACLE)
def spl6_scaled_training_set(spark, sf_dir):
    base = orders_features(spark, sf_dir)
    out = splits.scaled_training_set(
        base, FLAGSHIP_FEATURES, F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), "o_orderkey",
        "o_orderstatus", id_cols=["o_orderkey"],
        rename={"o_totalprice": "totalprice_z", "order_day": "order_day_z", "priority_level": "priority_z"},
    )
    return out.select("o_orderkey", *[round_to(c, 6).alias(c) for c in ["totalprice_z", "order_day_z", "priority_z"]],
                      "target", "split")


@query("spl1_stratified_split_orders", "SPL1 WIN1", oracle="""
SELECT o_orderkey, o_orderstatus,
       CASE WHEN MOD(ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 10) < 8
            THEN 'training' ELSE 'validation' END AS split
FROM orders
""")
def spl1_stratified_split_orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return splits.stratified_split(o, "o_orderstatus", "o_orderkey")


@query("win1_row_number_per_class", "WIN1", oracle="""
SELECT l_orderkey, l_linenumber, l_returnflag,
       ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
                          l_shipdate, l_extendedprice) AS rn
FROM lineitem
""")
def win1_row_number_per_class(spark, sf_dir):
    from featpipe.plans import ordered

    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    r = ordered.row_number(li, ["l_returnflag"],
                           ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
                           "rn")
    return r.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("rn").cast("bigint").alias("rn"))


@query("spl2_md5_hash_split_customer", "SPL2 SPL4", oracle="""
SELECT c_custkey,
       CASE WHEN CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 7 THEN 'training'
            WHEN CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 9 THEN 'validation'
            ELSE 'test' END AS split
FROM customer
""")
def spl2_md5_hash_split_customer(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    return splits.hash_split(c, "c_custkey", (7, 2, 1))


@query("spl4_split_table_sizes", "SPL4 SPL2", oracle="""
WITH s AS (
  SELECT CASE WHEN CAST(('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 8
              THEN 'training' ELSE 'validation' END AS split, o_totalprice
  FROM orders)
SELECT split, COUNT(*) AS n_rows, round(SUM(o_totalprice), 2) AS total_price FROM s GROUP BY split
""")
def spl4_split_table_sizes(spark, sf_dir):
    from featpipe.sources.files import scratch_path

    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    s = splits.hash_split(o, "o_custkey", (8, 2))
    path = scratch_path(spark, "orders_split_tables")
    splits.write_split_tables(s, path)  # one pass writes both tables
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count("*").alias("n_rows"), round_to(F.sum("o_totalprice"), 2).alias("total_price"))


@query("spl3_exact_random_split_sizes", "SPL3", oracle="""
SELECT 'validation' AS split, CAST(floor(COUNT(*) * 0.2) AS BIGINT) AS n_rows FROM orders
UNION ALL
SELECT 'training' AS split, CAST(COUNT(*) - floor(COUNT(*) * 0.2) AS BIGINT) AS n_rows FROM orders
""")
def spl3_exact_random_split_sizes(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    s = splits.random_split_exact(o, "o_orderkey", 0.2, 42)
    return s.groupBy("split").agg(F.count("*").alias("n_rows"))


@query("spl5_train_only_minmax", "SPL5 FEA16", oracle="""
WITH s AS (
  SELECT *, CASE WHEN MOD(ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey), 10) < 8
                 THEN 'training' ELSE 'validation' END AS split FROM orders),
st AS (SELECT MIN(o_totalprice) AS mn, MAX(o_totalprice) AS mx FROM s WHERE split = 'training')
SELECT o_orderkey, split, round((o_totalprice - mn) / NULLIF(mx - mn, 0), 6) AS totalprice_scaled
FROM s CROSS JOIN st
""")
def spl5_train_only_minmax(spark, sf_dir):
    from featpipe.operators import features

    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    s = splits.stratified_split(o, "o_orderstatus", "o_orderkey")
    state = features.fit_minmax_sql(s.where(F.col("split") == "training"), ["o_totalprice"])
    return s.select("o_orderkey", "split",
                    round_to(features.apply_minmax_sql(state, "o_totalprice"), 6).alias("totalprice_scaled"))
