"""Projection, filter, scalar SQL, joins, aggregates, windows and sorts used by pipelines
(PRJ*, JN*, AGG*, WIN2-4, SRT*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featpipe.functions import columns as C
from featpipe.operators import features, relational
from featpipe.plans import ordered
from featpipe.queries import query
from featpipe.sources.tables import read_table


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


# ---------------------------------------------------------------- projection / filter / scalar

@query("prj1_projection_filter_lineitem", "PRJ1 PRJ2 PRJ13", oracle="""
SELECT l_orderkey, l_linenumber,
       round(l_extendedprice * (1 - l_discount), 4) AS net_price,
       round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS gross_price,
       round(0.2 * l_quantity + 0.4 * l_discount + 0.4 * l_tax, 6) AS weighted_score
FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity > 10 AND l_shipdate IS NOT NULL
""")
def prj1_projection_filter_lineitem(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 10) & F.col("l_shipdate").isNotNull()) \
        .select("l_orderkey", "l_linenumber", C.round_to(net, 4).alias("net_price"),
                C.round_to(net * (1 + F.col("l_tax")), 4).alias("gross_price"),
                C.round_to(C.weighted_sum({"l_quantity": 0.2, "l_discount": 0.4, "l_tax": 0.4}), 6).alias("weighted_score"))


@query("prj3_case_nullif_coalesce", "PRJ3 PRJ4 PRJ5 FEA14", oracle="""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS qty_bin,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS discount_or_null,
       COALESCE(CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END, -1.0) AS tax_filled,
       round(CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END, 6) AS tax_per_discount,
       CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS flag_a,
       CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS flag_n,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag_r
FROM lineitem
""")
def prj3_case_nullif_coalesce(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        C.bin_by("l_quantity", [10, 30], ["small", "medium", "large"]).alias("qty_bin"),
        C.nullif_zero("l_discount").alias("discount_or_null"),
        F.coalesce(C.nullif_zero("l_tax"), F.lit(-1.0)).alias("tax_filled"),
        C.round_to(C.safe_divide("l_tax", "l_discount"), 6).alias("tax_per_discount"),
        *[F.when(F.col("l_returnflag") == v, 1).otherwise(0).alias(f"flag_{v.lower()}") for v in ("A", "N", "R")],
    )


@query("prj6_cast_substring_month_key", "PRJ6 PRJ7 PRJ8", oracle="""
SELECT o_orderkey,
       CAST(o_orderdate AS DATE) AS order_date,
       CAST(o_totalprice AS DECIMAL(18, 2)) AS price_dec,
       substr(o_orderpriority, 1, 1) || '-' || o_orderstatus AS prio_status,
       substr(CAST(o_orderdate AS VARCHAR), 1, 7) AS month_key,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio_num,
       CAST(o_custkey AS VARCHAR) || '' AS cust_text
FROM orders
""")
def prj6_cast_substring_month_key(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price_dec"),
        F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"), F.col("o_orderstatus")).alias("prio_status"),
        C.month_key("o_orderdate").alias("month_key"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("prio_num"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("")).alias("cust_text"),
    )


@query("prj9_datetime_parts_events", "PRJ9 PRJ10", oracle="""
SELECT event_id,
       CAST(EXTRACT(HOUR FROM ts) AS INTEGER) AS hour,
       CAST(EXTRACT(DOW FROM ts) AS INTEGER) AS dow,
       CAST(EXTRACT(MONTH FROM ts) AS INTEGER) AS month,
       CAST(EXTRACT(YEAR FROM ts) AS INTEGER) AS year,
       CAST(EXTRACT(DAY FROM ts) AS INTEGER) AS day,
       CASE WHEN EXTRACT(DOW FROM ts) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS value_group,
       CASE WHEN value > 20 THEN 1 ELSE 0 END AS high_value
FROM events
""")
def prj9_datetime_parts_events(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select(
        "event_id", F.hour("ts").alias("hour"), C.dow_sunday0("ts").alias("dow"), F.month("ts").alias("month"),
        F.year("ts").alias("year"), F.dayofmonth("ts").alias("day"), C.is_weekend("ts").alias("is_weekend"),
        C.bin_by("value", [10, 50], ["low", "mid", "high"]).alias("value_group"),
        (F.col("value") > 20).cast("int").alias("high_value"),
    )


@query("prj11_recency_filter", "PRJ11", oracle="""
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= CAST(DATE '1998-08-02' - INTERVAL 30 DAY AS TIMESTAMP) AND o_orderdate < TIMESTAMP '1998-08-02'
""")
def prj11_recency_filter(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return relational.recent(o, "o_orderdate", days=30, as_of="1998-08-02").select("o_orderkey", "o_orderdate")


@query("prj12_mod_buckets", "PRJ12", oracle="""
SELECT o_orderkey % 7 AS key_mod, MOD(o_custkey, 10) AS cust_mod, COUNT(*) AS n
FROM orders GROUP BY 1, 2
""")
def prj12_mod_buckets(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_orderkey") % 7).alias("key_mod"), (F.col("o_custkey") % 10).alias("cust_mod")) \
        .agg(F.count("*").alias("n"))


@query("prj14_json_props_explode", "PRJ14 TRK8", oracle="""
SELECT e.event_type, j.key AS prop, COUNT(*) AS n, round(AVG(CAST(j.value AS DOUBLE)), 6) AS avg_value
FROM events e, LATERAL (SELECT unnest(json_keys(e.props)) AS key) k,
     LATERAL (SELECT k.key AS key, json_extract(e.props, '$.' || k.key) AS value) j
GROUP BY 1, 2
""")
def prj14_json_props_explode(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    kv = e.select("event_type", F.explode(C.json_number_map("props")).alias("prop", "v"))
    return kv.groupBy("event_type", "prop").agg(F.count("*").alias("n"), C.round_to(F.avg("v"), 6).alias("avg_value"))


# ---------------------------------------------------------------- joins

@query("jn1_order_customer_nation", "JN1", oracle="""
SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name, o.o_totalprice
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def jn1_order_customer_nation(spark, sf_dir):
    o, c, n, r = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey) \
        .join(r, n.n_regionkey == r.r_regionkey).select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")


@query("jn2_customer_left_join_counts", "JN2 AGG1", oracle="""
SELECT c.c_custkey, COUNT(o.o_orderkey) AS n_orders, round(COALESCE(SUM(o.o_totalprice), 0), 2) AS total_spent
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY c.c_custkey
""")
def jn2_customer_left_join_counts(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    # aggregate orders per customer first (map-side combine), then one left join
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("s"))
    j = c.join(per, c.c_custkey == per.o_custkey, "left")
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"),
                    C.round_to(F.coalesce("s", F.lit(0.0)), 2).alias("total_spent"))


@query("jn3_zscore_with_stats_row", "JN3 JN4 FEA3", oracle="""
WITH s AS (SELECT AVG(c_acctbal) AS m, STDDEV(c_acctbal) AS sd FROM customer)
SELECT c_custkey, round((c_acctbal - m) / sd, 6) AS acctbal_z FROM customer CROSS JOIN s
""")
def jn3_zscore_with_stats_row(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    # the 1-row statistics table becomes scalar subqueries: no join at all in the plan
    stats = c.agg(F.avg("c_acctbal").alias("m"), F.stddev("c_acctbal").alias("sd"))
    return relational.apply_stats_row(c, stats, lambda s: (F.col("c_acctbal") - s["m"]) / s["sd"], "acctbal_z") \
        .select("c_custkey", C.round_to("acctbal_z", 6).alias("acctbal_z"))


@query("jn4_above_average_orders", "JN4", oracle="""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)
""")
def jn4_above_average_orders(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.where(F.col("o_totalprice") > o.agg(F.avg("o_totalprice")).scalar()).select("o_orderkey", "o_totalprice")


@query("jn5_dictionary_label_encoding", "JN5 WIN2 FEA7 FEA8", oracle="""
WITH d AS (SELECT p_brand, ROW_NUMBER() OVER (ORDER BY p_brand) - 1 AS brand_idx
           FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL))
SELECT p.p_partkey, p.p_brand, d.brand_idx FROM part p JOIN d ON p.p_brand = d.p_brand
""")
def jn5_dictionary_label_encoding(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    vocab = features.fit_label_encoder(p.where(F.col("p_brand").isNotNull()), "p_brand", include_null=False)
    enc = features.label_encode(p, "p_brand", vocab, out="brand_idx")
    return enc.where(F.col("p_brand").isNotNull())


@query("jn6_nation_region_ordered", "JN6", oracle="""
SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey ORDER BY r.r_name, n.n_name
""")
def jn6_nation_region_ordered(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name").orderBy("r_name", "n_name")


@query("jn7_dependent_row_removal", "JN7", oracle="""
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')
""")
def jn7_dependent_row_removal(spark, sf_dir):
    li, o = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    removed = o.where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey"))
    return relational.remove_dependents(li, removed, "l_orderkey", "o_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("src13_parquet_join_csv", "SRC13 SRC2", oracle="""
SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def src13_parquet_join_csv(spark, sf_dir):
    from featpipe.sources import files

    n = _t(spark, sf_dir, "nation")
    path = files.scratch_path(spark, "nation_csv")
    n.write.mode("overwrite").option("header", True).csv(path)
    ncsv = files.read_csv(spark, path, columns="n_nationkey INT, n_name STRING, n_regionkey INT", header=True)
    c = _t(spark, sf_dir, "customer")
    return c.join(ncsv, c.c_nationkey == ncsv.n_nationkey).select("c_custkey", "n_name")


# ---------------------------------------------------------------- aggregates

@query("agg1_user_event_stats", "AGG1", oracle="""
SELECT user_id, COUNT(*) AS n_events, round(SUM(value), 4) AS sum_value, round(AVG(value), 9) AS avg_value,
       MIN(value) AS min_value, MAX(value) AS max_value, round(STDDEV(value), 6) AS std_value,
       COUNT(DISTINCT event_type) AS n_types
FROM events GROUP BY user_id
""")
def agg1_user_event_stats(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.count("*").alias("n_events"), C.round_to(F.sum("value"), 4).alias("sum_value"),
        C.round_to(F.avg("value"), 9).alias("avg_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), C.round_to(F.stddev("value"), 6).alias("std_value"),
        F.count_distinct("event_type").alias("n_types"))


@query("agg2_count_distinct_customers", "AGG2", oracle="""
SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n_customers, COUNT(*) AS n_orders FROM orders GROUP BY 1
""")
def agg2_count_distinct_customers(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n_customers"),
                                          F.count("*").alias("n_orders"))


@query("agg3_having_frequent_customers", "AGG3", oracle="""
SELECT o_custkey, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 15
""")
def agg3_having_frequent_customers(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n_orders")).where(F.col("n_orders") >= 15)


@query("agg4_null_counts", "AGG4 PIP13", oracle="""
SELECT COUNT(*) AS total,
       CAST(SUM(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_discount,
       COUNT(*) FILTER (WHERE NULLIF(l_tax, 0) IS NULL) AS null_tax,
       COUNT(*) FILTER (WHERE l_shipdate IS NULL) AS null_shipdate
FROM lineitem
""")
def agg4_null_counts(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.agg(F.count("*").alias("total"),
                  F.sum(F.when(F.col("l_discount") == 0, 1).otherwise(0)).alias("zero_discount"),
                  F.count_if(C.nullif_zero("l_tax").isNull()).alias("null_tax"),
                  F.count_if(F.col("l_shipdate").isNull()).alias("null_shipdate"))


@query("agg5_exact_median_quartiles", "AGG5", oracle="""
SELECT event_type,
       round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75
FROM events GROUP BY event_type
""")
def agg5_exact_median_quartiles(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    q = features.exact_quantiles(e, "value", [0.25, 0.5, 0.75], ["event_type"])
    return q.select("event_type", *[C.round_to(c, 6).alias(c) for c in ("q25", "q50", "q75")])


@query("agg5_global_quantiles_lineitem", "AGG5", oracle="""
SELECT round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
       round(quantile_cont(l_extendedprice, 0.9), 6) AS q90
FROM lineitem
""")
def agg5_global_quantiles_lineitem(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    q = features.exact_quantiles(li, "l_extendedprice", [0.1, 0.5, 0.9])
    return q.select(*[C.round_to(c, 6).alias(c) for c in ("q10", "q50", "q90")])


@query("agg6_distinct_values_capped", "AGG6", oracle="""
SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL ORDER BY p_type LIMIT 100
""")
def agg6_distinct_values_capped(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return relational.distinct_values(p, "p_type", limit=100)


@query("agg7_customer_month_summary", "AGG7 PRJ8", oracle="""
SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n_orders,
       round(SUM(o_totalprice), 2) AS revenue, COUNT(DISTINCT o_orderpriority) AS n_priorities
FROM orders GROUP BY 1, 2 HAVING COUNT(*) >= 1
""")
def agg7_customer_month_summary(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", C.month_key("o_orderdate").alias("month")).agg(
        F.count("*").alias("n_orders"), C.round_to(F.sum("o_totalprice"), 2).alias("revenue"),
        F.count_distinct("o_orderpriority").alias("n_priorities"))


@query("agg8_status_counts_zero_filled", "AGG8 TRK9", oracle="""
WITH domain(status) AS (VALUES ('F'), ('O'), ('P'), ('X')),
     c AS (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1)
SELECT status, COALESCE(n, 0) AS n FROM domain LEFT JOIN c ON status = o_orderstatus
UNION ALL SELECT 'total' AS status, COUNT(*) AS n FROM orders
""")
def agg8_status_counts_zero_filled(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return relational.counts_over_domain(o, "o_orderstatus", ["F", "O", "P", "X"], out_key="status", total=True)


# ---------------------------------------------------------------- windows

@query("win2_dense_index_distinct_values", "WIN2 FEA7", oracle="""
SELECT p_type, ROW_NUMBER() OVER (ORDER BY p_type) - 1 AS idx FROM (SELECT DISTINCT p_type FROM part) t
""")
def win2_dense_index_distinct_values(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    v = ordered.dense_index(p, "p_type", "idx", nulls_last=True)
    return v.select("p_type", F.col("idx").cast("bigint").alias("idx"))


@query("win3_time_since_last_event", "WIN3", oracle="""
SELECT event_id, user_id,
       epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS micros_since_last
FROM events
""")
def win3_time_since_last_event(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    lagged = ordered.lag(e, ["user_id"], ["ts", "event_id"], "ts", "prev_ts")
    return lagged.select("event_id", "user_id", C.since_micros("ts", "prev_ts").alias("micros_since_last"))


@query("win4_value_change_per_user", "WIN4", oracle="""
SELECT event_id, round(value - LAG(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS value_change
FROM events
""")
def win4_value_change_per_user(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    lagged = ordered.lag(e, ["user_id"], ["ts", "event_id"], "value", "prev_value")
    return lagged.select("event_id", C.round_to(F.col("value") - F.col("prev_value"), 6).alias("value_change"))


@query("win3_lag_text_per_user", "WIN3 WIN4", oracle="""
SELECT event_id, event_type, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type
FROM events
""")
def win_plain_lag_per_user(spark, sf_dir):
    # LAG of a text column; same range-split plan as the numeric case
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "ts")
    return ordered.lag(e, ["user_id"], ["ts", "event_id"], "event_type", "prev_type").select(
        "event_id", "event_type", "prev_type")


# ---------------------------------------------------------------- sort / limit / set ops / sample

@query("srt1_top_k_newest", "SRT1 TRK3", oracle="""
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25
""")
def srt1_top_k_newest(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return o.orderBy(F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()).limit(25) \
        .select("o_orderkey", "o_orderdate", "o_totalprice")


@query("srt2_keyed_page", "SRT2", oracle="""
SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100
""")
def srt2_keyed_page(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return relational.page(c.select("c_custkey", "c_name"), ["c_custkey"], offset=100, limit=50)


@query("srt3_union_all_names_sorted", "SRT3", oracle="""
SELECT name, kind FROM (SELECT n_name AS name, 'nation' AS kind FROM nation
                        UNION ALL SELECT r_name AS name, 'region' AS kind FROM region) ORDER BY kind, name
""")
def srt3_union_all_names_sorted(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return n.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(
        r.select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))).orderBy("kind", "name")


@query("srt4_percentage_sample", "SRT4")
def srt4_percentage_sample(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.sample(withReplacement=False, fraction=0.1, seed=7).select("l_orderkey", "l_quantity")


@query("src11_table_columns_limit", "SRC11 PIP12", oracle="""
SELECT "c_custkey", "c_name" FROM customer ORDER BY c_custkey LIMIT 100
""")
def src11_table_columns_limit(spark, sf_dir):
    from featpipe.sources.tables import register_tables, table_columns

    register_tables(spark, sf_dir, ["customer"])
    return table_columns(spark, "customer", ["c_custkey", "c_name"], limit=100, order_by=["c_custkey"])
