"""Feature operator queries (FEA0-FEA21)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from featpipe.functions.columns import case_map, nullif_zero, round_to
from featpipe.functions.hashing import hash_bucket
from featpipe.operators import features as FE
from featpipe.operators import splits
from featpipe.operators.feature_graph import FeaturePipeline, apply_processors, fit_processors
from featpipe.plans import ordered
from featpipe.queries import query
from featpipe.sources.tables import read_table

_TRAIN_MD5 = "CAST(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 10 < 8"


def _r(df, digits=9):
    return df.select(*[round_to(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("fea3_standard_scaler_lineitem", "FEA3 FEA10", oracle="""
WITH s AS (SELECT AVG(l_quantity) AS mq, STDDEV(l_quantity) AS sq, AVG(l_extendedprice) AS mp,
                  STDDEV(l_extendedprice) AS sp, AVG(l_discount) AS md, STDDEV(l_discount) AS sd,
                  AVG(l_tax) AS mt, STDDEV(l_tax) AS st FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round((l_quantity - mq) / CASE WHEN sq IS NULL OR sq <= 1e-8 THEN 1 ELSE sq END, 9) AS l_quantity,
       round((l_extendedprice - mp) / CASE WHEN sp IS NULL OR sp <= 1e-8 THEN 1 ELSE sp END, 9) AS l_extendedprice,
       round((l_discount - md) / CASE WHEN sd IS NULL OR sd <= 1e-8 THEN 1 ELSE sd END, 9) AS l_discount,
       round((l_tax - mt) / CASE WHEN st IS NULL OR st <= 1e-8 THEN 1 ELSE st END, 9) AS l_tax
FROM lineitem, s
""")
def fea3_standard_scaler_lineitem(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    st = FE.fit_standard_scaler(li, cols, eps=FE.EPS)
    return _r(li.select("l_orderkey", "l_linenumber", *[FE.standard_scale(st, c).alias(c) for c in cols]))


@query("fea11_minmax_feature_range", "FEA11", oracle="""
WITH s AS (SELECT MIN(p_retailprice) AS mnp, MAX(p_retailprice) AS mxp, MIN(p_size) AS mns, MAX(p_size) AS mxs FROM part)
SELECT p_partkey,
       round((p_retailprice - mnp) / (CASE WHEN mxp - mnp <= 1e-8 THEN mnp + 1 ELSE mxp END - mnp) * 2.0 - 1.0, 9) AS p_retailprice,
       round((p_size - mns) / (CASE WHEN mxs - mns <= 1e-8 THEN mns + 1 ELSE mxs END - mns) * 2.0 - 1.0, 9) AS p_size
FROM part, s
""")
def fea11_minmax_feature_range(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    st = FE.fit_minmax(p, ["p_retailprice", "p_size"], (-1.0, 1.0))
    return _r(p.select("p_partkey", *[FE.minmax_scale(st, c).alias(c) for c in ["p_retailprice", "p_size"]]))


@query("fea12_robust_scaler", "FEA12 AGG5", oracle="""
WITH s AS (SELECT quantile_cont(l_extendedprice, 0.5) AS med,
                  quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
       round((l_extendedprice - med) / CASE WHEN iqr <= 1e-8 THEN 1 ELSE iqr END, 9) AS price_robust
FROM lineitem, s
""")
def fea12_robust_scaler(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    st = FE.fit_robust(li, ["l_extendedprice"])
    return _r(li.select("l_orderkey", "l_linenumber", "l_partkey",
                        FE.robust_scale(st, "l_extendedprice").alias("price_robust")))


@query("fea13_one_hot_event_type", "FEA13 FEA14", oracle="""
SELECT event_id,
       CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS event_type_click,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS event_type_error,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event_type_purchase,
       CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS event_type_signup,
       CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS event_type_view
FROM events
""")
def fea13_one_hot_event_type(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type")
    cats = FE.fit_categories(e, "event_type")
    return FE.one_hot(e, "event_type", cats, drop_input=True)


@query("fea13_one_hot_segment_train_fit", "FEA13 SPL5", oracle=f"""
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS c_mktsegment_AUTOMOBILE,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_mktsegment_BUILDING,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS c_mktsegment_FURNITURE,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS c_mktsegment_HOUSEHOLD,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS c_mktsegment_MACHINERY
FROM customer
""")
def fea13_one_hot_segment_train_fit(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    train = splits.hash_split(c, "c_custkey", (8, 2)).where(F.col("split") == "training")
    return FE.one_hot(c, "c_mktsegment", FE.fit_categories(train, "c_mktsegment"), drop_input=True)


@query("fea15_median_impute_training", "FEA15 SPL5 PRJ3", oracle=f"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS disc,
                  CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS tax FROM lineitem),
m AS (SELECT quantile_cont(disc, 0.5) AS med FROM d WHERE {_TRAIN_MD5.format(k='l_orderkey')})
SELECT l_orderkey, l_linenumber, l_partkey, round(COALESCE(disc, med), 9) AS discount_imputed,
       COALESCE(tax, 0.0) AS tax_filled FROM d, m
""")
def fea15_median_impute_training(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    d = li.select("l_orderkey", "l_linenumber", "l_partkey", nullif_zero("l_discount").alias("disc"),
                  nullif_zero("l_tax").alias("tax"))
    train = splits.hash_split(d, "l_orderkey", (8, 2)).where(F.col("split") == "training")
    st = FE.fit_median_imputer(train, ["disc"])
    out = FE.impute_constant(d, {"tax": 0.0})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", round_to(FE.impute(st, "disc"), 9)
                      .alias("discount_imputed"), F.col("tax").alias("tax_filled"))


@query("fea15_drop_incomplete_rows", "FEA15", oracle="""
SELECT COUNT(*) AS rows_kept FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0
""")
def fea15_drop_incomplete_rows(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    d = li.select(nullif_zero("l_discount").alias("disc"), nullif_zero("l_tax").alias("tax"))
    return FE.drop_incomplete(d, ["disc", "tax"]).agg(F.count("*").alias("rows_kept"))


@query("fea4_hash_bucket_numeric", "FEA4", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey, ((l_partkey % 1000) + 1000) % 1000 AS part_bucket FROM lineitem
""")
def fea4_hash_bucket_numeric(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     hash_bucket("l_partkey", 1000, li.schema["l_partkey"].dataType).alias("part_bucket"))


@query("fea4_hash_bucket_string_blake2b", "FEA4")
def fea4_hash_bucket_string_blake2b(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", hash_bucket("c_name", 1000, method="blake2b").alias("name_bucket"),
                    hash_bucket("c_mktsegment", 16, method="blake2b").alias("segment_bucket"))


def event_sequences(spark, sf_dir, n=None):
    """Event ids per user in (ts, event_id) order: all of them, or the operator's first ``n``.

    ``row_number() <= n`` lets Spark cut every task to n rows per user before the shuffle
    (a window group limit), so a user with a billion events ships n rows."""
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    if n is not None:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
    seq = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("s"))
    return seq.select("user_id", F.transform("s", lambda x: x["event_id"]).alias("ids"))


@query("fea5_hash_and_pad_sequences", "FEA5", oracle="""
WITH seq AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id)
SELECT user_id, list_slice(list_concat(list_transform(ids, lambda x: ((x % 100) + 100) % 100),
                                       [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]), 1, 12) AS hashed
FROM seq
""")
def fea5_hash_and_pad_sequences(spark, sf_dir):
    s = event_sequences(spark, sf_dir, n=12)  # the operator's max_length: later items never enter its result
    return s.select("user_id", FE.hash_and_pad("ids", 100, 12, 0, numeric=True).alias("hashed"))


@query("fea6_sequence_shift", "FEA6", oracle="""
WITH seq AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id)
SELECT user_id,
       CASE WHEN len(ids) = 0 THEN ids ELSE list_concat(list_slice(ids, 2, len(ids)), [0]) END AS shifted_left,
       CASE WHEN len(ids) = 0 THEN ids ELSE list_concat([9], list_slice(ids, 1, len(ids) - 1)) END AS shifted_right
FROM seq
""")
def fea6_sequence_shift(spark, sf_dir):
    s = event_sequences(spark, sf_dir)
    return s.select("user_id", FE.sequence_shift("ids", "left", 0).alias("shifted_left"),
                    FE.sequence_shift("ids", "right", 9).alias("shifted_right"))


@query("fea6_sequence_shift_by_rows", "FEA6 WIN3", oracle="""
SELECT user_id, event_id, COALESCE(LEAD(event_id) OVER w, 0) AS next_id, COALESCE(LAG(event_id) OVER w, 9) AS previous_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def fea6_sequence_shift_by_rows(spark, sf_dir):
    """The shift without arrays: a user's sequence may be longer than a row can hold."""
    e = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    split = ordered.plan_split(e, ["user_id"], "ts")
    x = ordered.lead(e, ["user_id"], ["ts", "event_id"], "event_id", "next_id", split=split)
    x = ordered.lag(x, ["user_id"], ["ts", "event_id"], "event_id", "previous_id", split=split)
    return x.select("user_id", "event_id", F.coalesce("next_id", F.lit(0)).alias("next_id"),
                    F.coalesce("previous_id", F.lit(9)).alias("previous_id"))


@query("fea8_label_encode_unseen_names", "FEA7 FEA8 FEA20 WIN2", oracle=f"""
WITH train AS (SELECT DISTINCT c_name FROM customer WHERE {_TRAIN_MD5.format(k='c_custkey')}),
vocab AS (SELECT c_name, ROW_NUMBER() OVER (ORDER BY c_name NULLS LAST) - 1 AS idx FROM train)
SELECT c.c_custkey, COALESCE(v.idx, (SELECT COUNT(*) FROM vocab)) AS name_idx
FROM customer c LEFT JOIN vocab v ON c.c_name IS NOT DISTINCT FROM v.c_name
""")
def fea8_label_encode_unseen_names(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    train = splits.hash_split(c, "c_custkey", (8, 2)).where(F.col("split") == "training")
    vocab = FE.fit_label_encoder(train, "c_name")
    return FE.label_encode(c, "c_name", vocab, out="name_idx").select("c_custkey", "name_idx")


@query("fea8_label_encode_frequent_null", "FEA7 FEA8 JN5", oracle="""
WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_orderkey END AS known_order
           FROM lineitem),
vocab AS (SELECT known_order, ROW_NUMBER() OVER (ORDER BY known_order NULLS LAST) - 1 AS idx
          FROM (SELECT DISTINCT known_order FROM k WHERE l_returnflag <> 'R'))
SELECT k.l_orderkey, k.l_linenumber, COALESCE(v.idx, (SELECT COUNT(*) FROM vocab)) AS order_idx
FROM k LEFT JOIN vocab v ON k.known_order IS NOT DISTINCT FROM v.known_order
""")
def fea8_label_encode_frequent_null(spark, sf_dir):
    known = F.when(F.col("l_returnflag") != "N", F.col("l_orderkey"))
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", known.alias("known_order"))
    vocab = FE.fit_label_encoder(lines.where(F.col("l_returnflag") != "R"), "known_order")
    out = FE.label_encode(lines, "known_order", vocab, out="order_idx", limit=1024)  # the dictionary is never broadcast here
    return out.select("l_orderkey", "l_linenumber", "order_idx")


@query("fea17_target_encoding_frequent_part", "FEA17 JN5", oracle="""
WITH k AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_partkey END AS part,
                  CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS y, l_linenumber <= 3 AS train FROM lineitem),
g AS (SELECT AVG(y) AS g FROM k WHERE train),
m AS (SELECT part, COUNT(*) AS n, SUM(y) AS s FROM k WHERE train GROUP BY part)
SELECT k.l_orderkey, k.l_linenumber, round(COALESCE((m.s + 5.0 * g.g) / (m.n + 5.0), g.g), 9) AS part_te
FROM k CROSS JOIN g LEFT JOIN m ON k.part = m.part
""")
def fea17_target_encoding_frequent_part(spark, sf_dir):
    part = F.when(F.col("l_returnflag") == "N", F.lit(0)).otherwise(F.col("l_partkey"))
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", part.alias("part"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("y"))
    enc = FE.fit_target_encoder(lines.where("l_linenumber <= 3"), "part", "y", smoothing=5.0)
    out = FE.target_encode(lines, enc, "part_te", limit=1024)  # the table of parts is never broadcast here
    return out.select("l_orderkey", "l_linenumber", round_to("part_te", 9).alias("part_te"))


# fixed value mapping (FEA9): order priority text -> level
PRIORITY_LEVELS = {"5-LOW": 0, "4-NOT SPECIFIED": 1, "3-MEDIUM": 2, "2-HIGH": 3, "1-URGENT": 4}


@query("fea9_map_encoding_priority", "FEA9", oracle="""
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2
                        WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 ELSE -1 END AS priority_level
FROM orders
""")
def fea9_map_encoding_priority(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", case_map("o_orderpriority", PRIORITY_LEVELS, -1).alias("priority_level"))


@query("fea17_target_encoding_segment", "FEA17 SPL5", oracle=f"""
WITH j AS (SELECT o.o_orderkey, c.c_mktsegment, CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
                  {_TRAIN_MD5.format(k='o.o_orderkey')} AS is_train
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
g AS (SELECT AVG(y) AS gm FROM j WHERE is_train),
st AS (SELECT c_mktsegment, COUNT(y) AS n, AVG(y) AS m FROM j WHERE is_train GROUP BY 1)
SELECT j.o_orderkey, round(CASE WHEN st.n IS NULL THEN gm ELSE (st.n * st.m + 10.0 * gm) / (st.n + 10.0) END, 9)
       AS segment_te
FROM j LEFT JOIN st ON j.c_mktsegment = st.c_mktsegment, g
""")
def fea17_target_encoding_segment(spark, sf_dir):
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", "c_mktsegment", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))
    train = splits.hash_split(j, "o_orderkey", (8, 2)).where(F.col("split") == "training")
    enc = FE.fit_target_encoder(train, "c_mktsegment", "y", smoothing=10.0)
    return _r(FE.target_encode(j, enc, "segment_te").select("o_orderkey", "segment_te"))


@query("fea21_processor_chain", "FEA21 FEA18 FEA10 FEA11", oracle="""
WITH s1 AS (SELECT AVG(p_retailprice) AS m, STDDEV(p_retailprice) AS sd FROM part),
z AS (SELECT p_partkey, (p_retailprice - m) / CASE WHEN sd IS NULL OR sd <= 1e-8 THEN 1 ELSE sd END AS zp, p_size
      FROM part, s1),
s2 AS (SELECT MIN(zp) AS mn, MAX(zp) AS mx, MIN(p_size) AS smn, MAX(p_size) AS smx FROM z)
SELECT p_partkey, round((zp - mn) / (mx - mn), 9) AS p_retailprice, round((p_size - smn) / (smx - smn), 9) AS p_size
FROM z, s2
""")
def fea21_processor_chain(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    states = fit_processors(p, [("ZScore", ["p_retailprice"], {}),
                                ("MinMaxNormalization", ["p_retailprice", "p_size"], {})])
    return _r(apply_processors(p, states))


FEATURE_SPEC = {
    "ops": [
        {"op": "transform.assemble_vector", "inputs": {"columns": ["o_totalprice", "o_shippriority_num"]},
         "output": "tensors.x"},
        {"op": "inspect.feature_stats", "inputs": {"tensor": "tensors.x"}, "output": "vars.n_features"},
        {"op": "fit.standard_scaler", "inputs": {"x": "tensors.x"}, "output": "states.scaler"},
        {"op": "transform.standard_scaler", "inputs": {"x": "tensors.x", "state": "states.scaler"},
         "output": "tensors.x_scaled"},
        {"op": "fit.label_encoder", "inputs": {"x": "o_orderpriority"}, "output": "states.prio_vocab"},
        {"op": "transform.label_encode", "inputs": {"x": "o_orderpriority", "state": "states.prio_vocab"},
         "output": "tensors.prio_idx"},
        {"op": "transform.hash_bucket", "inputs": {"x": "o_custkey", "num_buckets": 100},
         "output": "tensors.cust_bucket"},
    ],
    "outputs": ["tensors.x_scaled", "tensors.prio_idx", "tensors.cust_bucket"],
}


@query("fea0_feature_pipeline_spec", "FEA0 FEA1 FEA2 FEA3 FEA7 FEA8 FEA4 FEA22", oracle="""
WITH x AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_totalprice AS FLOAT) AS a,
                  CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS FLOAT) AS b FROM orders),
s AS (SELECT AVG(a) AS ma, STDDEV(a) AS sa, AVG(b) AS mb, STDDEV(b) AS sb FROM x),
v AS (SELECT o_orderpriority, ROW_NUMBER() OVER (ORDER BY o_orderpriority) - 1 AS idx
      FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT x.o_orderkey, [round((a - ma) / sa, 6), round((b - mb) / sb, 6)] AS x_scaled, v.idx AS prio_idx,
       ((o_custkey % 100) + 100) % 100 AS cust_bucket
FROM x JOIN v ON x.o_orderpriority = v.o_orderpriority, s
""")
def fea0_feature_pipeline_spec(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").withColumn(
        "o_shippriority_num", F.substring("o_orderpriority", 1, 1).cast("int"))
    out, states, vars_ = FeaturePipeline(FEATURE_SPEC).run(o, training=True, keep=["o_orderkey"])
    return out.select("o_orderkey", F.transform("x_scaled", lambda v: round_to(v, 6)).alias("x_scaled"),
                      "prio_idx", "cust_bucket")


@query("fea13_one_hot_sparse_brand", "FEA13 FEA7 FEA8", oracle=f"""
WITH train AS (SELECT DISTINCT p_brand FROM part WHERE {_TRAIN_MD5.format(k='p_partkey')} AND p_brand IS NOT NULL),
v AS (SELECT p_brand, ROW_NUMBER() OVER (ORDER BY p_brand) - 1 AS idx FROM train)
SELECT p.p_partkey,
       list_transform(range((SELECT COUNT(*) FROM v)),
                      lambda i: CASE WHEN i = v.idx THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)
         AS brand_onehot
FROM part p LEFT JOIN v ON p.p_brand = v.p_brand
""")
def fea13_one_hot_sparse_brand(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    train = splits.hash_split(p, "p_partkey", (8, 2)).where(F.col("split") == "training")
    vocab = FE.fit_label_encoder(train.where(F.col("p_brand").isNotNull()), "p_brand", include_null=False)
    enc = FE.one_hot_sparse(p, "p_brand", vocab, "brand_vec")
    return enc.select("p_partkey", vector_to_array("brand_vec").alias("brand_onehot"))


@query("fea17_target_encoding_order_value", "FEA17 SPL5", oracle=f"""
WITH j AS (SELECT o.o_orderkey, c.c_mktsegment, o.o_totalprice AS y,
                  {_TRAIN_MD5.format(k='o.o_orderkey')} AS is_train
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
g AS (SELECT SUM(y) / COUNT(y) AS gm FROM j WHERE is_train),
st AS (SELECT c_mktsegment, COUNT(y) AS n, SUM(y) / COUNT(y) AS m FROM j WHERE is_train GROUP BY 1)
SELECT j.o_orderkey, round(CASE WHEN st.n IS NULL THEN gm ELSE (st.n * st.m + 25.0 * gm) / (st.n + 25.0) END, 4)
       AS segment_value_te
FROM j LEFT JOIN st ON j.c_mktsegment = st.c_mktsegment, g
""")
def fea17_target_encoding_order_value(spark, sf_dir):
    """Regression target: each market segment encoded by its smoothed mean order value."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment", F.col("o_totalprice").alias("y"))
    train = splits.hash_split(j, "o_orderkey", (8, 2)).where(F.col("split") == "training")
    enc = FE.fit_target_encoder(train, "c_mktsegment", "y", smoothing=25.0)
    out = FE.target_encode(j, enc, "segment_value_te").select("o_orderkey", "segment_value_te")
    return out.select("o_orderkey", round_to("segment_value_te", 4).alias("segment_value_te"))


@query("fea5_role_sequences_conversations", "FEA5 FEA7 FEA8", oracle="""
WITH v AS (SELECT role, ROW_NUMBER() OVER (ORDER BY role) - 1 AS idx
           FROM (SELECT DISTINCT role FROM conversations WHERE role IS NOT NULL)),
s AS (SELECT c.conv_id, list_slice(list(v.idx ORDER BY c.turn), 1, 6) AS ids
      FROM conversations c JOIN v ON c.role = v.role GROUP BY c.conv_id)
SELECT conv_id, list_slice(list_concat(list_transform(ids, lambda x: ((x % 10) + 10) % 10), [0, 0, 0, 0, 0, 0]), 1, 6)
       AS role_seq
FROM s
""")
def fea5_role_sequences_conversations(spark, sf_dir):
    """Each conversation's first 6 turns as role indices, hashed and padded to length 6."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    vocab = FE.fit_label_encoder(conv.where(F.col("role").isNotNull()), "role", include_null=False)
    enc = FE.label_encode(conv.where(F.col("role").isNotNull()), "role", vocab, out="role_idx")
    w = Window.partitionBy("conv_id").orderBy("turn")
    top = enc.select("conv_id", "turn", "role_idx", F.row_number().over(w).alias("rn")).where(F.col("rn") <= 6)
    seq = top.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rn", "role_idx"))).alias("s"))
    ids = F.transform("s", lambda x: x["role_idx"])
    return seq.select("conv_id", FE.hash_and_pad(ids, 10, 6, 0, numeric=True).alias("role_seq"))
