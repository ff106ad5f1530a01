"""Queries whose results depend on the operator they name: round trips, cleaned rows, fitted models against SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from featpipe.functions.columns import round_to
from featpipe.functions.hashing import hash_bucket
from featpipe.operators import evaluation, features as FE, metrics as M, relational, scoring, splits
from featpipe.operators import tracking as TR
from featpipe.operators.feature_graph import FeaturePipeline, load_states, save_states
from featpipe.plans import gate
from featpipe.plans.steps import StepRunner, StepSpec
from featpipe.queries import query
from featpipe.queries.q_metrics import SCORED_CTE, reg_preds, scored_orders
from featpipe.sources import files
from featpipe.sources.tables import read_table, register_tables


def _r(df, digits=9):
    return df.select(*[round_to(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- files

@query("src1_read_csv_auto_file_list", "SRC1 PIP12", oracle="""
SELECT s_nationkey, COUNT(*) AS n, round(SUM(s_acctbal), 2) AS balance FROM supplier GROUP BY s_nationkey
""")
def src1_read_csv_auto_file_list(spark, sf_dir):
    """Two tab-separated folders read by one read_csv_auto list, the delimiter sniffed beside a given option."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    base = files.scratch_path(spark, "supplier_tsv")
    for i in (0, 1):
        s.where(F.col("s_suppkey") % 2 == i).write.option("header", True).option("sep", "\t").csv(f"{base}/{i}")
    df = gate.query(spark, f"SELECT s_nationkey, s_acctbal FROM read_csv_auto(['{base}/0', '{base}/1'], header=true)")
    return df.groupBy(F.col("s_nationkey").cast("int").alias("s_nationkey")).agg(
        F.count("*").alias("n"), round_to(F.sum("s_acctbal"), 2).alias("balance"))


@query("src2_read_csv_list_skip_encoding", "SRC2 SRC4", oracle="""
SELECT lang, COUNT(*) AS n, COUNT(DISTINCT source) AS sources, CAST(SUM(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang
""")
def src2_read_csv_list_skip_encoding(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("lang"), F.lit("é")).alias("lang"), "source", "n_chars")
    base = files.scratch_path(spark, "documents_csv")
    for i in (0, 1):
        d.where(F.col("doc_id") % 2 == i).write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{base}/{i}")
    got = files.read_csv(spark, [f"{base}/0", f"{base}/1"], columns="doc_id BIGINT, lang STRING, source STRING, n_chars BIGINT",
                         skip=1, encoding="ISO-8859-1")
    return got.groupBy(F.regexp_replace("lang", "é$", "").alias("lang")).agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


@query("src3_malformed_rows_report", "SRC3", oracle="""
SELECT COUNT(*) FILTER (WHERE o_orderkey % 7 = 0) AS bad_rows, COUNT(*) AS total_rows,
       COUNT(*) FILTER (WHERE o_orderkey % 7 <> 0) AS kept_rows FROM orders
""")
def src3_malformed_rows_report(spark, sf_dir):
    """Every seventh order is written with a price that is no number; quotes are single quotes."""
    o = read_table(spark, sf_dir, "orders")
    line = F.concat_ws(";", "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit("n;a")).otherwise(
        F.concat(F.lit("'"), F.col("o_totalprice").cast("string"), F.lit("'"))))
    path = files.scratch_path(spark, "orders_bad_csv")
    o.select(line).write.text(path)
    columns = "o_orderkey BIGINT, o_totalprice DOUBLE"
    kept = files.read_csv(spark, path, columns=columns, delim=";", quote="'", ignore_errors=True)
    report = files.malformed_rows(spark, path, columns, delim=";", quote="'")
    return report.select("bad_rows", "total_rows", kept.agg(F.count("*")).scalar().alias("kept_rows"))


@query("src6_json_list_auto", "SRC6", oracle="""
SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY c_mktsegment
""")
def src6_json_list_auto(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    base = files.scratch_path(spark, "customer_json")
    for i in (0, 1):
        c.where(F.col("c_custkey") % 2 == i).write.json(f"{base}/{i}")
    df = gate.query(spark, f"SELECT c_custkey, c_mktsegment FROM read_json(['{base}/0', '{base}/1'])")
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


# ---------------------------------------------------------------- pipelines

@query("pip7_dry_run_report", "PIP7", oracle="""
SELECT 'good' AS spec, TRUE AS ok, CAST(NULL AS VARCHAR) AS failing_step, (SELECT COUNT(*) FROM orders) AS rows_seen
UNION ALL SELECT 'bad column', FALSE, 'second', (SELECT COUNT(*) FROM orders)
""")
def pip7_dry_run_report(spark, sf_dir):
    register_tables(spark, sf_dir, ["orders"])
    runner = StepRunner(spark, files.scratch_path(spark, "dry_run"))

    def spec(column):
        return StepSpec.from_dict({"name": "d", "steps": [
            {"name": "first", "type": "table", "sql": "SELECT o_orderkey, o_totalprice FROM orders"},
            {"name": "second", "type": "view", "depends_on": ["first"], "sql": f"SELECT {column} FROM first"}], "outputs": ["second"]})

    out = None
    for name, column in (("good", "o_totalprice"), ("bad column", "o_price")):
        report, _ = runner.run(spec(column), count_outputs=False, dry_run=True)
        one = spark.table("orders").agg(F.count("*").alias("rows_seen")).select(
            F.lit(name).alias("spec"), F.lit(report.ok).alias("ok"), F.lit(report.failed_step).cast("string").alias("failing_step"), "rows_seen")
        out = one if out is None else out.unionByName(one)
    return out


@query("pip1_column_named_text", "PIP1 PIP12", oracle="""
SELECT doc_id, upper(lang) AS text, CAST(n_chars AS VARCHAR) AS size, 'AS TEXT' AS label FROM documents
""")
def pip1_column_named_text(spark, sf_dir):
    register_tables(spark, sf_dir, ["documents"])
    return gate.query(spark, "SELECT doc_id, upper(lang) AS text, CAST(n_chars AS TEXT) AS size, 'AS TEXT' AS label FROM documents;")


@query("spl2_multi_key_hash_split", "SPL2", oracle="""
SELECT split, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS keys FROM (
  SELECT l_orderkey, CASE WHEN b < 7 THEN 'training' WHEN b < 9 THEN 'validation' ELSE 'test' END AS split FROM (
    SELECT l_orderkey, CAST(('0x' || substr(md5(CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10 AS b
    FROM lineitem)) GROUP BY split
""")
def spl2_multi_key_hash_split(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    s = splits.hash_split(li, ["l_partkey", "l_suppkey"], (7, 2, 1))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("spl3_exact_split_members", "SPL3 WIN1", oracle="""
SELECT l_orderkey, CASE WHEN ROW_NUMBER() OVER (ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '|42'), l_orderkey)
                             <= floor(COUNT(*) OVER () * 0.2) THEN 'validation' ELSE 'training' END AS split
FROM (SELECT DISTINCT l_orderkey FROM lineitem)
""")
def spl3_exact_split_members(spark, sf_dir):
    keys = read_table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return splits.random_split_exact(keys, "l_orderkey", 0.2, 42, method="md5")


# ---------------------------------------------------------------- features

@query("fea13_one_hot_unseen_category", "FEA13 FEA14", oracle="""
SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS c_mktsegment_AUTOMOBILE,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS c_mktsegment_FURNITURE,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS c_mktsegment_HOUSEHOLD,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS c_mktsegment_MACHINERY
FROM customer
""")
def fea13_one_hot_unseen_category(spark, sf_dir):
    """Fitted without one segment: that segment gets no column, and its rows are all zeros."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    known = FE.fit_categories(c.where("c_mktsegment <> 'BUILDING'"), "c_mktsegment")
    return FE.one_hot(c, "c_mktsegment", known, drop_input=True)


PROCESSORS = {
    "feature_columns": ["o_totalprice", "o_custkey"],
    "target_columns": ["o_orderkey"],
    "processors": [
        {"name": "raw", "op": "transform.assemble_vector", "inputs": {"columns": "feature_columns"}, "outputs": {"tensors.x": "output"}},
        {"name": "width", "op": "inspect.feature_stats", "train_only": True, "inputs": {"tensor": "tensors.x"}, "outputs": {"vars.n": "n_features"}},
        {"name": "fit", "op": "fit.standard_scaler", "train_only": True, "inputs": {"x": "tensors.x"}, "outputs": {"states.first": "state"}},
        {"name": "scale", "op": "transform.standard_scaler", "inputs": {"x": "tensors.x", "state": "states.first"}, "outputs": {"tensors.x": "output"}},
        {"name": "fit again", "op": "fit.standard_scaler", "train_only": True, "inputs": {"x": "tensors.x"}, "outputs": {"states.second": "state"}},
        {"name": "scale again", "op": "transform.standard_scaler", "inputs": {"x": "tensors.x", "state": "states.second"}, "outputs": {"tensors.features": "output"}},
        {"name": "words", "op": "fit.label_encoder", "inputs": {"x": "o_orderpriority"}, "outputs": {"states.priorities": "state"}},
        {"name": "word ids", "op": "transform.label_encode", "inputs": {"x": "o_orderpriority", "state": "states.priorities"}, "outputs": {"tensors.priority": "output"}},
    ],
}


@query("fea0_processors_redefined_tensor", "FEA0 FEA18 FEA19 FEA21", oracle="""
WITH x AS (SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS FLOAT) AS a, CAST(o_custkey AS FLOAT) AS b FROM orders),
s AS (SELECT AVG(a) AS ma, STDDEV(a) AS sa, AVG(b) AS mb, STDDEV(b) AS sb FROM x),
v AS (SELECT o_orderpriority, ROW_NUMBER() OVER (ORDER BY o_orderpriority) - 1 AS idx FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT x.o_orderkey, [round((a - ma) / sa, 5), round((b - mb) / sb, 5)] AS features, v.idx AS priority, 2 AS n
FROM x JOIN v USING (o_orderpriority), s
""")
def fea0_processors_redefined_tensor(spark, sf_dir):
    """Trained, saved whole, loaded and applied in prediction mode. The second fit sees the scaled tensor (mean 0, deviation
    1), so scaling again changes nothing."""
    o = read_table(spark, sf_dir, "orders")
    pipe = FeaturePipeline(PROCESSORS)
    _, states, vars_ = pipe.run(o, training=True)
    path = files.scratch_path(spark, "pipeline_states")
    save_states(spark, states, path)
    out, _, _ = pipe.run(o, training=False, states=load_states(spark, path))
    return out.select("o_orderkey", F.transform("features", lambda v: round_to(v, 5)).alias("features"), "priority",
                      F.lit(vars_["n"]).alias("n"))


@query("fea20_vocabulary_versions", "FEA20 FEA7", oracle="""
SELECT p_brand, ROW_NUMBER() OVER (ORDER BY p_brand) - 1 AS idx, 1 AS version FROM (SELECT DISTINCT p_brand FROM part WHERE p_size <= 25)
UNION ALL
SELECT p_brand, ROW_NUMBER() OVER (ORDER BY p_brand) - 1 AS idx, 2 AS version FROM (SELECT DISTINCT p_brand FROM part)
""")
def fea20_vocabulary_versions(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    path = files.scratch_path(spark, "vocabulary")
    for version, rows in ((1, p.where("p_size <= 25")), (2, p)):
        vocab = FE.fit_label_encoder(rows, "p_brand")
        vocab.version = version
        FE.save_vocabulary(vocab, path)
    first, last = FE.load_vocabulary(spark, path, "p_brand", 1), FE.load_vocabulary(spark, path, "p_brand")
    return first.frame.withColumn("version", F.lit(first.version)).unionByName(
        last.frame.withColumn("version", F.lit(last.version))).select(F.col("value").alias("p_brand"), F.col("idx").cast("bigint").alias("idx"), "version")


@query("fea4_string_bucket_invariants", "FEA4", oracle="""
SELECT COUNT(DISTINCT c_name) AS names, CAST(0 AS BIGINT) AS out_of_range, CAST(1 AS BIGINT) AS buckets_per_name, TRUE AS spread FROM customer
""")
def fea4_string_bucket_invariants(spark, sf_dir):
    """Text buckets lie in [0, 1000), equal texts share one, and they spread: at least as many buckets as half of what an
    even hash would fill."""
    c = read_table(spark, sf_dir, "customer").select("c_name", hash_bucket("c_name", 1000).alias("b"))
    per = c.groupBy("c_name").agg(F.count_distinct("b").alias("k"), F.min("b").alias("b"))
    filled = F.count_distinct("b") >= F.lit(500) * (F.lit(1.0) - F.exp(-F.count("*") / F.lit(1000.0)))
    return per.agg(F.count("*").alias("names"), F.count_if((F.col("b") < 0) | (F.col("b") >= 1000)).alias("out_of_range"),
                   F.max("k").alias("buckets_per_name"), filled.alias("spread"))


# ---------------------------------------------------------------- inputs, training, scoring

@query("inp1_bound_inputs", "INP1", oracle="""
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INTEGER) + l_linenumber AS BIGINT) AS whole,
       round(CAST(l_extendedprice AS DOUBLE) + CAST(l_tax AS DOUBLE), 4) AS amount FROM lineitem
""")
def inp1_bound_inputs(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    b = scoring.bind_inputs(li, {"counts": {"columns": ["l_quantity", "l_linenumber"], "dtype": "int32"},
                                 "money": {"columns": ["l_extendedprice", "l_tax"], "dtype": "float64"}})
    return b.select("l_orderkey", "l_linenumber", (F.col("inputs.counts")[0] + F.col("inputs.counts")[1]).cast("bigint").alias("whole"),
                    round_to(F.col("inputs.money")[0] + F.col("inputs.money")[1], 4).alias("amount"))


@query("inp2_features_and_targets", "INP2", oracle="""
SELECT CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus FROM orders
""")
def inp2_features_and_targets(spark, sf_dir):
    return scoring.features_and_targets(read_table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus"])


@query("trn1_linear_fit", "TRN1", oracle="""
SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept
FROM lineitem
""")
def trn1_linear_fit(spark, sf_dir):
    """Mean squared error names least squares: the fitted line is the one SQL's regression aggregates give."""
    li = read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    model, _ = scoring.train(li, ["l_quantity"], "l_extendedprice", "mse", solver="normal")
    return li.limit(1).select(round_to(F.lit(float(model.coefficients[0])), 3).alias("slope"),
                              round_to(F.lit(float(model.intercept)), 2).alias("intercept"))


@query("scr1_dense_fixed_net", "SCR1 SCR2", oracle="""
WITH h AS (SELECT vec_id,
  greatest(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (((i - 1) % 7) - 3) / 10.0)) + 0.1, 0) AS a,
  greatest(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (((i - 1) % 5) - 2) / 10.0)) - 0.1, 0) AS b FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-(0.5 * a - 0.25 * b + 0.05))), 8) AS probability FROM h
""")
def scr1_dense_fixed_net(spark, sf_dir):
    i = np.arange(64)
    model = scoring.Dense([("linear", np.stack([(i % 7 - 3) / 10.0, (i % 5 - 2) / 10.0], 1), np.array([0.1, -0.1])), ("relu",),
                           ("linear", np.array([[0.5], [-0.25]]), np.array([0.05])), ("sigmoid",)])
    s = scoring.dense_score(read_table(spark, sf_dir, "embeddings"), model, "embedding", ["vec_id"], "p")
    return s.select("vec_id", round_to(F.col("p")[0], 8).alias("probability"))


@query("scr3_checked_frame", "SCR3", oracle="""
SELECT l_orderkey, l_linenumber, round(1.5 + 0.01 * l_quantity - 2.0 * l_discount, 9) AS pred_score FROM lineitem
""")
def scr3_checked_frame(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    s = scoring.score_frame(li, {"l_quantity": 0.01, "l_discount": -2.0}, 1.5)
    return s.select("l_orderkey", "l_linenumber", round_to("pred_score", 9).alias("pred_score"))


# ---------------------------------------------------------------- evaluation

_DIRTY_SQL = f"""WITH {SCORED_CTE},
dirty AS (SELECT o_orderkey, CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE label END AS label, z,
                 CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN CAST('NaN' AS DOUBLE) ELSE score END AS score FROM scored),
ok AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM dirty
       WHERE label IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))"""


def _dirty(spark, sf_dir):
    k = F.col("o_orderkey")
    return scored_orders(spark, sf_dir).select(
        "o_orderkey", F.when(k % 83 == 0, None).otherwise(F.col("label")).alias("label"), "z",
        F.when(k % 97 == 0, None).when(k % 89 == 0, float("nan")).otherwise(F.col("score")).alias("score"))


@query("met16_evaluate_dirty_scores", "MET16 MET14", oracle=_DIRTY_SQL + """,
c AS (SELECT SUM(CASE WHEN label = pred THEN 1 ELSE 0 END)::DOUBLE AS correct, COUNT(*) AS total FROM ok),
sc AS (SELECT z, SUM(label) AS pos, SUM(1 - label) AS neg FROM ok GROUP BY z),
cum AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc),
a AS (SELECT SUM(pos * (below + 0.5 * neg)) / (SUM(pos)::DOUBLE * SUM(neg)::DOUBLE) AS auc FROM cum)
SELECT total, round(correct / total, 9) AS accuracy, round(auc, 9) AS auc FROM c, a
""")
def met16_evaluate_dirty_scores(spark, sf_dir):
    """NULL labels, NULL scores and NaN scores injected: accuracy and AUC are over the same rows."""
    row = evaluation.evaluate_binary(_dirty(spark, sf_dir), "label", "score", rank_by="z")
    return _r(row.select("total", "accuracy", "auc"))


@query("snk5_prediction_table_read_back", "SNK5 MET16", oracle=_DIRTY_SQL + """
SELECT label, pred AS prediction, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS keys FROM ok GROUP BY 1, 2
""")
def snk5_prediction_table_read_back(spark, sf_dir):
    path = files.scratch_path(spark, "evaluation_predictions")
    evaluation.evaluate_binary(_dirty(spark, sf_dir), "label", "score", prediction_table=path).collect()  # one metrics row
    t = spark.read.parquet(path)
    return t.groupBy("label", "prediction").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("met9_roc_ends_and_area", "MET9 MET7", oracle=f"""
WITH {SCORED_CTE},
sc AS (SELECT z, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY z),
cum AS (SELECT z, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp FROM sc WINDOW w AS (ORDER BY z DESC)),
n AS (SELECT SUM(pos) AS p, SUM(neg) AS q FROM sc),
pts AS (SELECT fp::DOUBLE / q AS fpr, tp::DOUBLE / p AS tpr FROM cum, n UNION ALL SELECT 0.0, 0.0),
ordered AS (SELECT fpr, tpr, LAG(fpr) OVER (ORDER BY fpr, tpr) AS f0, LAG(tpr) OVER (ORDER BY fpr, tpr) AS t0 FROM pts)
SELECT COUNT(*) AS points, round(MIN(fpr) + MIN(tpr), 9) AS first_point, round(MAX(fpr) + MAX(tpr), 9) AS last_point,
       round(SUM((fpr - f0) * (tpr + t0) / 2), 8) AS area FROM ordered
""")
def met9_roc_ends_and_area(spark, sf_dir):
    s = scored_orders(spark, sf_dir)
    area = M.roc_area(s, "label", "z")
    curve = M.roc_curve(s, "label", "z", ends=True).agg(
        F.count("*").alias("points"), round_to(F.min("fpr") + F.min("tpr"), 9).alias("first_point"),
        round_to(F.max("fpr") + F.max("tpr"), 9).alias("last_point"))
    return curve.select("*", round_to(area.select("area").scalar(), 8).alias("area"))


_HIST_SQL = """r AS (SELECT 'residual' AS series, yhat - y AS v FROM reg UNION ALL SELECT 'prediction', yhat FROM reg
          UNION ALL SELECT 'target', y FROM reg),
m AS (SELECT series, MIN(v) AS mn, MAX(v) AS mx FROM r GROUP BY series),
w AS (SELECT series, mn, CASE WHEN mx > mn THEN (mx - mn) / 20.0 ELSE 1.0 END AS width FROM m),
b AS (SELECT r.series, mn, width, CAST(least(floor((v - mn) / width), 19) AS INTEGER) AS bin FROM r JOIN w USING (series)),
e AS (SELECT AVG(abs(yhat - y)) AS mae, AVG((yhat - y) * (yhat - y)) AS mse FROM reg)
SELECT series, bin, round(mn + bin * width, 3) AS lo, COUNT(*) AS n, round(MIN(mae), 4) AS mae, round(MIN(mse), 2) AS mse
FROM b, e GROUP BY series, bin, mn, width"""


@query("met13_all_histograms", "MET13 MET5", oracle="""
WITH reg AS (SELECT l.l_extendedprice AS y, l.l_quantity * p.p_retailprice AS yhat
             FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey), """ + _HIST_SQL)
def met13_all_histograms(spark, sf_dir):
    h = M.regression_histograms(reg_preds(spark, sf_dir), "y", "yhat", 20)
    return h.select("series", "bin", round_to("lo", 3).alias("lo"), "n", round_to("mae", 4).alias("mae"), round_to("mse", 2).alias("mse"))


# ---------------------------------------------------------------- sampling, paging, tracking

@query("srt2_page_after_key", "SRT2", oracle="""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE (l_orderkey, l_linenumber) > (SELECT (l_orderkey, l_linenumber) FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1 OFFSET 499)
ORDER BY l_orderkey, l_linenumber LIMIT 500
""")
def srt2_page_after_key(spark, sf_dir):
    """The second page of 500, found from the last key of the first one."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    keys = ["l_orderkey", "l_linenumber"]
    last = relational.page_after(li.select(*keys), keys, None, 500).tail(1)
    return relational.page_after(li, keys, tuple(last[0]) if last else None, 500)


@query("srt4_repeatable_sample", "SRT4", oracle="""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8)) AS BIGINT) % 10000 < 1000
""")
def srt4_repeatable_sample(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return relational.hash_sample(li, ["l_orderkey", "l_linenumber"], 10).select("l_orderkey", "l_linenumber", "l_quantity")


# orders as plan executions: a customer is a plan, a priority a step type, 'F' a completed execution
def _executions(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate",
                    F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))


@query("trk11_latest_completed_step", "TRK11", oracle="""
SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, COUNT(*) AS completed
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2
""")
def trk11_latest_completed_step(spark, sf_dir):
    done = _executions(spark, sf_dir).where("status = 'completed'")
    latest = TR.latest_per_key(done, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    n = done.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("completed"))
    return latest.join(n, ["o_custkey", "o_orderpriority"])


@query("trk11_completed_in_order", "TRK11", oracle="""
SELECT ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS position, o_orderkey FROM orders
WHERE o_orderstatus = 'F' AND o_custkey = (SELECT MIN(o_custkey) FROM orders WHERE o_orderstatus = 'F')
""")
def trk11_completed_in_order(spark, sf_dir):
    x = _executions(spark, sf_dir)
    plan = x.where("status = 'completed'").agg(F.min("o_custkey")).first()[0]
    rows = TR.completed_in_order(x, "o_custkey", plan, "o_orderdate", "o_orderkey")
    # one plan's executions: a few rows
    whole = rows.agg(F.collect_list("o_orderkey").alias("keys"))
    return whole.select(F.posexplode("keys").alias("position", "o_orderkey")).select(
        (F.col("position") + 1).cast("bigint").alias("position"), "o_orderkey")
