"""Scoring, training and metric queries (SCR*, INP*, TRN*, MET*, SNK4-5)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from featpipe.functions.columns import round_to
from featpipe.operators import metrics as M
from featpipe.operators import scoring, splits
from featpipe.queries import query
from featpipe.sources.tables import read_table

# Fixed-weight logistic model on orders: label = status 'F'. Weights are fixed values of the
# model under evaluation (not fitted here), so Spark and the SQL oracle score identically.
W_PRICE, W_DAY, C_PRICE, C_DAY = 0.000004, -0.002, 150000.0, 1800.0

SCORED_SQL = f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       0.0 + {W_PRICE} * (o_totalprice - {C_PRICE})
           + {W_DAY} * (CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) - {C_DAY}) AS z
FROM orders"""
SCORED_CTE = f"""scored AS (SELECT o_orderkey, label, z, 1.0 / (1.0 + exp(-z)) AS score,
                 CASE WHEN 1.0 / (1.0 + exp(-z)) > 0.5 THEN 1 ELSE 0 END AS pred FROM ({SCORED_SQL}))"""


def scored_orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    x = o.select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        (F.col("o_totalprice") - F.lit(C_PRICE)).alias("x_price"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
         - F.lit(C_DAY)).alias("x_day"))
    z = scoring.linear_score({"x_price": W_PRICE, "x_day": W_DAY}, 0.0)
    return x.select("o_orderkey", "label", z.alias("z")).withColumn(
        "score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))).withColumn("pred", M.predicted_class("score"))


# multi-class: ten class scores from all 64 components (class k sums the components i with i % 10 = k)
CLASS_SCORES_SQL = ("list_transform(range(0, 10), lambda k: list_sum(list_transform(list_filter(range(1, len(embedding) + 1), "
                    "lambda i: (i - 1) % 10 = k), lambda i: CAST(embedding[i] AS DOUBLE))))")
MULTI_CTE = f"""zs AS (SELECT vec_id, label, {CLASS_SCORES_SQL} AS z FROM embeddings),
multi AS (SELECT vec_id, label, list_position(z, list_max(z)) - 1 AS pred FROM zs)"""


def class_scores(c="embedding"):
    def total(k):
        return F.aggregate(F.filter(c, lambda x, i: i % 10 == k), F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    return F.array(*[total(k) for k in range(10)])


def multi_preds(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", M.predicted_class(probs=class_scores()).alias("pred"))


# regression: extended price predicted as quantity * retail price
REG_CTE = """reg AS (SELECT l.l_extendedprice AS y, l.l_quantity * p.p_retailprice AS yhat
                     FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def reg_preds(spark, sf_dir):
    li, p = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("yhat"))


def _r(df, digits=9, skip=()):
    return df.select(*[round_to(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


@query("scr1_logistic_score_orders", "SCR1 SCR3 SCR5 SNK4 SCR6", oracle=f"""
WITH {SCORED_CTE}
SELECT o_orderkey, round(score, 9) AS pred_probability, pred AS pred_class FROM scored
""")
def scr1_logistic_score_orders(spark, sf_dir):
    s = scored_orders(spark, sf_dir)
    out = scoring.score_columns(s.select("o_orderkey", "score"), {"probability": F.col("score")})
    return out.select("o_orderkey", round_to("pred_probability", 9).alias("pred_probability"),
                      M.predicted_class("pred_probability").alias("pred_class"))


@query("met1_binary_classification_metrics", "MET1 MET2 MET3 MET4 MET8", oracle=f"""
WITH {SCORED_CTE},
c AS (SELECT SUM(CASE WHEN label = pred THEN 1 ELSE 0 END)::DOUBLE AS correct, COUNT(*)::DOUBLE AS total,
             SUM(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
             SUM(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
             SUM(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM scored),
pr AS (SELECT correct, total, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM c)
SELECT round(correct / total, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall,
       round(2.0 * p * r / (p + r + 1e-8), 9) AS f1, CAST(correct AS BIGINT) AS correct,
       CAST(total AS BIGINT) AS total, 2 AS num_classes FROM pr
""")
def met1_binary_classification_metrics(spark, sf_dir):
    m = M.classification_metrics(scored_orders(spark, sf_dir), "label", "pred")
    return _r(m)


_MULTI_PER_CLASS = f"""
WITH {MULTI_CTE},
k AS (SELECT MAX(greatest(label, pred)) + 1 AS k FROM multi),
classes AS (SELECT unnest(range(0, (SELECT k FROM k))) AS cls),
pc AS (SELECT cls,
              (SELECT COUNT(*) FROM multi WHERE label = cls AND pred = cls)::DOUBLE AS tp,
              (SELECT COUNT(*) FROM multi WHERE pred = cls)::DOUBLE AS npred,
              (SELECT COUNT(*) FROM multi WHERE label = cls)::DOUBLE AS support FROM classes)"""


@query("met2_multiclass_macro_metrics", "MET1 MET2 MET3 MET4 SCR5", oracle=_MULTI_PER_CLASS + """,
a AS (SELECT AVG(tp / (npred + 1e-8)) AS p, AVG(tp / (support + 1e-8)) AS r FROM pc)
SELECT round((SELECT COUNT(*) FILTER (WHERE label = pred) FROM multi)::DOUBLE / (SELECT COUNT(*) FROM multi), 9) AS accuracy,
       round(p, 9) AS precision, round(r, 9) AS recall, round(2.0 * p * r / (p + r + 1e-8), 9) AS f1,
       (SELECT COUNT(*) FILTER (WHERE label = pred) FROM multi) AS correct, (SELECT COUNT(*) FROM multi) AS total,
       CAST((SELECT k FROM k) AS INTEGER) AS num_classes FROM a
""")
def met2_multiclass_macro_metrics(spark, sf_dir):
    return _r(M.classification_metrics(multi_preds(spark, sf_dir), "label", "pred", "macro"))


@query("met2_multiclass_weighted_metrics", "MET2 MET3 MET4", oracle=_MULTI_PER_CLASS + """,
a AS (SELECT SUM(tp / (npred + 1e-8) * support) / SUM(support) AS p,
             SUM(tp / (support + 1e-8) * support) / SUM(support) AS r FROM pc)
SELECT round((SELECT COUNT(*) FILTER (WHERE label = pred) FROM multi)::DOUBLE / (SELECT COUNT(*) FROM multi), 9) AS accuracy,
       round(p, 9) AS precision, round(r, 9) AS recall, round(2.0 * p * r / (p + r + 1e-8), 9) AS f1,
       (SELECT COUNT(*) FILTER (WHERE label = pred) FROM multi) AS correct, (SELECT COUNT(*) FROM multi) AS total,
       CAST((SELECT k FROM k) AS INTEGER) AS num_classes FROM a
""")
def met2_multiclass_weighted_metrics(spark, sf_dir):
    return _r(M.classification_metrics(multi_preds(spark, sf_dir), "label", "pred", "weighted"))


@query("met2_multiclass_micro_metrics", "MET2 MET3 MET4", oracle=f"""
WITH {MULTI_CTE},
c AS (SELECT COUNT(*) FILTER (WHERE label = pred)::DOUBLE AS correct, COUNT(*)::DOUBLE AS total,
             COUNT(*) FILTER (WHERE label = 1 AND pred = 1)::DOUBLE AS tp,
             COUNT(*) FILTER (WHERE label <> 1 AND pred = 1)::DOUBLE AS fp,
             COUNT(*) FILTER (WHERE label = 1 AND pred <> 1)::DOUBLE AS fn,
             MAX(greatest(label, pred)) + 1 AS k FROM multi),
pr AS (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM c)
SELECT round(correct / total, 9) AS accuracy, round(p, 9) AS precision, round(r, 9) AS recall,
       round(2.0 * p * r / (p + r + 1e-8), 9) AS f1, CAST(correct AS BIGINT) AS correct, CAST(total AS BIGINT) AS total,
       CAST(k AS INTEGER) AS num_classes FROM pr
""")
def met2_multiclass_micro_metrics(spark, sf_dir):
    return _r(M.classification_metrics(multi_preds(spark, sf_dir), "label", "pred", "micro"))


@query("met5_regression_metrics", "MET5 MET6", oracle=f"""
WITH {REG_CTE}
SELECT round(AVG((yhat - y) * (yhat - y)), 4) AS mse, round(AVG(abs(yhat - y)), 6) AS mae,
       round(sqrt(AVG((yhat - y) * (yhat - y))), 6) AS rmse,
       round(1 - SUM((y - yhat) * (y - yhat)) / (var_pop(y) * COUNT(y) + 1e-8), 9) AS r2, COUNT(*) AS n
FROM reg
""")
def met5_regression_metrics(spark, sf_dir):
    m = M.regression_metrics(reg_preds(spark, sf_dir), "y", "yhat")
    return m.select(round_to("mse", 4).alias("mse"), round_to("mae", 6).alias("mae"), round_to("rmse", 6).alias("rmse"),
                    round_to("r2", 9).alias("r2"), "n")


# Ranking metrics (AUC, ROC) rank by the logit z: the sigmoid is monotone, so the curve and
# the area are the same, and z is bit-identical in every engine while exp() may differ by one
# unit in the last place between the JVM and C libraries (which would split or merge ties).
@query("met7_auc_orders", "MET7 WIN5", oracle=f"""
WITH {SCORED_CTE},
sc AS (SELECT z, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY z),
cum AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS neg_below FROM sc)
SELECT round(CASE WHEN SUM(pos) = 0 OR SUM(neg) = 0 THEN 0.5
             ELSE SUM(pos * (neg_below + 0.5 * neg)) / (SUM(pos)::DOUBLE * SUM(neg)::DOUBLE) END, 9) AS auc,
       CAST(SUM(pos) AS BIGINT) AS n_positive, CAST(SUM(neg) AS BIGINT) AS n_negative FROM cum
""")
def met7_auc_orders(spark, sf_dir):
    return _r(M.auc(scored_orders(spark, sf_dir), "label", "z"))


@query("met9_roc_curve_orders", "MET9 WIN5", oracle=f"""
WITH {SCORED_CTE},
sc AS (SELECT z, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY z),
cum AS (SELECT z, SUM(pos) OVER (ORDER BY z DESC) AS tp, SUM(neg) OVER (ORDER BY z DESC) AS fp FROM sc)
SELECT round(z, 9) AS threshold_logit, round(fp / (SELECT SUM(neg) FROM sc), 9) AS fpr,
       round(tp / (SELECT SUM(pos) FROM sc), 9) AS tpr FROM cum
""")
def met9_roc_curve_orders(spark, sf_dir):
    roc = M.roc_curve(scored_orders(spark, sf_dir), "label", "z")
    return _r(roc.withColumnRenamed("threshold", "threshold_logit"))


@query("met10_pr_curve_orders", "MET10", oracle=f"""
WITH {SCORED_CTE},
b AS (SELECT CAST(least(greatest(floor(score * 127), 0), 126) AS INTEGER) AS bin, label FROM scored),
bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(127)),
agg AS (SELECT bins.bin, COALESCE(SUM(label), 0) AS pos, COALESCE(SUM(1 - label), 0) AS neg
        FROM bins LEFT JOIN b ON bins.bin = b.bin GROUP BY bins.bin),
cum AS (SELECT bin, SUM(pos) OVER (ORDER BY bin DESC) AS tp, SUM(neg) OVER (ORDER BY bin DESC) AS fp FROM agg)
SELECT round(bin / 127.0, 9) AS threshold,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END, 9) AS precision,
       round(tp / (SELECT SUM(label) FROM scored), 9) AS recall FROM cum
""")
def met10_pr_curve_orders(spark, sf_dir):
    return _r(M.pr_curve(scored_orders(spark, sf_dir), "label", "score", 127))


@query("met11_confusion_matrix_normalized", "MET11", oracle=f"""
WITH {MULTI_CTE},
c AS (SELECT label, pred, COUNT(*) AS n FROM multi GROUP BY 1, 2)
SELECT label, pred, n, round(n / SUM(n) OVER (PARTITION BY label), 9) AS share FROM c
""")
def met11_confusion_matrix_normalized(spark, sf_dir):
    return _r(M.confusion_matrix(multi_preds(spark, sf_dir), "label", "pred", normalize=True))


@query("met12_per_class_report", "MET12", oracle=_MULTI_PER_CLASS + """
SELECT CAST(cls AS INTEGER) AS class,
       round(CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END, 9) AS precision,
       round(CASE WHEN support > 0 THEN tp / support ELSE 0.0 END, 9) AS recall,
       round(CASE WHEN (CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END)
                       + (CASE WHEN support > 0 THEN tp / support ELSE 0.0 END) > 0
             THEN 2.0 * (CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END) * (CASE WHEN support > 0 THEN tp / support ELSE 0.0 END)
                  / ((CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END) + (CASE WHEN support > 0 THEN tp / support ELSE 0.0 END))
             ELSE 0.0 END, 9) AS f1,
       CAST(support AS BIGINT) AS support FROM pc
""")
def met12_per_class_report(spark, sf_dir):
    return _r(M.per_class_report(multi_preds(spark, sf_dir), "label", "pred"))


@query("met13_residual_histogram", "MET13", oracle=f"""
WITH {REG_CTE},
r AS (SELECT yhat - y AS v FROM reg),
mm AS (SELECT MIN(v) AS mn, MAX(v) AS mx FROM r),
w AS (SELECT mn, CASE WHEN mx > mn THEN (mx - mn) / 20.0 ELSE 1.0 END AS width FROM mm),
b AS (SELECT CAST(least(floor((v - mn) / width), 19) AS INTEGER) AS bin FROM r, w)
SELECT 'residual' AS series, bin, round((SELECT mn FROM w) + bin * (SELECT width FROM w), 4) AS lo,
       round((SELECT mn FROM w) + (bin + 1) * (SELECT width FROM w), 4) AS hi, COUNT(*) AS n FROM b GROUP BY bin
""")
def met13_residual_histogram(spark, sf_dir):
    r = reg_preds(spark, sf_dir)
    h = M.histogram(r, F.col("yhat") - F.col("y"), 20, "residual")
    return h.select("series", "bin", round_to("lo", 4).alias("lo"), round_to("hi", 4).alias("hi"), "n")


@query("met14_score_hygiene", "MET14", oracle=f"""
WITH {SCORED_CTE}
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE isnan(score)) AS n_nan, COUNT(*) FILTER (WHERE isinf(score)) AS n_inf,
       COUNT(*) FILTER (WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)) AS n_valid,
       COUNT(*) FILTER (WHERE score < 0 OR score > 1) AS n_out_of_range, round(AVG(label), 9) AS positive_rate,
       COUNT(*) FILTER (WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)) >= 10 AS enough_rows
FROM scored
""")
def met14_score_hygiene(spark, sf_dir):
    return _r(M.score_hygiene(scored_orders(spark, sf_dir), "label", "score"))


@query("met15_losses", "MET15 TRN2", oracle=f"""
WITH {SCORED_CTE}
SELECT round(AVG(-(label * greatest(ln(score), -100.0) + (1 - label) * greatest(ln(1.0 - score), -100.0))), 9) AS bce,
       round(AVG(greatest(z, 0.0) - z * label + ln(1 + exp(-abs(z)))), 9) AS bce_logits,
       round(AVG((1 - label) * z + (1 + (2.0 - 1.0) * label) * (ln(1 + exp(-abs(z))) + greatest(-z, 0.0))), 9)
         AS bce_logits_pw2
FROM scored
""")
def met15_losses(spark, sf_dir):
    s = scored_orders(spark, sf_dir)
    m = s.agg(F.avg(M.bce("score", "label")).alias("bce"), F.avg(M.bce_with_logits("z", "label")).alias("bce_logits"),
              F.avg(M.bce_with_logits("z", "label", pos_weight=2.0)).alias("bce_logits_pw2"))
    return _r(m)


@query("met15_cross_entropy_multiclass", "MET15", oracle=f"""
WITH t AS (SELECT label, {CLASS_SCORES_SQL} AS z FROM embeddings),
l AS (SELECT label, z, list_max(z) AS m FROM t)
SELECT round(AVG(m + ln(list_sum(list_transform(z, lambda v: exp(v - m)))) - z[label + 1]), 8) AS cross_entropy
FROM l
""")
def met15_cross_entropy_multiclass(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return _r(e.select(class_scores().alias("z"), "label").agg(F.avg(M.cross_entropy("z", "label")).alias("cross_entropy")), 8)


@query("met15_nll_multiclass", "MET15", oracle=f"""
WITH t AS (SELECT label, {CLASS_SCORES_SQL} AS z FROM embeddings),
l AS (SELECT label, z, list_max(z) AS m FROM t),
p AS (SELECT label, list_transform(z, lambda v: v - m - ln(list_sum(list_transform(z, lambda u: exp(u - m))))) AS lp FROM l)
SELECT label, round(AVG(-lp[label + 1]), 8) AS nll, COUNT(*) AS n FROM p GROUP BY label
""")
def met15_nll_multiclass(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("label", class_scores().alias("z"))
    m = F.array_max("z")
    norm = m + F.log(F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
    e = e.select("label", F.transform("z", lambda v: v - norm).alias("lp"))
    return _r(e.groupBy("label").agg(F.avg(M.nll("lp", "label")).alias("nll"), F.count("*").alias("n")), 8)


@query("met16_evaluate_end_to_end", "MET16 MET8", oracle=f"""
WITH {SCORED_CTE},
c AS (SELECT SUM(CASE WHEN label = pred THEN 1 ELSE 0 END)::DOUBLE AS correct, COUNT(*)::DOUBLE AS total,
             SUM(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp,
             SUM(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END)::DOUBLE AS fp,
             SUM(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END)::DOUBLE AS fn FROM scored),
sc AS (SELECT z, SUM(label) AS pos, SUM(1 - label) AS neg FROM scored GROUP BY z),
cum AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS neg_below FROM sc),
a AS (SELECT SUM(pos * (neg_below + 0.5 * neg)) / (SUM(pos)::DOUBLE * SUM(neg)::DOUBLE) AS auc FROM cum)
SELECT round(correct / total, 9) AS accuracy, round(tp / (tp + fp + 1e-8), 9) AS precision,
       round(tp / (tp + fn + 1e-8), 9) AS recall, round(auc, 9) AS auc FROM c, a
""")
def met16_evaluate_end_to_end(spark, sf_dir):
    from featpipe.operators.evaluation import evaluate_binary

    # classes from the probability (> 0.5), ranking by the logit (see met7)
    s = scored_orders(spark, sf_dir)
    return _r(evaluate_binary(s, "label", "score", rank_by="z").select("accuracy", "precision", "recall", "auc"))


@query("trn2_loss_per_split", "TRN2 MET15 SPL1", oracle=f"""
WITH {SCORED_CTE},
s AS (SELECT sc.*, CASE WHEN MOD(ROW_NUMBER() OVER (PARTITION BY label ORDER BY o_orderkey), 10) < 8
                        THEN 'training' ELSE 'validation' END AS split FROM scored sc)
SELECT split, round(AVG(greatest(z, 0.0) - z * label + ln(1 + exp(-abs(z)))), 9) AS loss, COUNT(*) AS n FROM s GROUP BY split
""")
def trn2_loss_per_split(spark, sf_dir):
    s = splits.stratified_split(scored_orders(spark, sf_dir), "label", "o_orderkey")
    return _r(s.groupBy("split").agg(F.avg(M.bce_with_logits("z", "label")).alias("loss"), F.count("*").alias("n")))


@query("trn3_pretraining_checks", "TRN3 INP3", oracle="""
SELECT COUNT(*) AS rows, COUNT(DISTINCT o_orderstatus) AS target_distinct,
       COUNT(*) FILTER (WHERE o_orderstatus IS NULL) AS target_nulls,
       COUNT(*) FILTER (WHERE o_totalprice IS NULL) AS o_totalprice_nulls,
       COUNT(*) FILTER (WHERE isnan(o_totalprice)) AS o_totalprice_nan,
       COUNT(*) FILTER (WHERE isinf(o_totalprice)) AS o_totalprice_inf,
       COUNT(*) FILTER (WHERE o_custkey IS NULL) AS o_custkey_nulls,
       COUNT(*) FILTER (WHERE isnan(o_custkey::DOUBLE)) AS o_custkey_nan,
       COUNT(*) FILTER (WHERE isinf(o_custkey::DOUBLE)) AS o_custkey_inf
FROM orders
""")
def trn3_pretraining_checks(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    scoring.features_and_targets(o, ["o_totalprice", "o_custkey"], ["o_orderstatus"])  # column / type checks
    return scoring.pretraining_checks(o, ["o_totalprice", "o_custkey"], "o_orderstatus")


@query("trn1_fit_logistic_orders", "TRN1")
def trn1_fit_logistic_orders(spark, sf_dir):
    from featpipe.queries.q_splits import spl6_scaled_training_set

    data = spl6_scaled_training_set(spark, sf_dir)
    train = data.where(F.col("split") == "training")
    model, vec = scoring.train(train, ["totalprice_z", "order_day_z", "priority_z"], "target", "bce", maxIter=20)
    val = vec.transform(data.where(F.col("split") == "validation").withColumn("label", F.col("target").cast("double")))
    from pyspark.ml.functions import vector_to_array

    return model.transform(val).select("o_orderkey", "target",
                                       vector_to_array("probability")[1].alias("probability"))


@query("scr1_dense_mlp_embeddings", "SCR1 SCR2")
def scr1_dense_mlp_embeddings(spark, sf_dir):
    rng = np.random.RandomState(0)
    model = scoring.Dense([("linear", rng.normal(0, 0.1, (64, 16)), np.zeros(16)), ("relu",),
                           ("linear", rng.normal(0, 0.1, (16, 10)), np.zeros(10)), ("softmax",)])
    e = read_table(spark, sf_dir, "embeddings")
    bound = scoring.bind_inputs(e, {"x": {"columns": ["vec_id"], "dtype": "int64"}})
    s = scoring.dense_score(bound, model, "embedding", ["vec_id", "label"], "probabilities")
    return s.select("vec_id", "label", M.predicted_class(probs="probabilities").alias("pred"), "probabilities")


@query("scr5_argmax_class_embeddings", "SCR5", oracle=f"""
WITH {MULTI_CTE} SELECT vec_id, pred FROM multi
""")
def scr5_argmax_class_embeddings(spark, sf_dir):
    return multi_preds(spark, sf_dir).select("vec_id", "pred")


@query("scr7_embedding_lookup", "SCR7", oracle="""
WITH j AS (SELECT l.doc_id, l.quality, l.toxic,
       COALESCE(list_transform(e.embedding, lambda x: round(CAST(x AS DOUBLE), 6)),
                list_transform(range(64), lambda x: CAST(0.0 AS DOUBLE))) AS emb
FROM labels l LEFT JOIN embeddings e ON l.doc_id = e.vec_id)
SELECT doc_id, emb, list_concat(emb, [CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE)]) AS features FROM j
""")
def scr7_embedding_lookup(spark, sf_dir):
    lab, emb = read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "embeddings")
    table = emb.select("vec_id", F.col("embedding").alias("vec"))
    j = scoring.embedding_lookup(lab.select("doc_id", "quality", "toxic"), "doc_id", table, "vec_id", "vec", "emb", 64)
    j = j.withColumn("emb", F.transform("emb", lambda x: round_to(x.cast("double"), 6)))
    return j.select("doc_id", "emb", scoring.with_numbers("emb", ["quality", "toxic"]).alias("features"))


@query("inp4_shape_check_embeddings", "INP4 FEA2", oracle="""
SELECT COUNT(*) FILTER (WHERE len(embedding) <> 64) AS bad_rows, COUNT(*) AS rows FROM embeddings
""")
def inp4_shape_check_embeddings(spark, sf_dir):
    return scoring.shape_check(read_table(spark, sf_dir, "embeddings"), "embedding", 64)


@query("met7_auc_quality_by_length", "MET7 MET14 JN1", oracle="""
WITH s AS (SELECT l.quality AS label, d.n_chars AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
sc AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM s GROUP BY score),
cum AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS neg_below FROM sc)
SELECT round(CASE WHEN SUM(pos) = 0 OR SUM(neg) = 0 THEN 0.5
             ELSE SUM(pos * (neg_below + 0.5 * neg)) / (SUM(pos)::DOUBLE * SUM(neg)::DOUBLE) END, 9) AS auc,
       CAST(SUM(pos) AS BIGINT) AS n_positive, CAST(SUM(neg) AS BIGINT) AS n_negative FROM cum
""")
def met7_auc_quality_by_length(spark, sf_dir):
    """How well document length ranks the quality label: labels joined to documents."""
    lab, doc = read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents")
    s = lab.join(doc, "doc_id").select(F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"))
    return _r(M.auc(s, "label", "score"))
