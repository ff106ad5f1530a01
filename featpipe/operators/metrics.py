"""Classification and regression metrics as aggregations (MET1-MET16).

Input: a DataFrame with a label column and a prediction (class), score (probability) or
logit column. Every metric is computed from one small aggregate of the scored rows:

* classification: the confusion counts ``(label, pred, n)`` — one shuffle, classes^2 rows;
* regression: one global ``agg``;
* ranking (AUC, ROC, PR): counts per distinct score, then running sums over the scores with
  the range-split window, so no task ever holds all scores.

Outputs are DataFrames; nothing is collected unless the caller asks for numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featpipe.plans import ordered

# Fixed value: the epsilon every ratio adds to its denominator.
EPS = 1e-8


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def predicted_class(score=None, probs=None, threshold: float = 0.5) -> Column:
    """Binary: ``score > threshold``; multi-class: first index of the largest value (SCR5)."""
    if probs is not None:
        p = _c(probs)
        return (F.array_position(p, F.array_max(p)) - 1).cast("int")
    return (_c(score) > F.lit(threshold)).cast("int")


def confusion_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    """``(label, pred, n)``: the one pass every classification metric reads. Rows without a
    label or a prediction cannot be scored and are left out."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return df.where(y.isNotNull() & p.isNotNull()).groupBy(y.alias("label"), p.alias("pred")) \
        .agg(F.count("*").alias("n"))


def _present_classes(counts: DataFrame) -> DataFrame:
    """tp, predicted and support for every class that occurs as a label or a prediction."""
    return counts.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("cls"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
                     .alias("tp"), F.lit(0).cast("bigint").alias("npred"), F.col("n").alias("support")),
            F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("npred"),
                     F.lit(0).cast("bigint").alias("support")),
        )).alias("s")).select("s.*").groupBy("cls").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("tp", "npred", "support")])


def _per_class(counts: DataFrame) -> DataFrame:
    """Every class 0..K-1, K = max(label, pred) + 1; absent classes get zeros (the
    reference's range(num_classes) loop). Used where the per-class rows are the output."""
    k = counts.agg((F.max(F.greatest("label", "pred")) + 1).alias("k")).first()["k"] or 0  # one number
    classes = counts.sparkSession.range(int(k)).select(F.col("id").cast("int").alias("cls"))  # generated in parallel
    return classes.join(_present_classes(counts), "cls", "left").select(
        "cls", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("tp", "npred", "support")])


def classification_metrics(df: DataFrame, label: str, pred: str, average: str = "macro") -> DataFrame:
    """One row: accuracy, precision, recall, f1, correct, total, num_classes (MET1-MET4).

    Two classes and ``average != 'micro'``: the positive class 1. ``micro``: class 1 counts
    only (the reference's definition). ``macro``: mean over classes 0..K-1; ``weighted``: by
    support. Every ratio adds 1e-8 to its denominator, F1 uses the averaged precision and
    recall. One job: confusion counts -> per-class table -> one global aggregate.
    """
    pc = _present_classes(confusion_counts(df, label, pred))
    p_k = F.col("tp") / (F.col("npred") + F.lit(EPS))
    r_k = F.col("tp") / (F.col("support") + F.lit(EPS))
    one = F.col("cls") == 1
    a = pc.agg(
        F.sum("support").alias("total"), F.sum("tp").alias("correct"),
        (F.max("cls") + 1).alias("num_classes"),
        F.sum(F.when(one, F.col("tp")).otherwise(0.0)).alias("tp1"),
        F.sum(F.when(one, F.col("npred") - F.col("tp")).otherwise(0.0)).alias("fp1"),
        F.sum(F.when(one, F.col("support") - F.col("tp")).otherwise(0.0)).alias("fn1"),
        # absent classes add 0, so the mean over 0..K-1 is the sum over present classes / K
        F.sum(p_k).alias("p_sum"), F.sum(r_k).alias("r_sum"),
        (F.sum(p_k * F.col("support")) / F.sum("support")).alias("p_w"),
        (F.sum(r_k * F.col("support")) / F.sum("support")).alias("r_w"),
    )
    k = F.col("num_classes").cast("double")
    p_bin = F.col("tp1") / (F.col("tp1") + F.col("fp1") + F.lit(EPS))
    r_bin = F.col("tp1") / (F.col("tp1") + F.col("fn1") + F.lit(EPS))
    binary = (F.col("num_classes") == 2) & F.lit(average != "micro")
    if average == "micro":
        p, r = p_bin, r_bin
    elif average == "weighted":
        p = F.when(binary, p_bin).otherwise(F.col("p_w"))
        r = F.when(binary, r_bin).otherwise(F.col("r_w"))
    else:
        p = F.when(binary, p_bin).otherwise(F.col("p_sum") / k)
        r = F.when(binary, r_bin).otherwise(F.col("r_sum") / k)
    return a.select(
        (F.col("correct") / F.col("total")).alias("accuracy"),
        p.alias("precision"), r.alias("recall"),
        (F.lit(2.0) * p * r / (p + r + F.lit(EPS))).alias("f1"),
        F.col("correct").cast("bigint").alias("correct"), F.col("total").cast("bigint").alias("total"),
        F.col("num_classes").cast("int").alias("num_classes"),
    )


def per_class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """precision / recall / F1 / support per class; 0 when undefined, no epsilon (MET12)."""
    pc = _per_class(confusion_counts(df, label, pred))
    p = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    return pc.select(F.col("cls").alias("class"), p.alias("precision"), r.alias("recall"),
                     F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"),
                     F.col("support").cast("bigint").alias("support"))


def confusion_matrix(df: DataFrame, label: str, pred: str, normalize: bool = False) -> DataFrame:
    """Long form ``(label, pred, n[, share of the label's row])`` (MET11)."""
    c = confusion_counts(df, label, pred)
    if not normalize:
        return c
    row_tot = c.groupBy("label").agg(F.sum("n").alias("_fp_rt"))
    return c.join(row_tot, "label").select("label", "pred", "n", (F.col("n") / F.col("_fp_rt")).alias("share"))


def finite(x: Column) -> Column:
    """True for numbers: not NULL, NaN or infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """mse, mae, rmse, r2 = 1 - SSres / (SStot + 1e-8), one pass (MET5/MET6).

    All of them, and ``n``, over the same rows: those whose label and prediction are finite numbers."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    a = df.where(finite(y) & finite(p)).agg(F.avg((p - y) * (p - y)).alias("mse"), F.avg(F.abs(p - y)).alias("mae"),
               F.sum((y - p) * (y - p)).alias("ss_res"), (F.var_pop(y) * F.count(y)).alias("ss_tot"),
               F.count("*").alias("n"))
    return a.select("mse", "mae", F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - F.col("ss_res") / (F.col("ss_tot") + F.lit(EPS))).alias("r2"), "ss_res", "ss_tot", "n")


def scored_rows(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(label, score)`` of the rows every score metric is computed over: a 0/1 label, a score that is a number."""
    s = F.col(score).cast("double")
    return df.select(F.col(label).cast("int").alias("label"), s.alias("score")).where(
        F.col("label").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))


def _score_counts(df: DataFrame, label: str, score: str, n_buckets: int | None, descending: bool = False) -> DataFrame:
    y = F.col("label") == 1
    return ordered.collapsed(scored_rows(df, label, score), [], "score", {
        "pos": y.cast("long"), "neg": (~y).cast("long")}, n_buckets, descending)


def auc(df: DataFrame, label: str, score: str, n_buckets: int | None = None) -> DataFrame:
    """AUC-ROC as the tie-aware Mann-Whitney statistic; 0.5 when one class is absent (MET7).

    ``sum over scores of pos * (neg below + neg at / 2) / (P * N)``; equals the trapezoid
    area under the ROC curve with its (0,0) end. Rows as in ``scored_rows``.
    """
    sc = _score_counts(df, label, score, n_buckets)
    cum = ordered.running(sc, [], ["score"], [("neg_below", "sum", "neg", False)])
    u = cum.agg(F.sum(F.col("pos") * (F.coalesce("neg_below", F.lit(0)) + F.col("neg") * F.lit(0.5))).alias("u"),
                F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"))
    value = F.when((F.col("p") == 0) | (F.col("n") == 0), F.lit(0.5)).otherwise(
        F.col("u") / (F.col("p").cast("double") * F.col("n").cast("double")))
    return u.select(value.alias("auc"), F.col("p").cast("bigint").alias("n_positive"), F.col("n").cast("bigint").alias("n_negative"))


def roc_curve(df: DataFrame, label: str, score: str, n_buckets: int | None = None, ends: bool = False) -> DataFrame:
    """One point per distinct score t: predicted positive when score >= t (MET9). ``ends`` adds the point (0, 0),
    whose threshold is infinity."""
    sc = _score_counts(df, label, score, n_buckets, descending=True)
    cum = ordered.running(sc, [], ["_fp_neg_score"], [("tp", "sum", "pos", True), ("fp", "sum", "neg", True)])
    n_pos, n_neg = sc.agg(F.sum("pos")).scalar(), sc.agg(F.sum("neg")).scalar()
    fpr = F.when(n_neg > 0, F.col("fp") / n_neg).otherwise(F.lit(0.0))
    tpr = F.when(n_pos > 0, F.col("tp") / n_pos).otherwise(F.lit(0.0))
    out = cum.select(F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    if not ends:
        return out
    origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return out.unionByName(origin)


def roc_area(df: DataFrame, label: str, score: str, n_buckets: int | None = None) -> DataFrame:
    """Trapezoid area under the ROC curve with its (0, 0) end (MET9): each point's strip down to the next higher score,
    summed over the counts, so no second pass over the curve is needed."""
    sc = _score_counts(df, label, score, n_buckets, descending=True)
    cum = ordered.running(sc, [], ["_fp_neg_score"], [("tp", "sum", "pos", True)])
    area = cum.agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") * F.lit(0.5))).alias("a"),
                   F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return area.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("a") / (F.col("p").cast("double") * F.col("n").cast("double")))
                       .otherwise(F.lit(0.5)).alias("area"))


def pr_curve(df: DataFrame, label: str, score: str, k: int = 127) -> DataFrame:
    """Precision and recall at thresholds i/k, i = 0..k-1 (MET10).

    Scores are binned to k bins first (one aggregate, k rows), so the running sums run on
    k rows only.
    """
    b = F.least(F.greatest(F.floor(F.col("score") * F.lit(k)), F.lit(0)), F.lit(k - 1)).cast("int")
    y = F.col("label")
    binned = scored_rows(df, label, score).groupBy(b.alias("bin")).agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"),
                                            F.sum(F.when(y == 1, 0).otherwise(1)).alias("neg"))
    spark = df.sparkSession
    bins = spark.range(k).select(F.col("id").cast("int").alias("bin"))
    full = bins.join(binned, "bin", "left").na.fill(0, ["pos", "neg"])
    w = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)  # k rows: one small task
    cum = full.select("bin", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"))
    P = binned.agg(F.sum("pos")).scalar()
    return cum.select((F.col("bin") / F.lit(float(k))).alias("threshold"),
                      F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
                      .otherwise(F.lit(1.0)).alias("precision"),
                      F.when(P > 0, F.col("tp") / P).otherwise(F.lit(0.0)).alias("recall"))


def histogram(df: DataFrame, value: Column | str, bins: int = 20, name: str = "value") -> DataFrame:
    """Equal-width histogram between min and max: ``(bin, lo, hi, n)`` (MET13)."""
    v = _c(value).cast("double")
    x = df.select(v.alias("_fp_v")).where(F.col("_fp_v").isNotNull())
    mn = x.agg(F.min("_fp_v")).scalar()
    mx = x.agg(F.max("_fp_v")).scalar()
    width = F.when(mx > mn, (mx - mn) / F.lit(float(bins))).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col("_fp_v") - mn) / width), F.lit(bins - 1)).cast("int")
    h = x.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return h.select(F.lit(name).alias("series"), "bin", (mn + F.col("bin") * width).alias("lo"),
                    (mn + (F.col("bin") + 1) * width).alias("hi"), "n")


def regression_histograms(df: DataFrame, label: str, pred: str, bins: int = 20) -> DataFrame:
    """Histograms of residual, prediction and target with the MAE and MSE of all rows beside them (MET13)."""
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    rows = df.select(y.alias("y"), p.alias("p")).where(F.col("y").isNotNull() & F.col("p").isNotNull())
    errors = rows.agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("mse"))
    out = histogram(rows, F.col("p") - F.col("y"), bins, "residual").unionByName(histogram(rows, "p", bins, "prediction")).unionByName(
        histogram(rows, "y", bins, "target"))
    return out.select("*", errors.select("mae").scalar().alias("mae"), errors.select("mse").scalar().alias("mse"))


def score_hygiene(df: DataFrame, label: str, score: str) -> DataFrame:
    """NaN / Inf counts, rows left, out-of-[0,1] count, positive rate (MET14)."""
    s = F.col(score).cast("double")
    bad = F.isnan(s) | (F.abs(s) == F.lit(float("inf"))) | s.isNull()
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(F.isnan(s)).alias("n_nan"),
        F.count_if(F.abs(s) == F.lit(float("inf"))).alias("n_inf"),
        F.count_if(~bad).alias("n_valid"),
        F.count_if(~bad & ((s < 0) | (s > 1))).alias("n_out_of_range"),
        F.avg(F.when(~bad, F.col(label).cast("double"))).alias("positive_rate"),
    ).withColumn("enough_rows", F.col("n_valid") >= 10)


def clean_scores(df: DataFrame, score: str) -> DataFrame:
    s = F.col(score).cast("double")
    return df.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf"))))


# ---------------------------------------------------------------- losses (MET15, TRN2)

def bce(prob: Column | str, label: Column | str) -> Column:
    """Binary cross-entropy per row; logs clamped at -100 as torch does."""
    p, y = _c(prob).cast("double"), _c(label).cast("double")
    lp = F.greatest(F.log(p), F.lit(-100.0))
    l1p = F.greatest(F.log(F.lit(1.0) - p), F.lit(-100.0))
    return -(y * lp + (F.lit(1.0) - y) * l1p)


def bce_with_logits(logit: Column | str, label: Column | str, pos_weight: float | None = None) -> Column:
    """Stable form ``max(z,0) - z*y + log1p(exp(-|z|))``; with pos_weight the torch formula."""
    z, y = _c(logit).cast("double"), _c(label).cast("double")
    softplus_neg = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))  # log(1 + exp(-z))
    if pos_weight is None:
        return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    pw = F.lit(float(pos_weight))
    return (F.lit(1.0) - y) * z + (F.lit(1.0) + (pw - F.lit(1.0)) * y) * softplus_neg


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """``logsumexp(z) - z[y]`` for an array of logits and a 0-based class."""
    z = _c(logits)
    m = F.array_max(z)
    lse = m + F.log(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))
    return lse - F.element_at(z, _c(label).cast("int") + 1)


def nll(log_probs: Column | str, label: Column | str) -> Column:
    return -F.element_at(_c(log_probs), _c(label).cast("int") + 1)
