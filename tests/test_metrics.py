"""Metric values on the reference tests' literals."""

from pyspark.sql import functions as F

from featpipe.operators import metrics as M


def _binary(spark, scores, labels):
    return spark.createDataFrame(list(zip(scores, labels)), "score double, label int") \
        .withColumn("pred", M.predicted_class("score"))


def test_binary_accuracy(spark):
    r = M.classification_metrics(_binary(spark, [.1, .9, .2, .8], [0, 1, 0, 1]), "label", "pred").first()
    assert r["accuracy"] == 1.0 and r["correct"] == 4 and r["total"] == 4


def test_multiclass_accuracy(spark):
    logits = [[2.0, 1.0, 0.0], [0.0, 2.0, 1.0], [1.0, 0.0, 2.0], [2.0, 1.0, 0.0]]
    df = spark.createDataFrame(list(zip(logits, [0, 1, 2, 1])), "p array<double>, label int") \
        .withColumn("pred", M.predicted_class(probs="p"))
    r = M.classification_metrics(df, "label", "pred").first()
    assert r["accuracy"] == 0.75 and r["correct"] == 3


def test_precision_binary(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 0, 1], [0, 1, 0, 0, 1])), "pred int, label int")
    r = M.classification_metrics(df, "label", "pred").first()
    assert abs(r["precision"] - 2 / 3) < 1e-6
    assert abs(r["recall"] - 1.0) < 1e-6


def test_r2(spark):
    same = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "y double, p double")
    assert abs(M.regression_metrics(same, "y", "p").first()["r2"] - 1.0) < 1e-9
    df = spark.createDataFrame(list(zip([2.0, 4.0, 6.0, 8.0], [1.5, 3.5, 5.5, 7.5])), "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert 0 <= r["r2"] <= 1 and abs(r["mse"] - 0.25) < 1e-12 and abs(r["rmse"] - 0.5) < 1e-12


def test_auc(spark):
    assert M.auc(_binary(spark, [.1, .2, .8, .9], [0, 0, 1, 1]), "label", "score").first()["auc"] == 1.0
    assert M.auc(_binary(spark, [.5, .5, .5, .5], [0, 0, 1, 1]), "label", "score").first()["auc"] == 0.5
    assert M.auc(_binary(spark, [.3, .4], [1, 1]), "label", "score").first()["auc"] == 0.5


def test_auc_equals_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(400).select(((F.col("id") * 37) % 101 / 100.0).alias("score"),
                                 (((F.col("id") * 13) % 7) < 3).cast("int").alias("label"))
    ours = M.auc(df, "label", "score", n_buckets=5).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="lbl", metricName="areaUnderROC")
    theirs = ev.evaluate(df.withColumn("lbl", F.col("label").cast("double")))
    assert abs(ours - theirs) < 1e-9


def test_roc_and_pr_curves(spark):
    df = _binary(spark, [.1, .4, .35, .8], [0, 0, 1, 1])
    roc = sorted((r["fpr"], r["tpr"]) for r in M.roc_curve(df, "label", "score").collect())
    assert roc[-1] == (1.0, 1.0)
    pr = M.pr_curve(df, "label", "score", k=10).orderBy("threshold").collect()
    assert len(pr) == 10 and pr[0]["recall"] == 1.0


def test_losses(spark):
    import math

    df = spark.createDataFrame([(0.0, 1), (2.0, 0)], "z double, y int")
    r = df.agg(F.avg(M.bce_with_logits("z", "y")).alias("l")).first()["l"]
    exp = (math.log(2) + (2 + math.log1p(math.exp(-2)))) / 2
    assert abs(r - exp) < 1e-12
    ce = spark.createDataFrame([([1.0, 2.0, 3.0], 2)], "z array<double>, y int").select(M.cross_entropy("z", "y")).first()[0]
    lse = math.log(sum(math.exp(v) for v in [1, 2, 3]))
    assert abs(ce - (lse - 3.0)) < 1e-12
