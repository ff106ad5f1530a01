"""Driver-side glue: read-only gate, preview, contract checks, metric sets, catalog, sinks."""

import pytest
from pyspark.sql import functions as F

from featpipe.operators import evaluation, profile, scoring, sinks, splits
from featpipe.plans import gate
from featpipe.sources import remote, synthetic


def test_read_only_gate(spark):
    assert gate.check_read_only("  -- c\n SELECT 1;") == "SELECT 1"
    for bad in ["DROP TABLE x", "INSERT INTO t VALUES (1)", "SELECT 1; DELETE FROM t", "update t set a=1"]:
        with pytest.raises(gate.QueryRejected):
            gate.check_read_only(bad)
    spark.range(3).createOrReplaceTempView("gate_numbers")
    with pytest.raises(gate.QueryRejected, match="gate_numbers"):
        gate.query(spark, "SELECT * FROM gate_numbrs")


def test_preview_bounded(spark):
    p = gate.preview(spark.range(250), 100)
    assert len(p.rows) == 100 and p.truncated
    assert not gate.preview(spark.range(5), 100).truncated


def test_output_contract(spark):
    good = spark.createDataFrame([(1.0, 1, "training"), (2.0, 0, "validation")], "x double, y int, split string")
    assert splits.check_output_contract(good, "y")["ok"]
    bad = spark.createDataFrame([("a", 1, "train")], "x string, y int, split string")
    r = splits.check_output_contract(bad, "y")
    assert not r["ok"] and len(r["problems"]) == 2


def test_metric_sets_and_output_choice(spark):
    assert evaluation.task_from_loss("bce_with_logits") == "binary"
    assert evaluation.task_from_loss("cross_entropy") == "multiclass"
    assert evaluation.task_from_loss("mse") == "regression"
    row = spark.createDataFrame([(0.9, 0.8, 0.7, 0.75, 0.95)], "accuracy double, precision double, recall double, "
                                "f1 double, auc double")
    long = {r["name"]: (r["value"], r["higher_is_better"]) for r in evaluation.metrics_long(row, "binary").collect()}
    assert long["auc"] == (0.95, True) and len(long) == 5
    assert scoring.choose_output(["logits", "probs"]) == "probs"
    assert scoring.choose_output(["a", "b"]) == "a"
    assert scoring.choose_output(["a", "b"], "b") == "b"


def test_bind_inputs_and_checks(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    out = scoring.bind_inputs(df, {"num": {"columns": ["a", "b"], "dtype": "float64"}}).first()["inputs"]
    assert list(out["num"]) == [1.0, 2.0]
    with pytest.raises(scoring.ScoringError):
        scoring.bind_inputs(df, {"num": {"columns": ["zz"]}})
    with pytest.raises(scoring.ScoringError):
        scoring.bind_inputs(df, {"num": {"columns": []}})
    with pytest.raises(scoring.ScoringError, match="string"):
        scoring.features_and_targets(df, ["a", "c"], [])


def test_dense_model_softmax(spark):
    import numpy as np

    m = scoring.Dense([("linear", np.eye(2), np.zeros(2)), ("softmax",)])
    df = spark.createDataFrame([(1, [0.0, 0.0])], "id int, v array<float>")
    p = scoring.dense_score(df, m, "v", ["id"], "p").first()["p"]
    assert abs(p[0] - 0.5) < 1e-12 and abs(sum(p) - 1) < 1e-12


def test_catalog_listing(spark):
    spark.range(2).createOrReplaceTempView("listed_view")
    t = profile.list_tables(spark).where("table = 'listed_view'").collect()
    assert t and t[0]["kind"] == "view" and t[0]["column"] == "id"
    ins = {r["column"]: r for r in profile.column_insights(
        spark.createDataFrame([(1, "{}")], "user_id bigint, props string")).collect()}
    assert ins["user_id"]["id_like"] and ins["props"]["json_like"]


def test_append_sink(spark, tmp_path):
    p = str(tmp_path / "log")
    sinks.append_rows(spark.range(2), p)
    sinks.append_rows(spark.range(3), p)
    assert spark.read.parquet(p).count() == 5


def test_remote_and_synthetic(spark):
    assert remote.s3_path("s3://b/k/x.parquet") == "s3a://b/k/x.parquet"
    remote.configure_s3(spark, endpoint="http://localhost:9000", path_style=True)
    df = synthetic.synthetic_dataset(spark, 1000, 3, binary=True, seed=1)
    assert df.columns == ["id", "feature_0", "feature_1", "feature_2", "target"]
    r = df.agg(F.avg("feature_0").alias("m"), F.min("target").alias("lo"), F.max("target").alias("hi")).first()
    assert abs(r["m"]) < 0.2 and (r["lo"], r["hi"]) == (0, 1)


def test_approx_opt_ins(spark):
    from featpipe.operators import features, relational

    df = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v")
    a = {r["g"]: r["q50"] for r in features.approx_quantiles(df, "v", [0.5], ["g"]).collect()}
    e = {r["g"]: r["q50"] for r in features.exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert all(abs(a[g] - e[g]) <= 6 for g in e)
    d = relational.distinct_counts(df, ["g"], ["v"], approx=True).collect()
    assert all(abs(r["n_distinct_v"] - 333) < 40 for r in d)


def test_python_data_source_plugin(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Countdown(DataSource):
        @classmethod
        def name(cls):
            return "fp_countdown"

        def schema(self):
            return "n int"

        def reader(self, schema):
            return CountdownReader()

    class CountdownReader(DataSourceReader):
        def read(self, partition):
            for i in range(3, 0, -1):
                yield (i,)

    remote.register_python_source(spark, Countdown)
    assert sorted(r.n for r in spark.read.format("fp_countdown").load().collect()) == [1, 2, 3]


def test_training_by_loss(spark):
    df = spark.range(300).selectExpr("CAST(id % 3 AS DOUBLE) AS y", "CAST(id % 3 AS DOUBLE) * 2.0 + rand(1) AS x1",
                                     "rand(2) AS x2")
    m, vec = scoring.train(df, ["x1", "x2"], "y", "mse")
    assert abs(m.coefficients[0] - 0.5) < 0.1
    m, vec = scoring.train(df, ["x1", "x2"], "y", "cross_entropy", maxIter=50)
    pred = m.transform(vec.transform(df.withColumn("label", df.y)))
    assert pred.where("prediction = label").count() > 250
    m, vec = scoring.train(df, ["x1", "x2"], "y", "cross_entropy", hidden=[4], maxIter=100, seed=1)
    assert m.transform(vec.transform(df)).count() == 300


def test_evaluate_by_task(spark):
    from pyspark.sql import functions as F

    rows = [(0.1, 0), (0.9, 1), (0.2, 0), (0.8, 1)]
    with pytest.raises(ValueError, match="needs 10"):
        evaluation.evaluate(spark.createDataFrame(rows, "score double, label int"), "binary", "label", score="score")
    bad = [(None, 1), (float("nan"), 0), (float("inf"), 1), (0.7, None)]  # none of these four counts anywhere
    df = spark.createDataFrame(rows * 3 + bad, "score double, label int")
    got = {r["name"]: r["value"] for r in evaluation.evaluate(df, "binary", "label", score="score").collect()}
    assert got["accuracy"] == 1.0 and got["auc"] == 1.0 and set(got) == set(evaluation.TASK_METRICS["binary"])
    reg = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5)], "y double, p double")
    r = {x["name"]: (x["value"], x["higher_is_better"]) for x in
         evaluation.evaluate(reg, "regression", "y", pred="p").collect()}
    assert r["mse"] == (0.25, False) and r["r2"][1] is True


def test_early_stopping_matches_training_loop(spark):
    import random

    from featpipe.operators import tracking

    rng = random.Random(5)
    rows, expected = [], {}
    for run in range(6):
        losses = [round(rng.uniform(0, 1), 3) for _ in range(rng.randint(1, 15))]
        best, best_epoch, since, stop = float("inf"), None, 0, None
        for epoch, v in enumerate(losses, start=1):  # the reference's loop, epochs numbered from 1
            if v < best:
                best, best_epoch, since = v, epoch, 0
            else:
                since += 1
            if stop is None and since >= 3:
                stop = epoch
        expected[run] = (len(losses), best_epoch, best, stop)
        rows += [(run, i, v) for i, v in enumerate(losses)]
    df = spark.createDataFrame(rows, "run int, step int, loss double")
    for n_buckets in (None, 4):
        got = {r["run"]: (r["n_epochs"], r["best_epoch"], r["best_loss"], r["stop_epoch"])
               for r in tracking.early_stopping(df, "run", ["step"], "loss", patience=3, n_buckets=n_buckets).collect()}
        assert got == expected


def test_read_table_lists_files_anew(spark, tmp_path):
    from featpipe.sources.tables import read_table

    d = str(tmp_path)
    spark.range(3).withColumn("p", F.lit(1)).write.partitionBy("p").parquet(f"{d}/t.parquet")
    assert read_table(spark, d, "t").count() == 3
    # a file put into a partition folder leaves the top folder as it was
    spark.range(5).coalesce(1).write.mode("append").parquet(f"{d}/t.parquet/p=1")
    assert read_table(spark, d, "t").count() == 8
