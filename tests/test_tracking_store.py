"""Tracking tables: typed appends and the analytics the tracking services run."""

import datetime as dt

from featpipe.operators.tracking_store import JOB_STATUSES, TrackingStore

T0 = dt.datetime(2024, 1, 1)


def _ts(days):
    return T0 + dt.timedelta(days=days)


def test_store_roundtrip_and_analytics(spark, tmp_path):
    st = TrackingStore(spark, str(tmp_path / "tracking"))
    assert st.table("models").count() == 0 and "version" in st.table("models").columns
    st.append("models", spark.createDataFrame(
        [("m1", "net", "churn", 1, _ts(0)), ("m2", "net", "churn", 2, _ts(1)), ("m3", "net", "fraud", 1, _ts(2))],
        "id string, type string, name string, version int, created_at timestamp"))
    latest = {r["name"]: r["id"] for r in st.latest_models().collect()}
    assert latest == {"churn": "m2", "fraud": "m3"}
    assert {r["name"]: r["next_version"] for r in st.next_versions().collect()} == {"churn": 3, "fraud": 2}

    st.append("training_runs", spark.createDataFrame(
        [("r1", "m1", "completed", _ts(0)), ("r2", "m2", "running", _ts(3)), ("r3", "m2", "completed", _ts(5))],
        "run_id string, model_id string, status string, created_at timestamp"))
    assert [r["run_id"] for r in st.list_runs(status="completed").collect()] == ["r3", "r1"]
    assert [r["run_id"] for r in st.list_runs(limit=1).collect()] == ["r3"]

    st.append("training_metrics", spark.createDataFrame(
        [("a", "r1", "loss", "train", 1, 0, 0.9), ("b", "r1", "loss", "train", 2, 0, 0.7),
         ("c", "r1", "val_loss", "validation", 2, 0, 0.8), ("d", "r2", "loss", "train", 1, 0, 1.1)],
        "metric_id string, run_id string, metric_name string, metric_type string, step int, epoch int, value double"))
    assert [r["value"] for r in st.metric_history("r1", "loss").collect()] == [0.9, 0.7]
    lm = {(r["run_id"], r["metric_name"]): r["value"] for r in st.latest_metrics().collect()}
    assert lm[("r1", "loss")] == 0.7 and lm[("r2", "loss")] == 1.1

    st.append("training_checkpoints", spark.createDataFrame(
        [("c1", "r1", 1, '{"val_loss": 0.5}'), ("c2", "r1", 2, '{"val_loss": 0.4}'), ("c3", "r2", 1, '{"val_loss": 0.9}')],
        "checkpoint_id string, run_id string, epoch int, metrics string"))
    best = {r["run_id"]: r["best_checkpoint_id"] for r in st.best_checkpoints().collect()}
    assert best == {"r1": "c2", "r2": "c3"}

    st.delete_run("r1")
    assert st.table("training_metrics").where("run_id = 'r1'").count() == 0
    assert st.table("training_checkpoints").count() == 1 and st.table("training_runs").count() == 2


def test_job_counts_and_retention(spark, tmp_path):
    st = TrackingStore(spark, str(tmp_path / "jobs"))
    st.append("jobs", spark.createDataFrame(
        [("j1", "COMPLETED", _ts(0)), ("j2", "FAILED", _ts(1)), ("j3", "RUNNING", _ts(2)), ("j4", "COMPLETED", _ts(50))],
        "job_id string, status string, created_at timestamp"))
    counts = {r["status"]: r["n"] for r in st.job_status_counts().collect()}
    assert counts["COMPLETED"] == 2 and counts["CANCELLED"] == 0 and counts["total"] == 4
    assert set(counts) == set(JOB_STATUSES) | {"total"}
    assert st.apply_retention(30, "2024-02-25") == 2
    assert sorted(r["job_id"] for r in st.table("jobs").collect()) == ["j3", "j4"]


def test_plan_steps_and_evaluation_json(spark, tmp_path):
    st = TrackingStore(spark, str(tmp_path / "plans"))
    st.append("plan_executions", spark.createDataFrame(
        [("e1", "p1", "data", "completed", _ts(1)), ("e2", "p1", "data", "completed", _ts(2)),
         ("e3", "p1", "train", "failed", _ts(3))],
        "id string, plan_id string, step_type string, status string, completed_at timestamp"))
    got = {(r["plan_id"], r["step_type"]): r["id"] for r in st.latest_completed_steps().collect()}
    assert got == {("p1", "data"): "e2"}
    st.append("evaluation_runs", spark.createDataFrame(
        [("v1", "m1", '{"accuracy": 0.9, "auc": 0.95}')], "run_id string, model_id string, metrics_result string"))
    rows = {r["metric"]: r["value"] for r in st.evaluation_metric_rows().collect()}
    assert rows == {"accuracy": 0.9, "auc": 0.95}
