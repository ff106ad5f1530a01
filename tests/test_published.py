"""Publishing is all or nothing; versions and states survive a round trip."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from featpipe.operators import features as FE
from featpipe.operators import scoring
from featpipe.operators.feature_graph import FeaturePipeline, PipelineError, load_states, save_states
from featpipe.operators.tracking_store import TrackingStore
from featpipe.plans.published import Published, PublishConflict
from featpipe.plans.steps import StepRunner, StepSpec


def _spec(n):
    return StepSpec.from_dict({"name": "p", "steps": [
        {"name": "a", "type": "table", "sql": f"SELECT id FROM range({n})"},
        {"name": "b", "type": "table", "depends_on": ["a"], "sql": "SELECT id * 2 AS twice FROM a"}], "outputs": ["a", "b"]})


def test_a_failed_publication_leaves_both_old_tables(spark, tmp_path, monkeypatch):
    runner = StepRunner(spark, table_root=str(tmp_path))
    rep, out = runner.run(_spec(5))
    assert rep.ok and out["a"].count() == out["b"].count() == 5 and rep.outputs["b"]["rows"] == 5

    def refuse(*_):
        raise RuntimeError("the pointer could not be written")

    monkeypatch.setattr(runner.published, "publish", refuse)
    rep, _ = runner.run(_spec(9))
    assert not rep.ok and "pointer" in rep.error
    monkeypatch.undo()
    assert spark.read.parquet(runner.table_path("a")).count() == spark.read.parquet(runner.table_path("b")).count() == 5
    rep, _ = runner.run(_spec(7))
    assert rep.ok and spark.read.parquet(runner.table_path("b")).count() == 7


def test_an_empty_table_is_published_with_its_count(spark, tmp_path):
    rep, out = StepRunner(spark, table_root=str(tmp_path)).run(_spec(0))
    assert rep.ok and rep.outputs["a"]["rows"] == 0 and out["b"].count() == 0


def test_vacuum_keeps_the_last_versions(spark, tmp_path):
    runner = StepRunner(spark, table_root=str(tmp_path))
    for n in (1, 2, 3, 4):
        runner.run(_spec(n))
    Published(spark, str(tmp_path)).vacuum(keep=2)
    assert len(list((tmp_path / "_pointers").glob("*.json"))) == 2
    assert spark.read.parquet(runner.table_path("a")).count() == 4
    assert len(list((tmp_path / "_versions").glob("*/a"))) == 2


def test_delete_run_rewrites_three_tables_together(spark, tmp_path):
    store = TrackingStore(spark, str(tmp_path))
    for t in ("training_runs", "training_metrics", "training_checkpoints"):
        store.append(t, spark.createDataFrame([("r1",), ("r2",)], "run_id string"))
    store.delete_run("r1")
    for t in ("training_runs", "training_metrics", "training_checkpoints"):
        assert [r.run_id for r in store.table(t).collect()] == ["r2"]
    store.append("training_runs", spark.createDataFrame([("r3",)], "run_id string"))
    assert sorted(r.run_id for r in store.table("training_runs").collect()) == ["r2", "r3"]
    assert len(list((tmp_path / "_pointers").glob("*.json"))) == 1


def test_vocabulary_versions_stay_readable(spark, tmp_path):
    path = str(tmp_path / "v")
    for version, values in ((1, ["a", "b"]), (2, ["a", "b", "c"])):
        v = FE.fit_label_encoder(spark.createDataFrame([(x,) for x in values], "x string"), "x")
        v.version = version
        FE.save_vocabulary(v, path)
    assert FE.load_vocabulary(spark, path, "x", 1).size == 2 and FE.load_vocabulary(spark, path, "x").size == 3
    with pytest.raises(FE.FeatureError, match="no version 9"):
        FE.load_vocabulary(spark, path, "x", 9)


def test_whole_pipeline_state_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "x", 0.0), (2.0, "y", 1.0), (4.0, "x", 1.0)], "a double, c string, y double")
    enc = FE.fit_target_encoder(df, "c", "y", 2.0)
    states = {"numbers": FE.fit_standard_scaler(df, ["a"]), "words": FE.fit_label_encoder(df, "c"), "target": enc,
              "odd": {"kind": "odd", "list": [1, 2.5, None, "t", True, {"deep": []}], "empty": {}}}
    save_states(spark, states, str(tmp_path / "s"))
    back = load_states(spark, str(tmp_path / "s"))
    assert back["numbers"] == states["numbers"] and back["odd"] == states["odd"]
    assert sorted(map(tuple, back["words"].frame.collect())) == sorted(map(tuple, states["words"].frame.collect()))
    a, b = (FE.target_encode(df, e, "t").orderBy("a").collect() for e in (enc, back["target"]))
    assert a == b


def test_specs_that_name_nothing_are_errors(spark):
    for spec in ({}, {"processors": []}, {"processors": [{"op": "fit.unknown", "outputs": {"states.a": "state"}}]},
                 {"processors": [{"op": "fit.label_encoder", "inputs": {"x": "c"}, "outputs": {"states.a": "output"}}]}):
        with pytest.raises(PipelineError):
            FeaturePipeline(spec)


def test_training_names_rows_that_cannot_train(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(20)] + [(None, 1.0), (float("nan"), 1.0)], "x double, y double")
    with pytest.raises(scoring.ScoringError, match="'x': 2"):
        scoring.train(df, ["x"], "y", "mse")
    model, _ = scoring.train(df, ["x"], "y", "mse", invalid="skip", solver="normal")
    assert abs(model.coefficients[0] - 2.0) < 1e-6


def test_text_ranges_beyond_one_search_tree(spark):
    from featpipe.plans import ordered

    values = sorted({f"{i * 7919 % 5000:05d}" for i in range(5000)})
    df = spark.createDataFrame([(v,) for v in values], "s string")
    bounds = values[3::7]
    got = {r.s: r.b for r in df.select("s", ordered.bucket_of(F.col("s"), bounds, df.schema["s"].dataType, fan=16).alias("b")).collect()}
    import bisect

    assert all(got[v] == bisect.bisect_right(bounds, v) for v in values)


def test_a_failing_output_leaves_the_old_tables(spark, tmp_path):
    """A view output is computed before the commit: its failing cast publishes and deletes nothing."""
    runner = StepRunner(spark, table_root=str(tmp_path))

    def spec(value):
        return StepSpec.from_dict({"name": "p", "steps": [
            {"name": "kept", "type": "table", "sql": f"SELECT '{value}' AS x"},
            {"name": "seen", "type": "view", "depends_on": ["kept"], "sql": "SELECT CAST(x AS INT) AS n FROM kept WHERE CAST(x AS INT) > 0"}],
            "outputs": ["kept", "seen"]})

    first, _ = runner.run(spec("7"))
    assert first.ok and {k: v["rows"] for k, v in first.outputs.items()} == {"kept": 1, "seen": 1}
    before = runner.table_path("kept")
    rep, out = runner.run(spec("seven"))
    assert not rep.ok and rep.failed_step == "seen" and not rep.outputs and not out
    assert runner.table_path("kept") == before and spark.read.parquet(before).first().x == "7"
    assert len(list((tmp_path / "_versions").glob("*/kept"))) == 1  # what was staged is gone
    # a view that is no output and is not computed does not hold the tables back
    lazy = spec("seven")
    lazy.outputs = ["kept"]
    assert runner.run(lazy)[0].ok and spark.read.parquet(runner.table_path("kept")).first().x == "seven"


def test_nothing_is_computed_or_deleted_after_the_commit(spark, tmp_path, monkeypatch):
    runner = StepRunner(spark, table_root=str(tmp_path))
    publish, done = runner.published.publish, []
    monkeypatch.setattr(runner.published, "publish", lambda *a: done.append(publish(*a)))
    monkeypatch.setattr(runner, "_rollback", lambda *a: pytest.fail("rolled back"))
    jobs = spark.sparkContext.statusTracker()
    seen = {}
    report = runner.run(_spec(3))
    seen["after"] = jobs.getActiveJobsIds()
    assert report[0].ok and done == [1] and not seen["after"] and report[0].outputs["b"]["rows"] == 3


def test_two_publishers_of_different_tables_both_commit(spark, tmp_path):
    a, b = Published(spark, str(tmp_path)), Published(spark, str(tmp_path))
    base = a.version()
    assert a.publish({"x": "fx"}, [], base) == 1
    assert b.publish({"y": "fy"}, [], base) == 2  # built upon a's commit, which did not touch y
    assert a.current() == {"x": "fx", "y": "fy"}
    with pytest.raises(PublishConflict, match="x of .* changed in commit 1"):
        b.publish({"x": "other", "z": "fz"}, [], base)
    with pytest.raises(PublishConflict):
        b.publish({}, ["y"], base)
    assert a.current() == {"x": "fx", "y": "fy"} and b.publish({"x": "later"}) == 3


def test_runs_at_the_same_time_never_lose_a_table(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: Published(spark, str(tmp_path)).publish({f"t{k}": f"f{k}"}, [], 0), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    assert Published(spark, str(tmp_path)).current() == {f"t{k}": f"f{k}" for k in range(24)}
    assert not list((tmp_path / "_pointers").glob("*.tmp"))
    # the same table: one wins, the others are told so and publish nothing
    def one(k):
        try:
            return Published(spark, str(tmp_path)).publish({"same": f"s{k}"}, [], 24)
        except PublishConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [n for n in pool.map(one, range(8)) if n]
    assert won == [25] and len(Published(spark, str(tmp_path)).current()) == 25


def test_a_run_that_lost_its_table_keeps_the_winner(spark, tmp_path, monkeypatch):
    slow, quick = StepRunner(spark, table_root=str(tmp_path)), StepRunner(spark, table_root=str(tmp_path))
    publish = slow._publish

    def late(*a):
        assert quick.run(_spec(4))[0].ok
        publish(*a)

    monkeypatch.setattr(slow, "_publish", late)
    rep, _ = slow.run(_spec(9))
    assert not rep.ok and "changed in commit 1" in rep.error
    assert spark.read.parquet(slow.table_path("a")).count() == 4
    monkeypatch.undo()
    assert slow.run(_spec(9))[0].ok and spark.read.parquet(quick.table_path("a")).count() == 9


def test_pointers_of_the_first_format_are_read(spark, tmp_path):
    (tmp_path / "_pointers").mkdir()
    (tmp_path / "_pointers" / "000000000001.json").write_text('{"tables": "f0", "a": "f1"}')
    p = Published(spark, str(tmp_path))
    assert p.current() == {"tables": "f0", "a": "f1"} and p.publish({"b": "f2"}) == 2
    assert p.current() == {"tables": "f0", "a": "f1", "b": "f2"}
