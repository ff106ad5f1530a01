"""SQL step graphs: ordering, variables, outputs, dry run, atomic publish."""

import pytest

from featpipe.plans.steps import SpecError, StepRunner, StepSpec, order_steps, substitute


def _spec(steps, outputs, vars=None):
    return StepSpec.from_dict({"name": "t", "steps": steps, "outputs": outputs, "vars": vars})


@pytest.fixture
def runner(spark, tmp_path):
    return StepRunner(spark, table_root=str(tmp_path / "tables"))


def test_single_step_literal(runner):
    rep, out = runner.run(_spec([{"name": "lit", "type": "view", "sql": "SELECT 1 as id, 'test' as value"}], ["lit"]))
    assert rep.ok and out["lit"].collect()[0].asDict() == {"id": 1, "value": "test"}
    assert rep.outputs["lit"]["rows"] == 1 and rep.outputs["lit"]["schema"] == [("id", "int"), ("value", "string")]
    assert "SELECT 1 as id" in rep.sql_text


def test_chain_and_two_outputs_with_table(runner, spark):
    steps = [
        {"name": "c", "type": "view", "depends_on": ["b"], "sql": 'SELECT id * 10 AS id FROM "b"'},
        {"name": "a", "type": "table", "sql": "SELECT explode(sequence(1, ${n})) AS id"},
        {"name": "b", "type": "view", "depends_on": ["a"], "sql": "SELECT id + 1 AS id FROM a;"},
    ]
    rep, out = runner.run(_spec(steps, ["c", "a"], {"n": 3}))
    assert rep.ok, rep.error
    assert rep.executed == ["a", "b", "c"]
    assert sorted(r.id for r in out["c"].collect()) == [20, 30, 40]
    assert rep.outputs["a"]["rows"] == 3
    assert sorted(r.id for r in spark.table("a").collect()) == [1, 2, 3]  # published table is registered


def test_failure_rolls_back(runner, spark):
    ok, _ = runner.run(_spec([{"name": "keep", "type": "table", "sql": "SELECT 1 AS x"}], ["keep"]))
    assert ok.ok
    steps = [{"name": "keep", "type": "table", "sql": "SELECT 2 AS x"},
             {"name": "boom", "type": "view", "depends_on": ["keep"], "sql": "SELECT no_such_col FROM keep"}]
    rep, _ = runner.run(_spec(steps, ["boom"]))
    assert not rep.ok and rep.failed_step == "boom"
    assert [r.x for r in spark.read.parquet(runner.table_path("keep")).collect()] == [1]
    assert [r.x for r in spark.table("keep").collect()] == [1]


def test_dry_run_leaves_nothing(runner, spark):
    ok, err = runner.dry_run(_spec([{"name": "dry_only", "type": "table", "sql": "SELECT 1 AS x"}], ["dry_only"]))
    assert ok and err is None
    assert not any(t.name == "dry_only" for t in spark.catalog.listTables())
    ok, err = runner.dry_run(_spec([{"name": "bad", "type": "view", "sql": "SELECT * FROM missing_table_xyz"}], ["bad"]))
    assert not ok and "bad" in err


def test_syntax_error_reported_before_running(runner):
    rep, _ = runner.run(_spec([{"name": "s", "type": "view", "sql": "SELEC 1"}], ["s"]))
    assert not rep.ok and "syntax" in rep.error and rep.failed_step == "s"


def test_cycle_and_spec_checks():
    steps = [{"name": "a", "type": "view", "sql": "SELECT 1", "depends_on": ["b"]},
             {"name": "b", "type": "view", "sql": "SELECT 1", "depends_on": ["a"]}]
    with pytest.raises(SpecError, match="a -> b -> a|b -> a -> b"):
        order_steps(_spec(steps, ["a"]))
    from featpipe.plans.steps import validate

    with pytest.raises(SpecError, match="duplicate"):
        validate(_spec([{"name": "a", "type": "view", "sql": "x"}, {"name": "a", "type": "view", "sql": "y"}], ["a"]))
    with pytest.raises(SpecError, match="execute"):
        validate(_spec([{"name": "e", "type": "execute", "sql": "DROP VIEW IF EXISTS x"}], ["e"]))
    with pytest.raises(SpecError, match="type"):
        validate(_spec([{"name": "e", "type": "tbl", "sql": "SELECT 1"}], ["e"]))


def test_variables():
    assert substitute("WHERE d > '${min_date}'", {"min_date": "2024-01-01"}) == "WHERE d > '2024-01-01'"
    with pytest.raises(SpecError, match="min_date"):
        substitute("WHERE d > '${min_date}'", None)


def test_drop_kind_checks(runner, spark):
    spark.sql("SELECT 1 AS x").createOrReplaceTempView("some_view")
    rep, _ = runner.run(_spec([{"name": "d", "type": "execute", "sql": 'DROP TABLE IF EXISTS "some_view"'},
                               {"name": "o", "type": "view", "sql": "SELECT 1 AS y"}], ["o"]))
    assert not rep.ok and "view" in rep.error
    rep, _ = runner.run(_spec([{"name": "d", "type": "execute", "sql": 'DROP VIEW IF EXISTS "some_view"'},
                               {"name": "o", "type": "view", "sql": "SELECT 1 AS y"}], ["o"]))
    assert rep.ok and not any(t.name == "some_view" for t in spark.catalog.listTables())


def test_operator_step(runner, spark):
    spark.range(100).selectExpr("id", "id % 2 AS y").createOrReplaceTempView("src_ids")
    steps = [{"name": "sp", "type": "view", "op": "stratified_split",
              "args": {"source": "src_ids", "target": "y", "order_by": "id"}},
             {"name": "cnt", "type": "view", "depends_on": ["sp"],
              "sql": "SELECT split, COUNT(*) AS n FROM sp GROUP BY split"}]
    rep, out = runner.run(_spec(steps, ["cnt"]))
    assert rep.ok, rep.error
    assert {r.split: r.n for r in out["cnt"].collect()} == {"training": 80, "validation": 20}


YAML_SPEC = """
name: cleaning
description: zero means missing
vars:
  min_value: 0
steps:
  - name: drop_old
    type: execute
    depends_on: []
    sql: DROP VIEW IF EXISTS "cleaned"
  - name: raw_rows
    type: view
    depends_on: []
    sql: |
      SELECT * FROM VALUES (1, 0.0, 5), (2, 3.5, 0), (3, 2.0, 7) AS t(column0, column1, column2)
  - name: cleaned
    type: view
    depends_on: [drop_old, raw_rows]
    sql: |
      SELECT column0,
             CASE WHEN column1 = 0 THEN NULL ELSE column1 END AS column1,
             CASE WHEN column2 = 0 THEN NULL ELSE column2 END AS column2
      FROM "raw_rows"
      WHERE column0 >= ${min_value}
outputs: [cleaned]
"""


def test_yaml_spec_roundtrip_and_run(runner):
    spec = StepSpec.from_yaml(YAML_SPEC)
    again = StepSpec.from_yaml(spec.to_yaml())
    assert again.to_dict() == spec.to_dict()
    rep, out = runner.run(spec)
    assert rep.ok, rep.error
    rows = sorted(tuple(r) for r in out["cleaned"].collect())
    assert rows == [(1, None, 5), (2, 3.5, None), (3, 2.0, 7)]


def test_dry_run_with_sample_finds_data_errors(runner, spark):
    spec = _spec([{"name": "bad_cast", "type": "view", "sql": "SELECT CAST('abc' AS INT) AS x"}], ["bad_cast"])
    ok, _ = runner.dry_run(spec)
    assert ok  # analysis alone cannot see it
    ok, err = runner.dry_run(spec, sample=10)
    assert not ok and "bad_cast" in err
    assert not any(t.name == "bad_cast" for t in spark.catalog.listTables())
