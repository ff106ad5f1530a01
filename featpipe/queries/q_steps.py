"""SQL step-graph queries (PIP1, PIP13, SNK2-3)."""

from __future__ import annotations

from featpipe.plans.steps import StepSpec, run_steps
from featpipe.queries import query
from featpipe.queries.q_splits import FLAGSHIP_ORACLE
from featpipe.session import checkpoint_root
from featpipe.sources.tables import register_tables


def _table_root(spark, sf_dir: str) -> str:
    """Published tables of these queries live per data folder, so runs over different folders
    (the smoke run and the checks) never replace each other's tables."""
    import hashlib
    import os

    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:10]
    return f"{checkpoint_root(spark)}/featpipe_tables/{tag}"

TRAINING_SET_SPEC = {
    "name": "orders_training_set",
    "description": "stratified split, statistics from training rows, scaled features",
    "vars": {"positive_status": "'F'"},
    "steps": [
        {"name": "drop_old_training_data", "type": "execute", "depends_on": [],
         "sql": 'DROP VIEW IF EXISTS "orders_training_data"'},
        {"name": "orders_base", "type": "view", "depends_on": ["orders"], "sql": """
            SELECT o_orderkey, o_orderstatus, o_totalprice,
                   CAST(datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS DOUBLE) AS order_day,
                   CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS priority_level
            FROM "orders"
            WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL
              AND o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL"""},
        {"name": "orders_split", "type": "table", "depends_on": ["orders_base"], "op": "stratified_split",
         "args": {"source": "orders_base", "target": "o_orderstatus", "order_by": "o_orderkey"}},
        {"name": "train_stats", "type": "view", "depends_on": ["orders_split"], "sql": """
            SELECT AVG(o_totalprice) AS p_mean, STDDEV(o_totalprice) AS p_std,
                   AVG(order_day) AS d_mean, STDDEV(order_day) AS d_std,
                   AVG(priority_level) AS l_mean, STDDEV(priority_level) AS l_std
            FROM "orders_split" WHERE split = 'training'"""},
        {"name": "orders_training_data", "type": "view",
         "depends_on": ["drop_old_training_data", "orders_split", "train_stats"], "sql": """
            SELECT o_orderkey,
                   round((o_totalprice - (SELECT p_mean FROM train_stats))
                         / NULLIF((SELECT p_std FROM train_stats), 0), 6) AS totalprice_z,
                   round((order_day - (SELECT d_mean FROM train_stats))
                         / NULLIF((SELECT d_std FROM train_stats), 0), 6) AS order_day_z,
                   round((priority_level - (SELECT l_mean FROM train_stats))
                         / NULLIF((SELECT l_std FROM train_stats), 0), 6) AS priority_z,
                   CASE WHEN o_orderstatus = ${positive_status} THEN 1 ELSE 0 END AS target,
                   split
            FROM "orders_split";"""},
    ],
    "outputs": ["orders_training_data"],
}


@query("pip1_sql_steps_training_set", "PIP1 PIP2 PIP4 PIP5 PIP6 PIP9 PIP10 SNK2 SNK3 SPL6 JN4", oracle=FLAGSHIP_ORACLE)
def pip1_sql_steps_training_set(spark, sf_dir):
    register_tables(spark, sf_dir, ["orders"])
    report, frames = run_steps(spark, StepSpec.from_dict(TRAINING_SET_SPEC), count_outputs=False,
                                table_root=_table_root(spark, sf_dir))
    if not report.ok:
        raise RuntimeError(report.error)
    return frames["orders_training_data"]


@query("pip13_data_quality_step", "PIP13 AGG4 AGG2", oracle="""
SELECT COUNT(*) AS row_count, COUNT(DISTINCT o_orderkey) AS unique_ids,
       COUNT(*) FILTER (WHERE o_totalprice IS NULL) AS null_totalprice,
       COUNT(*) FILTER (WHERE o_orderdate IS NULL) AS null_orderdate,
       MIN(o_totalprice) AS min_totalprice, MAX(o_totalprice) AS max_totalprice,
       MIN(o_orderdate) AS min_orderdate, MAX(o_orderdate) AS max_orderdate
FROM orders
""")
def pip13_data_quality_step(spark, sf_dir):
    register_tables(spark, sf_dir, ["orders"])
    spec = {"name": "quality", "steps": [{"name": "orders_quality", "type": "view", "sql": """
        SELECT COUNT(*) AS row_count, COUNT(DISTINCT o_orderkey) AS unique_ids,
               count_if(o_totalprice IS NULL) AS null_totalprice,
               count_if(o_orderdate IS NULL) AS null_orderdate,
               MIN(o_totalprice) AS min_totalprice, MAX(o_totalprice) AS max_totalprice,
               MIN(o_orderdate) AS min_orderdate, MAX(o_orderdate) AS max_orderdate
        FROM "orders" """}], "outputs": ["orders_quality"]}
    report, frames = run_steps(spark, spec, count_outputs=False)
    if not report.ok:
        raise RuntimeError(report.error)
    return frames["orders_quality"]


@query("pip12_gated_bounded_preview", "PIP11 PIP12 PIP14", oracle="""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100
""")
def pip12_gated_bounded_preview(spark, sf_dir):
    from featpipe.plans import gate

    register_tables(spark, sf_dir, ["orders"])
    df = gate.query(spark, "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey;")
    return df.limit(100)


@query("pip8_output_report", "PIP8 PIP1 SNK1 SNK3", oracle="""
SELECT 'customer_orders' AS output, 3 AS n_columns, COUNT(*) AS row_count
FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)
UNION ALL
SELECT 'status_totals' AS output, 2 AS n_columns, COUNT(*) AS row_count
FROM (SELECT o_orderstatus FROM orders GROUP BY o_orderstatus)
""")
def pip8_output_report(spark, sf_dir):
    register_tables(spark, sf_dir, ["orders"])
    spec = {"name": "report", "steps": [
        {"name": "customer_orders", "type": "table", "sql": """
            SELECT o_custkey, COUNT(*) AS n_orders, SUM(o_totalprice) AS spent FROM "orders" GROUP BY o_custkey"""},
        {"name": "status_totals", "type": "view", "depends_on": ["customer_orders"], "sql": """
            SELECT o_orderstatus, COUNT(*) AS n FROM "orders" GROUP BY o_orderstatus"""}],
        "outputs": ["customer_orders", "status_totals"]}
    report, _ = run_steps(spark, spec, count_outputs=True, table_root=_table_root(spark, sf_dir))
    if not report.ok:
        raise RuntimeError(report.error)
    rows = [(name, len(info["schema"]), int(info["rows"])) for name, info in report.outputs.items()]
    return spark.createDataFrame(rows, "output string, n_columns int, row_count bigint")


DIALECT_STEP_SQL = """
SELECT CAST(EXTRACT(DOW FROM ts) AS INTEGER) AS dow, CAST(user_id % 10 AS TEXT) AS user_group,
       COUNT(*) AS n, round(SUM(value), 2) AS total
FROM {source}
GROUP BY 1, 2;
"""


@query("pip1_duckdb_dialect_steps", "PIP1 PIP10 SRC5 PRJ9 PRJ6", oracle=DIALECT_STEP_SQL.format(source="events"))
def pip1_duckdb_dialect_steps(spark, sf_dir):
    """The same SQL text DuckDB runs (table function, DOW, TEXT cast, ';') as a pipeline step."""
    import os

    src = "read_parquet('" + os.path.join(sf_dir, "events.parquet") + "')"
    spec = {"name": "dialect", "steps": [{"name": "dow_groups", "type": "view",
                                          "sql": DIALECT_STEP_SQL.format(source=src)}],
            "outputs": ["dow_groups"]}
    report, frames = run_steps(spark, spec, count_outputs=False)
    if not report.ok:
        raise RuntimeError(report.error)
    return frames["dow_groups"]
