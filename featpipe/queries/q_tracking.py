"""Run-tracking queries. The events table stands in for a metric log: run = user_id,
metric = event_type, step = event_id, value = value; orders stand in for versioned
registry rows (name = o_custkey, version = order of o_orderkey)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featpipe.functions.columns import round_to
from featpipe.operators import tracking as TR
from featpipe.plans import ordered
from featpipe.queries import query
from featpipe.sources.tables import read_table


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


@query("trk1_latest_version_per_name", "TRK1", oracle="""
SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus,
       arg_max(o_orderdate, o_orderkey) AS o_orderdate
FROM orders GROUP BY o_custkey
""")
def trk1_latest_version_per_name(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return TR.latest_per_key(o, ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderdate"])


@query("trk2_next_version", "TRK2", oracle="""
WITH v AS (SELECT o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders)
SELECT o_custkey, COALESCE(MAX(version), 0) + 1 AS next_version FROM v GROUP BY o_custkey
""")
def trk2_next_version(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    # version numbers per name with the range-split row number (a name may hold many rows)
    v = ordered.row_number(o.select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "version")
    return TR.next_version(v, "o_custkey", "version").withColumn("next_version", F.col("next_version").cast("bigint"))


@query("trk3_list_filtered_newest_first", "TRK3 SRT1", oracle="""
SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20
""")
def trk3_list_filtered_newest_first(spark, sf_dir):
    e = _events(spark, sf_dir)
    return TR.list_filtered(e, {"event_type": "error"}, "ts", 20, tie="event_id").select("event_id", "user_id", "ts")


@query("trk4_metric_history_by_step", "TRK4", oracle="""
SELECT user_id, event_id AS step, value FROM events WHERE event_type = 'purchase' ORDER BY user_id, event_id
""")
def trk4_metric_history_by_step(spark, sf_dir):
    e = _events(spark, sf_dir)
    h = TR.metric_history(e, "event_id", {"event_type": "purchase"}, ["user_id"])
    return h.select("user_id", F.col("event_id").alias("step"), "value")


@query("trk5_latest_metric_per_run", "TRK5", oracle="""
SELECT user_id, event_type, arg_max(value, event_id) AS value, MAX(event_id) AS step FROM events GROUP BY 1, 2
""")
def trk5_latest_metric_per_run(spark, sf_dir):
    e = _events(spark, sf_dir)
    return TR.latest_per_key(e, ["user_id", "event_type"], ["event_id"], ["value", "event_id"]) \
        .withColumnRenamed("event_id", "step")


@query("trk6_best_checkpoint_per_run", "TRK6", oracle="""
SELECT user_id, arg_min(event_id, (value, event_id)) AS best_event_id, MIN(value) AS best_value
FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY user_id
""")
def trk6_best_checkpoint_per_run(spark, sf_dir):
    e = _events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return TR.best_per_key(e, ["user_id"], "event_id", "value")


@query("trk7_best_epoch_early_stop", "TRK7", oracle="""
WITH r AS (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events),
p AS (SELECT *, MIN(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        AS prev_min FROM r),
i AS (SELECT *, MAX(CASE WHEN prev_min IS NULL OR value < prev_min THEN epoch END)
        OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM p)
SELECT user_id, COUNT(*) AS n_epochs, arg_min(epoch, (value, epoch)) AS best_epoch, MIN(value) AS best_loss,
       MIN(CASE WHEN epoch - last_imp >= 5 THEN epoch END) AS stop_epoch
FROM i GROUP BY user_id
""")
def trk7_best_epoch_early_stop(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = TR.early_stopping(e, "user_id", ["ts", "event_id"], "value", patience=5)
    return out.select("user_id", "n_epochs", F.col("best_epoch").cast("bigint").alias("best_epoch"), "best_loss",
                      F.col("stop_epoch").cast("bigint").alias("stop_epoch"))


@query("trk8_metrics_json_compare_runs", "TRK8 PRJ14", oracle="""
SELECT user_id,
       round(AVG(CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END), 9) AS click,
       round(AVG(CASE WHEN event_type = 'purchase' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END), 9) AS purchase,
       round(AVG(CASE WHEN event_type = 'view' THEN CAST(json_extract(props, '$.k') AS DOUBLE) END), 9) AS view
FROM events GROUP BY user_id
""")
def trk8_metrics_json_compare_runs(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = TR.metrics_json_rows(e, ["user_id", "event_type"], "props").where(F.col("metric") == "k")
    per = rows.groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    wide = TR.compare(per, "user_id", "event_type", "v", ["click", "purchase", "view"])
    return wide.select("user_id", *[round_to(c, 9).alias(c) for c in ("click", "purchase", "view")])


@query("trk10_retention_counts", "TRK10", oracle="""
SELECT COUNT(*) FILTER (WHERE o_orderstatus IN ('F') AND o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 30 DAY)
         AS to_remove,
       COUNT(*) FILTER (WHERE NOT (o_orderstatus IN ('F') AND o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 30 DAY))
         AS to_keep
FROM orders
""")
def trk10_retention_counts(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    remove, keep = TR.retention(o, "o_orderstatus", "o_orderdate", 30, "1998-08-02", finished=("F",))
    return remove.agg(F.count("*").alias("to_remove")).select("to_remove", keep.agg(F.count("*")).scalar().alias("to_keep"))


@query("trk12_metric_type_from_name", "TRK12", oracle="""
WITH m AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'val_' WHEN event_id % 3 = 1 THEN 'test_' ELSE '' END
                  || event_type AS metric_name FROM events)
SELECT metric_name, CASE WHEN contains(metric_name, 'val_') OR contains(metric_name, 'validation_') THEN 'validation'
                         WHEN contains(metric_name, 'test_') THEN 'test' ELSE 'train' END AS metric_type,
       COUNT(*) AS n
FROM m GROUP BY 1, 2
""")
def trk12_metric_type_from_name(spark, sf_dir):
    e = _events(spark, sf_dir)
    prefix = F.when(F.col("event_id") % 3 == 0, "val_").when(F.col("event_id") % 3 == 1, "test_").otherwise("")
    m = e.select(F.concat(prefix, F.col("event_type")).alias("metric_name"))
    return m.groupBy("metric_name", TR.metric_type("metric_name").alias("metric_type")).agg(F.count("*").alias("n"))


@query("trk5_store_latest_metrics", "TRK5 TRK12 SNK6", oracle="""
SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS metric_name, 'train' AS metric_type,
       arg_max(value, event_id) AS value, CAST(MAX(event_id) AS INTEGER) AS step, CAST(NULL AS INTEGER) AS epoch
FROM events GROUP BY user_id, event_type
""")
def trk5_store_latest_metrics(spark, sf_dir):
    from featpipe.operators.tracking_store import TrackingStore
    from featpipe.sources.files import scratch_path

    store = TrackingStore(spark, scratch_path(spark, "tracking"))
    e = _events(spark, sf_dir)
    store.append("training_metrics", e.select(
        F.col("event_id").cast("string").alias("metric_id"), F.col("user_id").cast("string").alias("run_id"),
        F.col("event_type").alias("metric_name"), TR.metric_type("event_type").alias("metric_type"),
        F.col("event_id").cast("int").alias("step"), F.col("value"), F.col("ts").cast("timestamp").alias("timestamp")))
    return store.latest_metrics()
