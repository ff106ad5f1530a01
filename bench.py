"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through a no-op sink (no driver collect). Before timing, the
headline queries run once on the smallest test tables (sf0.001) so JVM start-up and JIT
compilation are not charged to whichever query happens to run first. The same queries' oracle SQL is timed
in DuckDB on the same files for reference (``duckdb`` field).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pip1_sql_steps_training_set",
    "spl6_scaled_training_set",
    "spl1_stratified_split_orders",
    "jn1_order_customer_nation",
    "jn2_customer_left_join_counts",
    "agg1_user_event_stats",
    "agg5_exact_median_quartiles",
    "win3_time_since_last_event",
    "fea3_standard_scaler_lineitem",
    "fea8_label_encode_unseen_names",
    "fea12_robust_scaler",
    "fea17_target_encoding_segment",
    "scr1_logistic_score_orders",
    "met7_auc_orders",
    "met9_roc_curve_orders",
    "met1_binary_classification_metrics",
    "trk7_best_epoch_early_stop",
    "prf1_numeric_profile_lineitem",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from featpipe.queries import load_all
    from featpipe.session import build_session

    extra = {}
    if os.environ.get("BENCH_EVENT_LOG_DIR"):  # stage and task times, read offline (no UI)
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]}
    spark = build_session(f"local[{cpus}]", app="featpipe-bench", shuffle_partitions=int(cpus), extra=extra)
    reg = load_all()
    names = [n for n in HEADLINE if n in reg]
    # warm-up on the smallest tables (JVM, JIT); not timed
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for n in names:
            reg[n].fn(spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        reg[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    spark.stop()
    duck = {}
    try:
        import duckdb

        from featpipe.sources.tables import TABLES

        con = duckdb.connect()
        con.execute(f"SET threads={int(cpus)}")
        for t in TABLES:
            p = os.path.join(sf_dir, f"{t}.parquet")
            if os.path.exists(p):
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
        for n in names:
            sql = reg[n].oracle
            if not sql:
                continue
            t0 = time.time()
            con.execute(sql).fetchall()
            duck[n] = round(time.time() - t0, 3)
    except Exception as e:  # noqa: BLE001
        duck = {"error": str(e)[:200]}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "duckdb": duck}))


if __name__ == "__main__":
    main()
