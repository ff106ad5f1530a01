"""Streaming queries (STR1-STR3): each drains a file-source stream of a test table and returns
the sink contents; results must equal the batch computation."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from featpipe.functions.columns import round_to
from featpipe.operators import features as FE
from featpipe.queries import query
from featpipe.sources.files import scratch_path
from featpipe.sources.tables import read_table
from featpipe.streaming import streams


@query("str1_stream_scaled_events", "STR1 FEA3 FEA19", oracle="""
WITH s AS (SELECT AVG(value) AS m, STDDEV(value) AS sd FROM events)
SELECT event_id, user_id, round((value - m) / sd, 9) AS value_z FROM events, s
""")
def str1_stream_scaled_events(spark, sf_dir):
    from featpipe.operators.feature_graph import load_numeric_state, save_numeric_state

    src = os.path.join(sf_dir, "events.parquet")
    batch = read_table(spark, sf_dir, "events")
    # fitted once in batch, saved as typed state, loaded back by the streaming job
    state_path = scratch_path(spark, "scaler_state")
    save_numeric_state(spark, FE.fit_standard_scaler(batch, ["value"]), state_path)
    state = load_numeric_state(spark, state_path, "standard")

    def fn(df):
        return df.select("event_id", "user_id", round_to(FE.standard_scale(state, "value"), 9).alias("value_z"))

    base = scratch_path(spark, "events_scaled")
    streams.transform_stream(spark, src, batch.schema, fn, base)
    return streams.transform_stream(spark, src, batch.schema, fn, base)  # started again: resumes, nothing twice


@query("str2_stream_daily_metrics", "STR2", oracle="""
SELECT date_trunc('day', ts) AS window_start, event_type, COUNT(*) AS n, round(SUM(value), 2) AS total
FROM events GROUP BY 1, 2
""")
def str2_stream_daily_metrics(spark, sf_dir):
    src = os.path.join(sf_dir, "events.parquet")
    schema = read_table(spark, sf_dir, "events").schema
    base = scratch_path(spark, "daily_metrics")
    aggs = [F.count("*").alias("n"), F.sum("value").alias("total")]
    streams.windowed_metrics(spark, src, schema, "ts", ["event_type"], aggs, base)
    out, _ = streams.windowed_metrics(spark, src, schema, "ts", ["event_type"], aggs, base)  # started again
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n",
                      round_to("total", 2).alias("total"))


@query("str3_stream_latest_status", "STR3 TRK5", oracle="""
SELECT user_id, arg_max(event_type, event_id) AS event_type, MAX(event_id) AS event_id FROM events GROUP BY user_id
""")
def str3_stream_latest_status(spark, sf_dir):
    src = os.path.join(sf_dir, "events.parquet")
    schema = read_table(spark, sf_dir, "events").schema
    base = scratch_path(spark, "latest_status")
    streams.latest_per_key_stream(spark, src, schema, "user_id", "event_id", "event_type", base)
    return streams.latest_per_key_stream(spark, src, schema, "user_id", "event_id", "event_type", base)  # started again
