"""Structured Streaming jobs (STR1-STR3).

* STR1: stateless feature transform + scoring of a stream with state fitted in batch;
* STR2: windowed aggregates of a metric log with a watermark (update mode, upserted per
  micro-batch so the final table holds the last value of every window);
* STR3: latest value per key (e.g. job status) with ``max_by``, upserted per micro-batch.

Upserted tables are kept as runs: a batch writes its own rows only, and every FAN batches the last FAN runs of a level are
merged into one. A row is so written once per level, and what a batch costs follows the batch, not the table. Readers take, for
every key, the row of the newest run.

The caller names the job's folder (``base``, on shared storage): output in ``data``, Spark's checkpoint in ``_checkpoint``. A
job started again with the same folder resumes where it stopped. ``run_available`` drains the available input
(``availableNow``) and says how many late rows the watermark dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


FAN = 8  # runs of a level that are merged into one of the next
POLL_SECONDS = 0.5


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None
                ) -> DataFrame:
    """A parquet file-source stream. ``path`` is a folder, or a single file (then its folder
    is watched with a name filter)."""
    import os

    r = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet") and os.path.isfile(path):
        folder, name = os.path.split(path)
        return r.option("pathGlobFilter", name).load(folder)
    return r.load(path)


def run_available(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "append",
                  batch_fn: Callable[[DataFrame, int], None] | None = None) -> dict:
    """Process all available input, then stop (``trigger(availableNow=True)``). Returns the number of batches, input
    rows and rows that came too late for the watermark."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if batch_fn is not None:
        q = w.foreachBatch(batch_fn).trigger(availableNow=True).start()
    else:
        q = w.format("parquet").option("path", out_path).trigger(availableNow=True).start()
    seen: dict[tuple, tuple[int, int]] = {}

    def gather() -> None:  # Spark keeps the last hundred batches' progress only
        for p in q.recentProgress:
            p = dict(p) if isinstance(p, dict) else json.loads(p.json)
            seen[p["batchId"], p["timestamp"]] = (
                p.get("numInputRows", 0), sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", [])))

    while not q.awaitTermination(POLL_SECONDS):
        gather()
    gather()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    ids = sorted({b for b, _ in seen})
    if ids and ids[-1] - ids[0] + 1 != len(ids):  # batches are numbered without gaps
        raise RuntimeError("the stream has ended well, but its counts are short: batches went by faster than they were counted")
    return {"batches": len(seen), "rows": sum(n for n, _ in seen.values()), "late_rows": sum(late for _, late in seen.values())}


def transform_stream(spark: SparkSession, src: str, schema: StructType, fn: Callable[[DataFrame], DataFrame],
                     base: str) -> DataFrame:
    """STR1: apply a stateless DataFrame function to a stream; returns the written rows."""
    run_available(fn(read_stream(spark, src, schema)), f"{base}/data", f"{base}/_checkpoint")
    return spark.read.schema(fn(spark.read.schema(schema).parquet(src)).schema).parquet(f"{base}/data")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first batch, last batch) of the finished runs, in order."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("run=")]
    names = [x.getName()[4:].split("-") for x in done if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted((int(a), int(b)) for a, b in names)


def _current(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that no larger one holds. Runs nest or are apart, and their number grows with the logarithm of the batches."""
    return [r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)]


def _newest(spark: SparkSession, path: str, runs: list[tuple[int, int]], keys: list[str], schema: StructType) -> DataFrame:
    """One row per key: that of its newest run. NULL keys are keys."""
    parts = [spark.read.schema(schema).parquet(f"{path}/run={a}-{b}").withColumn("_fp_run", F.lit(b)) for a, b in runs]
    if len(parts) == 1:
        return parts[0].drop("_fp_run")
    rest = [c for c in schema.fieldNames() if c not in keys]
    rows = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
        F.max_by(F.struct(F.lit(True).alias("_fp_any"), *rest), "_fp_run").alias("_fp_row"))
    return rows.select(*[c if c in keys else F.col("_fp_row")[c].alias(c) for c in schema.fieldNames()])


def _fold_batches(path: str, keys: list[str], fan: int = FAN):
    """Each micro-batch writes its rows as a run of its own (a key has one row in a batch); a batch whose number plus one is
    divisible by ``fan``, ``fan`` squared and so on merges the runs since then into one. Runs are named by their batches, so a batch
    replayed after a failure replaces what it wrote (exactly once). Merged runs are deleted by the next batch, not at
    once: readers may still hold them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        runs = [r for r in _runs(spark, path) if r[1] < batch_id]
        for a, b in set(runs) - set(_current(runs)):
            p, fs = _fs(spark, f"{path}/run={a}-{b}")
            fs.delete(p, True)
        # written once: the merge below reads it back instead of running the stateful plan again
        batch.write.mode("overwrite").parquet(f"{path}/run={batch_id}-{batch_id}")
        span = fan
        while (batch_id + 1) % (span * fan) == 0:
            span *= fan
        if (batch_id + 1) % span == 0:
            first = batch_id + 1 - span
            merged = [r for r in _current(runs) if r[0] >= first] + [(batch_id, batch_id)]
            _newest(spark, path, merged, keys, batch.schema).write.mode("overwrite").parquet(f"{path}/run={first}-{batch_id}")

    return write


def _folded(spark: SparkSession, path: str, keys: list[str], schema: StructType) -> DataFrame:
    runs = _current(_runs(spark, path))
    if not runs:
        return spark.createDataFrame([], schema)
    return _newest(spark, path, runs, keys, schema)


def windowed_metrics(spark: SparkSession, src: str, schema: StructType, ts: str, keys: list[str],
                     aggs: list, base: str, window: str = "1 day", watermark: str = "1 day",
                     files_per_trigger: int | None = None) -> tuple[DataFrame, dict]:
    """STR2: ``groupBy(window(ts), keys).agg(...)`` with a watermark. Returns the last value of every (window, key), and the
    run's counts: rows later than the watermark are not in the result, and ``late_rows`` says how many there were."""
    s = read_stream(spark, src, schema, files_per_trigger).withColumn(ts, F.col(ts).cast("timestamp")) \
        .withWatermark(ts, watermark)
    agg = s.groupBy(F.window(ts, window).alias("w"), *keys).agg(*aggs)
    agg = agg.select(F.col("w.start").alias("window_start"), *[c for c in agg.columns if c != "w"])
    counts = run_available(agg, f"{base}/data", f"{base}/_checkpoint", mode="update",
                           batch_fn=_fold_batches(f"{base}/data", ["window_start", *keys]))
    return _folded(spark, f"{base}/data", ["window_start", *keys], agg.schema), counts


def latest_per_key_stream(spark: SparkSession, src: str, schema: StructType, key: str, order: str, value: str,
                          base: str, files_per_trigger: int | None = None) -> DataFrame:
    """STR3: latest ``value`` per ``key`` by ``order`` (update mode, folded per batch)."""
    s = read_stream(spark, src, schema, files_per_trigger)
    agg = s.groupBy(key).agg(F.max_by(F.col(value), F.col(order)).alias(value), F.max(order).alias(order))
    run_available(agg, f"{base}/data", f"{base}/_checkpoint", mode="update", batch_fn=_fold_batches(f"{base}/data", [key]))
    return _folded(spark, f"{base}/data", [key], agg.schema)
