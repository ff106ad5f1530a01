"""Append-only tracking tables with fixed schemas, and the analytics over them (SURVEY §1.3,
TRK1-TRK12, SNK6, JN7).

Every table is a parquet folder under one root (normally inside the shared checkpoint folder
or a warehouse path). Writes append new files; "updates" such as removing a run's rows are
rewrites into a new folder that replaces the old one, never in-place edits. Reads apply the
declared schema, so an empty or missing table is an empty DataFrame with the right columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featpipe.operators import tracking as TR
from featpipe.plans.published import Published

# Table schemas and status domains of the tracked objects.
SCHEMAS = {
    "models": "id STRING, type STRING, name STRING, version INT, description STRING, spec STRING, "
              "plan_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "jobs": "job_id STRING, model_id STRING, type STRING, status STRING, message STRING, sql_query STRING, "
            "created_at TIMESTAMP, updated_at TIMESTAMP",
    "training_runs": "run_id STRING, job_id STRING, model_id STRING, run_name STRING, description STRING, "
                     "status STRING, started_at TIMESTAMP, paused_at TIMESTAMP, resumed_at TIMESTAMP, "
                     "completed_at TIMESTAMP, artifact_path STRING, final_metrics STRING, "
                     "training_config STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "training_metrics": "metric_id STRING, run_id STRING, metric_name STRING, metric_type STRING, step INT, "
                        "epoch INT, value DOUBLE, timestamp TIMESTAMP",
    "training_checkpoints": "checkpoint_id STRING, run_id STRING, epoch INT, step INT, checkpoint_path STRING, "
                            "metrics STRING, is_best BOOLEAN, file_size_bytes BIGINT, status STRING, "
                            "created_at TIMESTAMP",
    "evaluation_runs": "run_id STRING, evaluator_id STRING, job_id STRING, model_id STRING, dataset STRING, "
                       "target_column STRING, status STRING, started_at TIMESTAMP, completed_at TIMESTAMP, "
                       "metrics_result STRING, prediction_table STRING, created_at TIMESTAMP",
    "plan_executions": "id STRING, plan_id STRING, step_type STRING, status STRING, started_at TIMESTAMP, "
                       "completed_at TIMESTAMP, context STRING, outputs STRING, error_message STRING, "
                       "created_at TIMESTAMP",
}
JOB_STATUSES = ["UNKNOWN", "PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]
RUN_STATUSES = ["pending", "running", "paused", "stopped", "completed", "failed"]
FINISHED_JOB_STATUSES = ["COMPLETED", "FAILED", "CANCELLED"]


class TrackingStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.published = Published(spark, self.root)
        self._schemas = {k: T.StructType.fromDDL(v) for k, v in SCHEMAS.items()}

    # -- storage

    def path(self, table: str) -> str:
        if table not in SCHEMAS:
            raise KeyError(f"unknown tracking table {table}")
        return self.published.folder(table) or f"{self.root}/{table}"

    def _fs(self, path):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def table(self, name: str) -> DataFrame:
        schema = self._schemas[name]
        fs, p = self._fs(self.path(name))
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """``INSERT INTO`` (SNK6): rows are conformed to the table schema (missing columns are
        NULL, types cast), then appended as new files to the table's current folder. An append that runs while ``delete_run`` or a
        retention rewrite is under way may go to the folder that the rewrite supersedes: do not append during a rewrite."""
        schema = self._schemas[name]
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema.fields]
        rows.select(*cols).write.mode("append").parquet(self.path(name))

    def _replace(self, tables: dict[str, DataFrame]) -> None:
        """New content for the given tables: written to new folders, then made current together by one pointer."""
        folders, base = {}, self.published.version()
        for name, df in tables.items():
            self.path(name)  # checks the name
            folders[name] = f"{self.root}/_versions/{uuid.uuid4().hex[:12]}/{name}"
            df.write.parquet(folders[name])
        self.published.publish(folders, [], base)

    # -- analytics

    def latest_models(self) -> DataFrame:
        """Latest version of every model name (TRK1)."""
        m = self.table("models")
        return TR.latest_per_key(m, ["name"], ["version"], ["id", "version", "type", "created_at"])

    def next_versions(self) -> DataFrame:
        """``max(version) + 1`` per model name (TRK2)."""
        return TR.next_version(self.table("models"), "name", "version")

    def list_runs(self, status: str | None = None, model_id: str | None = None, limit: int | None = None
                  ) -> DataFrame:
        """Training runs with optional filters, newest first (TRK3)."""
        return TR.list_filtered(self.table("training_runs"), {"status": status, "model_id": model_id}, "created_at",
                                limit, tie="run_id")

    def metric_history(self, run_id: str, metric_name: str | None = None, metric_type: str | None = None
                       ) -> DataFrame:
        """One run's metric rows ordered by step (TRK4)."""
        return TR.metric_history(self.table("training_metrics"), "step",
                                 {"run_id": run_id, "metric_name": metric_name, "metric_type": metric_type})

    def latest_metrics(self) -> DataFrame:
        """Latest value of every (run, metric name, metric type) (TRK5)."""
        m = self.table("training_metrics")
        return TR.latest_per_key(m, ["run_id", "metric_name", "metric_type"], ["step", "timestamp"],
                                 ["value", "step", "epoch"])

    def best_checkpoints(self, metric: str = "val_loss") -> DataFrame:
        """Per run, the checkpoint with the smallest ``metric`` in its metrics JSON (TRK6):
        exactly one best per run, derived — no is_best flags to re-mark."""
        c = self.table("training_checkpoints").withColumn(
            "_fp_m", F.get_json_object("metrics", f"$.{metric}").cast("double"))
        return TR.best_per_key(c, ["run_id"], "checkpoint_id", "_fp_m").withColumnRenamed(
            "best__fp_m", f"best_{metric}")

    def job_status_counts(self) -> DataFrame:
        """Jobs per status over the whole status domain (0 when absent) plus 'total' (TRK9)."""
        from featpipe.operators.relational import counts_over_domain

        return counts_over_domain(self.table("jobs"), "status", JOB_STATUSES, out_key="status", total=True)

    def retention(self, days: int, as_of: str) -> tuple[DataFrame, DataFrame]:
        """Finished jobs older than ``days`` before ``as_of``: (to remove, to keep) (TRK10)."""
        return TR.retention(self.table("jobs"), "status", "created_at", days, as_of, FINISHED_JOB_STATUSES)

    def apply_retention(self, days: int, as_of: str) -> int:
        remove, keep = self.retention(days, as_of)
        n = remove.count()
        if n:
            self._replace({"jobs": keep})
        return n

    def latest_completed_steps(self) -> DataFrame:
        """Latest completed execution per (plan, step type) (TRK11)."""
        e = self.table("plan_executions").where(F.col("status") == "completed")
        return TR.latest_per_key(e, ["plan_id", "step_type"], ["completed_at", "id"], ["id", "completed_at", "outputs"])

    def completed_steps(self, plan_id: str) -> DataFrame:
        """All completed executions of a plan, oldest first (TRK11)."""
        return TR.completed_in_order(self.table("plan_executions"), "plan_id", plan_id, "completed_at", "id")

    def evaluation_metric_rows(self) -> DataFrame:
        """``metrics_result`` JSON of every evaluation run as (run, metric, value) rows (TRK8)."""
        return TR.metrics_json_rows(self.table("evaluation_runs"), ["run_id", "model_id"], "metrics_result")

    def delete_run(self, run_id: str) -> None:
        """Remove a run and its dependent metric and checkpoint rows (JN7): the three tables are
        rewritten as left anti joins against the removed run and published together."""
        gone = self.spark.createDataFrame([(run_id,)], "run_id STRING")
        self._replace({t: self.table(t).join(gone, "run_id", "left_anti")
                       for t in ("training_metrics", "training_checkpoints", "training_runs")})
