"""Run-tracking analytics over append-only tables (TRK1-TRK12).

Tables are plain DataFrames (runs, metric logs, checkpoints, jobs); column names are
parameters. Per-key "latest" and "best" rows use ``max_by`` / ``min_by`` aggregates, which
combine map-side, so a run with a billion metric rows costs one partial row per task.
Order-dependent logic (early stopping) uses the range-split running aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featpipe.plans import ordered

FINISHED = ("completed", "failed", "cancelled")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` per key, for all keys in one pass (TRK1, TRK5, TRK11)."""
    s = F.struct(*[F.col(c) for c in cols])
    o = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.max_by(s, o).alias("_fp_latest")).select(*keys, "_fp_latest.*")


def next_version(df: DataFrame, name: str, version: str) -> DataFrame:
    """``coalesce(max(version), 0) + 1`` per name (TRK2)."""
    return df.groupBy(name).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def list_filtered(df: DataFrame, filters: dict | None, order: str, limit: int | None = None,
                  descending: bool = True, tie: str | None = None) -> DataFrame:
    """Optional equality filters, newest first, optional limit (TRK3). ``tie`` (a unique column, ascending) decides among equal
    times; a limit needs it, else the rows at the limit would be arbitrary."""
    if limit and not tie:
        raise ValueError("a limit needs a unique tie column")
    for k, v in (filters or {}).items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    o = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    df = df.orderBy(o, *([F.col(tie)] if tie else []))
    return df.limit(limit) if limit else df


def completed_in_order(df: DataFrame, plan: str, plan_id, at: str, tie: str, status: str = "status") -> DataFrame:
    """All completed executions of one plan in order of completion (TRK11)."""
    return df.where((F.col(plan) == F.lit(plan_id)) & (F.col(status) == "completed")).orderBy(F.col(at).asc_nulls_first(), tie)


def metric_history(df: DataFrame, step: str, filters: dict | None = None, order_keys: Sequence[str] = ()
                   ) -> DataFrame:
    """Metric rows ordered by step, optional filters (TRK4)."""
    for k, v in (filters or {}).items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    return df.orderBy(*order_keys, step)


def best_per_key(df: DataFrame, keys: Sequence[str], item: str, metric: str, minimize: bool = True) -> DataFrame:
    """Best item per key by a metric (ties: smaller item) — one best per run by construction (TRK6)."""
    o = F.struct(F.col(metric), F.col(item))
    agg = F.min_by(F.col(item), o) if minimize else F.max_by(F.col(item), F.struct(F.col(metric), -F.col(item)))
    best = F.min(metric) if minimize else F.max(metric)
    return df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(agg.alias(f"best_{item}"), best.alias(f"best_{metric}"))


def early_stopping(df: DataFrame, run: str, order: Sequence[str], loss: str, patience: int,
                   n_buckets: int | None = None) -> DataFrame:
    """Per run: epochs, best epoch (first strict minimum), best loss, and the epoch where
    training would stop with ``patience`` epochs without improvement (NULL if never) (TRK7).

    Epochs are the run's rows in ``order``, numbered from 1.
    """
    base = df.select(run, *order, loss)
    split = ordered.plan_split(base, [run], order[0], n_buckets)
    # pass 1: epoch number and the best loss before each epoch; pass 2: last improving epoch
    prev = ordered.running(base, [run], list(order), [("epoch", "count", "*", True),
                                                      ("_fp_prev_min", "min", loss, False)], split=split)
    imp = prev.withColumn("_fp_imp", F.col("_fp_prev_min").isNull() | (F.col(loss) < F.col("_fp_prev_min")))
    last = ordered.running(imp, [run], list(order),
                           [("_fp_last_imp", "max", F.when(F.col("_fp_imp"), F.col("epoch")), True)], split=split)
    return last.groupBy(run).agg(
        F.count("*").alias("n_epochs"),
        F.min_by(F.col("epoch"), F.struct(F.col(loss), F.col("epoch"))).alias("best_epoch"),
        F.min(loss).alias("best_loss"),
        F.min(F.when(F.col("epoch") - F.col("_fp_last_imp") >= patience, F.col("epoch"))).alias("stop_epoch"),
    )


def metric_type(name) -> F.Column:
    """'validation' if the name contains val_ / validation_, 'test' for test_, else 'train' (TRK12)."""
    n = F.col(name) if isinstance(name, str) else name
    return F.when(n.contains("val_") | n.contains("validation_"), F.lit("validation")) \
        .when(n.contains("test_"), F.lit("test")).otherwise(F.lit("train"))


def metrics_json_rows(df: DataFrame, keys: Sequence[str], json_col: str) -> DataFrame:
    """A metrics JSON object per row -> ``(keys..., metric, value)`` rows (TRK8)."""
    m = F.from_json(F.col(json_col), "map<string,double>")
    return df.select(*keys, F.explode(m).alias("metric", "value"))


def compare(df_long: DataFrame, key: str, metric: str, value: str, metrics: Sequence[str]) -> DataFrame:
    """Long metrics -> one row per key with a column per metric (known metric list, no
    extra pass to discover pivot values)."""
    return df_long.groupBy(key).pivot(metric, list(metrics)).agg(F.first(value))


def retention(df: DataFrame, status: str, created: str, days: int, as_of: str,
              finished: Sequence[str] = FINISHED) -> tuple[DataFrame, DataFrame]:
    """(rows to remove, rows to keep): finished rows created before ``as_of - days`` (TRK10).

    Spark tables are rewritten, not deleted from: write the keep-set to a new location and
    swap it in."""
    cutoff = F.lit(str(as_of)).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    old = F.col(status).isin(list(finished)) & (F.col(created) < cutoff)
    return df.where(old), df.where(~old | F.col(created).isNull() | F.col(status).isNull())
