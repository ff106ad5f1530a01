"""Relational recipes that SQL pipelines use, as DataFrame functions (PRJ11, JN3, JN7, AGG6,
AGG8, SRT2)."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(df: DataFrame, ts_col: str, days: int, as_of: str | _dt.date | None = None) -> DataFrame:
    """Rows with ``as_of - days <= ts < as_of`` (``CURRENT_DATE - INTERVAL n DAY``).

    ``as_of`` defaults to today; pass it for repeatable results. The bounds are literals, so
    the filter reaches the parquet scan (and partition pruning on date-partitioned data).
    """
    end = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    ts = F.col(ts_col)
    start = F.date_sub(end, int(days))
    return df.where((ts >= start.cast(df.schema[ts_col].dataType)) & (ts < end.cast(df.schema[ts_col].dataType)))


def apply_stats_row(df: DataFrame, stats: DataFrame, expr: Callable[[dict], Column], out: str) -> DataFrame:
    """Use a one-row statistics frame in a row expression (``CROSS JOIN stats``).

    Each statistic becomes an uncorrelated scalar subquery: Spark runs the aggregate once,
    merges subqueries over the same frame, and the main plan has no join at all.
    """
    s = {c: stats.select(c).scalar() for c in stats.columns}
    return df.withColumn(out, expr(s))


def remove_dependents(child: DataFrame, removed_parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is not in ``removed_parents`` (``NOT EXISTS`` / left anti join)."""
    return child.join(removed_parents, child[child_key] == removed_parents[parent_key], "left_anti")


def distinct_values(df: DataFrame, col: str, limit: int | None = 100) -> DataFrame:
    """Sorted distinct non-NULL values, capped (a preview feature: the cap is the point)."""
    d = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
    return d.limit(limit) if limit else d


def counts_over_domain(df: DataFrame, key: str, domain: Sequence, out_key: str = "key", total: bool = False
                       ) -> DataFrame:
    """Row count per value of a fixed domain, 0 for absent values; optional 'total' row."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(key).cast("string").alias("_fp_k")).agg(F.count("*").alias("_fp_n"))
    dom = spark.createDataFrame([(str(v),) for v in domain], f"{out_key} string")
    res = dom.join(counts, dom[out_key] == counts["_fp_k"], "left").select(
        out_key, F.coalesce("_fp_n", F.lit(0)).alias("n"))
    if total:
        res = res.unionByName(df.agg(F.count("*").alias("n")).select(F.lit("total").alias(out_key), "n"))
    return res


def page(df: DataFrame, order_by: Sequence[str], offset: int, limit: int) -> DataFrame:
    """One page in key order (``ORDER BY key LIMIT n OFFSET m``); runs as a top-(m+n)."""
    return df.orderBy(*order_by).offset(int(offset)).limit(int(limit))


def page_after(df: DataFrame, order_by: Sequence[str], after: Sequence | None, limit: int) -> DataFrame:
    """The next page in key order after the row whose keys are ``after`` (``None``: the first page). The filter reaches
    the scan and a page costs the same however far it lies; keys must be unique together and not NULL."""
    if after is not None:
        later, same = F.lit(False), F.lit(True)
        for k, v in zip(order_by, after, strict=True):
            later = later | (same & (F.col(k) > F.lit(v)))
            same = same & (F.col(k) == F.lit(v))
        df = df.where(later)
    return df.orderBy(*order_by).limit(int(limit))


def hash_sample(df: DataFrame, keys: Sequence[str], percent: float) -> DataFrame:
    """A repeatable sample (SRT4): rows whose key hash falls into the first ``percent`` of 10,000 buckets. The same keys
    are picked in every run, every partitioning and every engine with md5."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    bucket = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(10_000))
    return df.where(bucket < F.lit(round(percent * 100)))


def distinct_counts(df: DataFrame, group_by: Sequence[str], columns: Sequence[str], approx: bool = False,
                    rsd: float = 0.05) -> DataFrame:
    """``COUNT(DISTINCT c)`` per group; ``approx`` switches to HyperLogLog++ (fixed memory,
    relative error ``rsd``) for very high cardinalities."""
    fn = (lambda c: F.approx_count_distinct(c, rsd)) if approx else F.count_distinct
    return df.groupBy(*group_by).agg(*[fn(c).alias(f"n_distinct_{c}") for c in columns])
