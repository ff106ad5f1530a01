"""Sinks: prediction / evaluation tables and append-only logs (SNK1, SNK4-SNK6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def write_predictions(df: DataFrame, path: str, outputs: dict[str, Column], keep: list[str],
                      mode: str = "overwrite") -> tuple[DataFrame, int]:
    """Feature columns + ``pred_<output>`` DOUBLE, written in one columnar pass (SNK4).

    Rows carry their own features, so predictions cannot misalign. The row count is read
    from the written files' footers (no second pass over the data).
    """
    out = df.select(*keep, *[c.cast("double").alias(f"pred_{k}") for k, c in outputs.items()])
    out.write.mode(mode).parquet(path)
    table = df.sparkSession.read.parquet(path)
    return table, table.count()


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """``INSERT INTO`` for append-only tracking tables (SNK6): new files, old ones untouched."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
