"""Dataset profiling and catalog listing (PRF1-PRF7).

All column statistics of a table come from one aggregation pass; the wide result row is
turned into one row per column with ``stack`` (still lazy, still one scan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, total_rows, count, nulls, min, max, mean, std)`` per numeric column (PRF1).

    ``total_rows`` counts every row (the reference counts after dropping NULLs)."""
    cols = columns or numeric_columns(df)
    aggs = [F.count("*").alias("_fp_total")]
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.avg(x).alias(f"av{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', n{i}, mn{i}, mx{i}, av{i}, sd{i}" for i, c in enumerate(cols))
    return wide.selectExpr("_fp_total AS total_rows",
                           f"stack({len(cols)}, {parts}) AS (column, count, min, max, mean, std)") \
        .select("column", "total_rows", "count", (F.col("total_rows") - F.col("count")).alias("nulls"),
                "min", "max", "mean", "std")


def target_analysis(df: DataFrame, target: str, sample_values: int = 10) -> DataFrame:
    """Total, non-null, null, distinct; numeric stats for numeric targets, else up to
    ``sample_values`` sorted distinct values (PRF2)."""
    t = F.col(target)
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    base = [F.count("*").alias("total"), F.count(t).alias("non_null"), F.count_if(t.isNull()).alias("nulls"),
            F.count_distinct(t).alias("unique")]
    if numeric:
        x = t.cast("double")
        base += [F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")]
        return df.agg(*base)
    vals = df.select(t.cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().orderBy("v") \
        .limit(sample_values).agg(F.collect_list("v").alias("v"))
    return df.agg(*base).select("*", vals.select(F.array_sort("v")).scalar().alias("sample_values"))


def row_count(df: DataFrame) -> DataFrame:
    """Row count (PRF7); on a bare parquet scan Spark answers from file metadata."""
    return df.agg(F.count("*").alias("row_count"))


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views with their columns and types (PRF5). Catalog metadata is small and
    lives on the driver; the result is a DataFrame like any other."""
    rows = []
    for t in spark.catalog.listTables():
        kind = "view" if t.isTemporary or (t.tableType or "").upper() == "VIEW" else "table"
        try:
            cols = spark.table(t.name).schema.fields
        except Exception:  # noqa: BLE001
            cols = []
        for pos, f in enumerate(cols):
            rows.append((t.name, kind, pos, f.name, f.dataType.simpleString(), f.nullable))
    schema = "table string, kind string, position int, column string, type string, nullable boolean"
    return spark.createDataFrame(rows, schema)


def column_insights(df: DataFrame) -> DataFrame:
    """Schema-level hints per column: id-like, timestamp, JSON-like text, key-like (PRF6)."""
    rows = []
    for f in df.schema.fields:
        n = f.name.lower()
        rows.append((f.name, f.dataType.simpleString(),
                     n == "id" or n.endswith("_id") or n.endswith("key"),
                     isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)),
                     isinstance(f.dataType, T.StringType) and any(k in n for k in ("json", "props", "meta")),
                     n.endswith("_id") or n.endswith("key")))
    return df.sparkSession.createDataFrame(
        rows, "column string, type string, id_like boolean, is_time boolean, json_like boolean, foreign_key_like boolean")
