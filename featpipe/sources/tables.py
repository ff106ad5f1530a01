"""Named tables of a data folder (one parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table as a lazy DataFrame; its files are listed anew every time."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    """Register each table as a temp view of the same name; returns the frames."""
    out = {}
    for n in names or TABLES:
        p = table_path(sf_dir, n)
        if os.path.exists(p) or "://" in p:
            df = spark.read.parquet(p)
            df.createOrReplaceTempView(n)
            out[n] = df
    return out


def table_columns(spark: SparkSession, name: str, columns=None, limit: int | None = None,
                  order_by=None) -> DataFrame:
    """``SELECT "a","b" FROM t [ORDER BY ..] [LIMIT n]`` with a column check (SRC11).

    A limit without an order returns an arbitrary subset in Spark as in any engine, so an
    order is required whenever a limit is given.
    """
    df = spark.table(name)
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in {name}: {missing}; available: {df.columns}")
        df = df.select(*[F.col(f"`{c}`") for c in columns])
    if limit is not None:
        if not order_by:
            raise ValueError("a limit needs an order (rows would be arbitrary)")
        df = df.orderBy(*order_by).limit(int(limit))
    return df
