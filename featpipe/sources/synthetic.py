"""Synthetic datasets (SRC10): ``num_samples`` rows of ``num_features`` standard-normal
features and a 0/1 or normal target, generated in parallel by ``spark.range``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_dataset(spark: SparkSession, num_samples: int, num_features: int, binary: bool = True,
                      seed: int = 42, partitions: int | None = None) -> DataFrame:
    base = spark.range(0, num_samples, numPartitions=partitions) if partitions else spark.range(num_samples)
    feats = [F.randn(seed + i).alias(f"feature_{i}") for i in range(num_features)]
    target = (F.rand(seed + num_features) > 0.5).cast("int") if binary else F.randn(seed + num_features)
    return base.select(F.col("id"), *feats, target.alias("target"))
