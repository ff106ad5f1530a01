"""Session construction and session-level settings.

Every setting here is ordinary Spark configuration. On a cluster the session is usually
handed in already built; ``configure`` only fills in values that are not set yet.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on for results that match a DuckDB-style SQL pipeline.
_REQUIRED = {
    # timestamps are wall-clock values; pin the zone so NTZ <-> TIMESTAMP casts are stable
    "spark.sql.session.timeZone": "UTC",
}

# Bounds; applied only where the session sets none. A batch to a Python worker is held by the
# executor and its worker at once, several times over while it grows: long texts and packed rows would fill the memory
# beside the heap.
_BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

# Performance defaults; applied only when the user did not set them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply required settings; make sure a checkpoint folder exists.

    The checkpoint folder is read from ``spark.checkpoint.dir``. Only when it is unset
    and the master is local (tests) a private temporary folder is used; on a cluster that is an error, since every
    executor would write to its own disk.
    """
    for k, v in _REQUIRED.items():
        spark.conf.set(k, v)
    for k, v in _BOUNDS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            d = tempfile.mkdtemp(prefix="featpipe-ckpt-")
        sc.setCheckpointDir(d)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and staged outputs (from spark.checkpoint.dir)."""
    configure(spark)
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def build_session(master: str | None = None, app: str = "featpipe", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or get) a session with the engine defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    conf.update(_REQUIRED)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("FEATPIPE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
