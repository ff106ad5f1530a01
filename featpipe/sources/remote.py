"""Remote stores and external tables (SRC7-SRC9, SRC12): configuration pass-throughs.

Reading is the connector's job; these helpers only set the documented options, so pushdown
(filters, column pruning) is whatever the connector offers. None of them can be exercised
without the remote system and its jars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def configure_s3(spark: SparkSession, endpoint: str | None = None, region: str | None = None,
                 credentials_provider: str | None = None, path_style: bool | None = None) -> None:
    """``s3a://`` settings (custom endpoint, region, credential chain)."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    if endpoint:
        conf.set("fs.s3a.endpoint", endpoint)
    if region:
        conf.set("fs.s3a.endpoint.region", region)
    if credentials_provider:
        conf.set("fs.s3a.aws.credentials.provider", credentials_provider)
    if path_style is not None:
        conf.set("fs.s3a.path.style.access", str(path_style).lower())


def s3_path(path: str) -> str:
    """``s3://bucket/key`` -> ``s3a://bucket/key`` (the Hadoop connector's scheme)."""
    return "s3a://" + path[len("s3://"):] if path.startswith("s3://") else path


def read_iceberg(spark: SparkSession, table_or_path: str) -> DataFrame:
    """An Iceberg table (needs the Iceberg runtime on the classpath)."""
    return spark.read.format("iceberg").load(table_or_path)


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
              properties: dict | None = None, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """A warehouse table or query over JDBC; a partition column splits the read (a query then enters as a derived
    table, for Spark refuses its ``query`` option together with a partition column)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) fp_q" if query else table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions or 8))
    return r.load()


def register_python_source(spark: SparkSession, source_cls) -> None:
    """Custom source plug-in point: a PySpark Python Data Source class (SRC12)."""
    spark.dataSource.register(source_cls)
