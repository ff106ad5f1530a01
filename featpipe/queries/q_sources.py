"""Source, sink and profiling queries (SRC*, SNK*, PRF*)."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featpipe.functions.columns import round_to
from featpipe.operators import profile
from featpipe.queries import query
from featpipe.sources import files
from featpipe.sources.tables import TABLES, read_table


def _r(df, digits=9):
    return df.select(*[round_to(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("prf1_numeric_profile_lineitem", "PRF1 PRF3", oracle="""
SELECT * FROM (
""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, COUNT(*) AS total_rows, COUNT({c}) AS count, COUNT(*) - COUNT({c}) AS nulls, "
    f"CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, round(AVG({c}), 6) AS mean, "
    f"round(STDDEV({c}), 6) AS std FROM lineitem"
    for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax"]) + ")")
def prf1_numeric_profile_lineitem(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    p = profile.numeric_profile(li)
    return p.select("column", "total_rows", "count", "nulls", "min", "max", round_to("mean", 6).alias("mean"),
                    round_to("std", 6).alias("std"))


@query("prf2_target_analysis_numeric", "PRF2", oracle="""
SELECT COUNT(*) AS total, COUNT(quality) AS non_null, COUNT(*) - COUNT(quality) AS nulls,
       COUNT(DISTINCT quality) AS unique, CAST(MIN(quality) AS DOUBLE) AS min, CAST(MAX(quality) AS DOUBLE) AS max,
       round(AVG(quality), 9) AS mean, round(STDDEV(quality), 9) AS std FROM labels
""")
def prf2_target_analysis_numeric(spark, sf_dir):
    return _r(profile.target_analysis(read_table(spark, sf_dir, "labels"), "quality"))


@query("prf2_target_analysis_text", "PRF2 AGG6", oracle="""
SELECT COUNT(*) AS total, COUNT(lang) AS non_null, COUNT(*) - COUNT(lang) AS nulls, COUNT(DISTINCT lang) AS unique,
       (SELECT list(lang ORDER BY lang) FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL
                                              ORDER BY lang LIMIT 10)) AS sample_values
FROM documents
""")
def prf2_target_analysis_text(spark, sf_dir):
    return profile.target_analysis(read_table(spark, sf_dir, "documents"), "lang")


@query("prf7_row_counts", "PRF7", oracle="\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in TABLES))
def prf7_row_counts(spark, sf_dir):
    counts = [profile.row_count(read_table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "row_count") for t in TABLES]
    return reduce(DataFrame.unionByName, counts)


@query("src5_parquet_glob_read", "SRC5", oracle="""
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY 1, 2
""")
def src5_parquet_glob_read(spark, sf_dir):
    li = files.read_parquet(spark, os.path.join(sf_dir, "lineite*.parquet"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"),
                                                         round_to(F.sum("l_quantity"), 2).alias("sum_qty"))


@query("src5_hive_partitioned_roundtrip", "SRC5 SNK1", oracle="""
SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, COUNT(*) AS n FROM orders
WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2
""")
def src5_hive_partitioned_roundtrip(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    path = files.scratch_path(spark, "orders_by_status")
    o.write.mode("overwrite").partitionBy("o_orderstatus", "year").parquet(path)
    back = files.read_parquet(spark, path)
    # the status filter prunes folders (PartitionFilters), not rows
    return back.where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus", "year") \
        .agg(F.count("*").alias("n")).select("o_orderstatus", F.col("year").cast("int").alias("year"), "n")


@query("src2_csv_declared_schema_roundtrip", "SRC2 SRC3 SRC4 SNK6", oracle="""
SELECT c_mktsegment, COUNT(*) AS n, round(SUM(c_acctbal), 2) AS bal FROM customer GROUP BY 1
""")
def src2_csv_declared_schema_roundtrip(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = files.scratch_path(spark, "customer_csv")
    c.write.mode("overwrite").option("sep", "::").option("header", False).csv(path)
    back = files.read_csv(spark, path, columns={"column0": "BIGINT", "column1": "VARCHAR", "column2": "DOUBLE",
                                                "column3": "VARCHAR"}, delim="::", ignore_errors=True,
                          names=["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("n"), round_to(F.sum("c_acctbal"), 2).alias("bal"))


@query("src6_json_roundtrip", "SRC6", oracle="""
SELECT event_type, COUNT(*) AS n, round(SUM(value), 2) AS total FROM events GROUP BY 1
""")
def src6_json_roundtrip(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    path = files.scratch_path(spark, "events_json")
    e.write.mode("overwrite").json(path)
    back = files.read_json_auto(spark, path, columns={"event_id": "BIGINT", "event_type": "VARCHAR", "value": "DOUBLE"})
    return back.groupBy("event_type").agg(F.count("*").alias("n"), round_to(F.sum("value"), 2).alias("total"))


@query("snk4_prediction_table_written", "SNK4 SNK5 SCR1 SCR6", oracle="""
SELECT COUNT(*) AS n_predictions, round(AVG(1.0 / (1.0 + exp(-(0.0 + 0.000004 * (o_totalprice - 150000.0)
         + -0.002 * (CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) - 1800.0))))), 9)
       AS mean_probability FROM orders
""")
def snk4_prediction_table_written(spark, sf_dir):
    from featpipe.operators.sinks import write_predictions
    from featpipe.queries.q_metrics import scored_orders

    s = scored_orders(spark, sf_dir).select("o_orderkey", "label", F.col("score").alias("probability"))
    path = files.scratch_path(spark, "predictions")
    table, n = write_predictions(s, path, {"probability": F.col("probability")}, keep=["o_orderkey", "label"])
    return table.agg(F.count("*").alias("n_predictions"), round_to(F.avg("pred_probability"), 9)
                     .alias("mean_probability"))


@query("prf5_catalog_listing", "PRF5 PRF4 PRF3", oracle="""
SELECT table_name AS "table", CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column"
FROM information_schema.columns
WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')
""")
def prf5_catalog_listing(spark, sf_dir):
    from featpipe.sources.tables import register_tables

    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    register_tables(spark, sf_dir, names)
    return profile.list_tables(spark).where(F.col("table").isin(names)).select("table", "position", "column")


# The numeric columns of the test tables (their schemas).
NUMERIC_COLUMNS = {
    "region": ['r_regionkey'],
    "nation": ['n_nationkey', 'n_regionkey'],
    "customer": ['c_custkey', 'c_nationkey', 'c_acctbal'],
    "supplier": ['s_suppkey', 's_nationkey', 's_acctbal'],
    "part": ['p_partkey', 'p_size', 'p_retailprice'],
    "orders": ['o_orderkey', 'o_custkey', 'o_totalprice'],
    "lineitem": ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'],
    "events": ['event_id', 'user_id', 'value'],
    "documents": ['doc_id', 'n_chars'],
    "embeddings": ['vec_id', 'label'],
    "pages": ['page_id'],
    "benchmark": ['item_id'],
    "labels": ['doc_id', 'quality', 'toxic'],
    "conversations": ['conv_id', 'turn'],
}

_PROFILE_ALL_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column, COUNT(*) AS total_rows, COUNT({c}) AS count, "
    f"CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, round(AVG({c}), 6) AS mean, "
    f"round(STDDEV({c}), 6) AS std FROM {t}"
    for t, cols in NUMERIC_COLUMNS.items() for c in cols)


@query("prf1_numeric_profile_every_table", "PRF1 PRF3 PRF7", oracle=_PROFILE_ALL_SQL)
def prf1_numeric_profile_every_table(spark, sf_dir):
    """Every test table profiled: one aggregation pass per table, numeric columns found from
    the schema (PRF3)."""
    out = None
    for t in NUMERIC_COLUMNS:
        df = read_table(spark, sf_dir, t)
        p = profile.numeric_profile(df).select(
            F.lit(t).alias("table_name"), "column", "total_rows", "count", "min", "max",
            round_to("mean", 6).alias("mean"), round_to("std", 6).alias("std"))
        out = p if out is None else out.unionByName(p)
    return out


@query("src2_csv_records_over_lines", "SRC2 SRC3", oracle="""
SELECT doc_id, source, length(text) AS chars, md5(text) AS text_md5, CAST(0 AS BIGINT) AS bad_rows FROM documents WHERE text <> ''
""")
def src2_csv_records_over_lines(spark, sf_dir):
    """Whole texts with their line breaks, quotes and delimiters, written as CSV and read as records that run over lines."""
    docs = read_table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "source", "text")
    path = files.scratch_path(spark, "documents_csv")
    docs.write.options(escape='"', quoteAll="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    columns = "doc_id BIGINT, source STRING, text STRING"
    back = files.read_csv(spark, path, columns=columns)
    bad = files.malformed_rows(spark, path, columns).select("bad_rows")
    return back.select("doc_id", "source", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"), bad.scalar().alias("bad_rows"))


@query("src1_csv_types_of_all_files", "SRC1", oracle="""
SELECT 'user_id' AS name, 'bigint' AS type, COUNT(user_id) AS filled, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS kinds FROM events
UNION ALL SELECT 'late_value', 'double', COUNT(*) FILTER (event_id % 2 = 1 AND value IS NOT NULL),
       COUNT(DISTINCT round(value, 6)) FILTER (event_id % 2 = 1) FROM events
UNION ALL SELECT 'day', 'date', COUNT(ts), COUNT(DISTINCT CAST(ts AS DATE)) FROM events
UNION ALL SELECT 'said', 'string', COUNT(event_type), COUNT(DISTINCT event_type) FROM events
""")
def src1_csv_types_of_all_files(spark, sf_dir):
    """A folder of two exports under one sniffed dialect; the first has no value in one column and narrower numbers in another."""
    e = read_table(spark, sf_dir, "events")
    path = files.scratch_path(spark, "events_csv")
    # the later file's users lie beyond 32 bits
    rows = e.select((F.col("user_id") + F.when(F.col("event_id") % 2 == 1, 1 << 33).otherwise(0)).alias("user_id"),
                    F.when(F.col("event_id") % 2 == 1, F.round("value", 6)).alias("late_value"),
                    F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat("event_type", F.lit(", or\nso")).alias("said"), "event_id")
    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).drop("event_id").write.options(sep="|", escape='"', quoteAll="true", header=True).csv(f"{path}/{half}")
    back = files.read_csv_auto(spark, [f"{path}/0", f"{path}/1"])
    types = dict(back.dtypes)
    user, said = F.pmod("user_id", F.lit(1 << 33)), F.split_part("said", F.lit(", or\n"), F.lit(1))
    ones = {"user_id": user, "late_value": F.col("late_value"), "day": F.col("day"), "said": said}
    one = back.agg(*[f(c).alias(f"{n}_{k}") for n, c in ones.items() for k, f in (("filled", F.count), ("kinds", F.count_distinct))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(types[n]).alias("type"), F.col(f"{n}_filled").alias("filled"),
                                                  F.col(f"{n}_kinds").alias("kinds")) for n in ones])))
