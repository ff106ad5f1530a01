"""Interactive SQL: read-only gate, bounded preview, table suggestions (PIP11, PIP12, PIP14).

The preview is the one place a result is brought to the driver, and it is bounded: at most
``limit + 1`` rows are fetched (the extra row says whether there are more), never the whole
result.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from featpipe.plans.tokens import Token, TokenError, following, statement, text

# Statements allowed in read-only mode.
READ_ONLY_START = ("SELECT", "WITH", "DESCRIBE", "DESC", "SHOW", "EXPLAIN")


class QueryRejected(ValueError):
    pass


def check_read_only(sql: str) -> str:
    """One statement whose first word is SELECT / WITH / DESCRIBE / SHOW / EXPLAIN; comments and trailing semicolons are taken off."""
    try:
        said = [Token("space", " ") if t.kind == "comment" else t for t in statement(sql)]
    except TokenError as e:
        raise QueryRejected(str(e)) from e
    first = following(said, 0)
    if first == len(said):
        raise QueryRejected("empty query")
    if any(t.kind == "sign" and t.text == ";" for t in said):
        raise QueryRejected("only one statement is allowed")
    if said[first].word not in READ_ONLY_START:
        raise QueryRejected(f"{said[first].text.upper()} is not allowed in read-only mode")
    return text(said).strip()


def suggest_tables(spark: SparkSession, name: str, n: int = 3) -> list[str]:
    names = [t.name for t in spark.catalog.listTables()]
    return difflib.get_close_matches(name, names, n=n, cutoff=0.5)


def query(spark: SparkSession, sql: str, read_only: bool = True) -> DataFrame:
    """``spark.sql`` behind the gate; unknown tables get name suggestions. The DuckDB forms that step SQL may use
    (table functions, ``"ident"``, casts to TEXT, ...) work here too."""
    from featpipe.plans.steps import _quoted_identifiers, to_spark_sql

    text = to_spark_sql(check_read_only(sql) if read_only else sql, spark)
    try:
        with _quoted_identifiers(spark):
            return spark.sql(text)
    except AnalysisException as e:
        m = re.search(r"TABLE_OR_VIEW_NOT_FOUND.*?`?([A-Za-z_][\w.]*)`? cannot be found", str(e), re.S)
        if m or "TABLE_OR_VIEW_NOT_FOUND" in str(e):
            missing = m.group(1).split(".")[-1] if m else ""
            hint = suggest_tables(spark, missing) if missing else []
            raise QueryRejected(f"table not found: {missing or '?'}; did you mean {hint}?") from e
        raise


@dataclass
class Preview:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


def preview(df: DataFrame, limit: int = 100) -> Preview:
    """First ``limit`` rows and whether more exist (fetches limit + 1 rows)."""
    rows = [tuple(r) for r in df.limit(limit + 1).collect()]
    return Preview(df.columns, rows[:limit], len(rows) > limit)
