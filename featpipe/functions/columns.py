"""Scalar column expressions used by SQL pipelines and feature operators.

All of them compile to built-in Spark expressions, so they stay inside whole-stage codegen.
Where DuckDB and Spark disagree on a function, the helper gives the DuckDB meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "safe_divide", "nullif_zero", "dow_sunday0", "month_key", "is_weekend", "epoch_micros",
    "since_micros", "trunc_to_bigint", "bin_by", "weighted_sum", "json_number_map", "case_map", "round_to",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (``CASE WHEN b = 0 THEN NULL`` / ``NULLIF``)."""
    return F.try_divide(col_of(a), col_of(b))


def nullif_zero(c) -> Column:
    c = col_of(c)
    return F.when(c == 0, F.lit(None)).otherwise(c)


def dow_sunday0(ts) -> Column:
    """``EXTRACT(DOW FROM ts)`` with Sunday = 0 (Spark's dayofweek has Sunday = 1)."""
    return F.dayofweek(col_of(ts)) - 1


def month_key(ts) -> Column:
    """``SUBSTRING(CAST(d AS TEXT), 1, 7)`` -> 'YYYY-MM'."""
    return F.date_format(col_of(ts), "yyyy-MM")


def is_weekend(ts) -> Column:
    return F.dayofweek(col_of(ts)).isin(1, 7).cast("int")


def epoch_micros(ts) -> Column:
    """Microseconds since the epoch for TIMESTAMP and TIMESTAMP_NTZ (read as UTC wall clock)."""
    return F.unix_micros(col_of(ts).cast("timestamp"))


def since_micros(ts, prev) -> Column:
    """``ts - prev`` as microseconds (NULL when prev is NULL)."""
    return epoch_micros(ts) - epoch_micros(prev)


def trunc_to_bigint(c) -> Column:
    """Integer part, toward zero (Spark's cast; DuckDB rounds, so oracles use ``trunc``)."""
    return col_of(c).cast("bigint")


def bin_by(c, edges, labels) -> Column:
    """``CASE WHEN c < e1 THEN l0 WHEN c < e2 THEN l1 ... ELSE ln END`` (NULL stays NULL)."""
    c = col_of(c)
    if len(labels) != len(edges) + 1:
        raise ValueError("need one more label than edges")
    expr = F.lit(labels[-1])
    for e, lab in reversed(list(zip(edges, labels[:-1]))):
        expr = F.when(c < F.lit(e), F.lit(lab)).otherwise(expr)
    return F.when(c.isNull(), F.lit(None)).otherwise(expr)


def weighted_sum(weights: dict) -> Column:
    expr = None
    for name, w in weights.items():
        term = F.lit(float(w)) * col_of(name)
        expr = term if expr is None else expr + term
    return expr


def json_number_map(c) -> Column:
    """A JSON object column as ``map<string,double>`` (NULL on malformed text)."""
    return F.from_json(col_of(c), "map<string,double>")


def case_map(c, mapping: dict, default=None) -> Column:
    """Fixed value mapping (``low -> 0, medium -> 1``) as a CASE expression."""
    c = col_of(c)
    expr = F.lit(default)
    for k, v in reversed(list(mapping.items())):
        expr = F.when(c == F.lit(k), F.lit(v)).otherwise(expr)
    return expr


def round_to(c, digits: int) -> Column:
    """Round a double to ``digits`` places as ``round(x * 10^d) / 10^d`` (half away from zero
    on the binary value). Matches DuckDB's ``round(x, d)`` bit for bit; Spark's own
    ``round(x, d)`` rounds the shortest decimal text instead, which differs on ties such as
    13322.57535."""
    m = float(10 ** digits)
    return F.round(col_of(c).cast("double") * F.lit(m)) / F.lit(m)
