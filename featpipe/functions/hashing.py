"""Hash-based bucketing.

* ``md5_bucket``: ``conv(substr(md5(key), 1, 8), 16, 10) % n`` — the same number in Spark and
  DuckDB, so hash splits can be checked against SQL.
* ``hash_bucket``: numeric values -> ``int(v) mod n`` (floor modulo, truncating cast; NULL is 0);
  strings -> ``xxhash64`` mod n, in the JVM. ``method="blake2b"`` gives the first 8 bytes of
  BLAKE2b read little-endian, mod n, where buckets must equal another system's; Spark has no BLAKE2b, so that form
  runs in Arrow batches, and ``blake2b_table`` hashes only the distinct values of a column.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = ["md5_bucket", "hash_bucket", "blake2b_bucket", "hash_array"]


def md5_bucket(key, n: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def _blake2b_mod(values: pd.Series, n: int) -> pd.Series:
    def one(v):
        if v is None:
            v = "None"
        h = hashlib.blake2b(str(v).encode("utf-8", errors="ignore"), digest_size=8).digest()
        return int.from_bytes(h, "little") % n

    codes, distinct = pd.factorize(values.map(lambda v: "None" if v is None else str(v)))
    return pd.Series(distinct).map(one).astype("int64").reindex(codes).set_axis(values.index)


def blake2b_bucket(c, n: int) -> Column:
    """BLAKE2b-8 little-endian mod n of the value's text (pandas UDF, Arrow batches)."""

    @F.pandas_udf(T.LongType())
    def _udf(s: pd.Series) -> pd.Series:
        return _blake2b_mod(s, n)

    return _udf(F.col(c) if isinstance(c, str) else c)


def blake2b_table(df, c: str, n: int, out: str):
    """``df`` with the BLAKE2b bucket of a text column; only its distinct values go through Python."""
    text = F.coalesce(F.col(c).cast("string"), F.lit("None"))
    table = df.select(text.alias("_fp_hv")).distinct().withColumn(out, blake2b_bucket("_fp_hv", n))
    return df.withColumn("_fp_hv", text).join(table, "_fp_hv", "left").select(*[df[x] for x in df.columns], out)


def hash_bucket(c, n: int = 1000, dtype: T.DataType | None = None, method: str = "xxhash64") -> Column:
    """Bucket index in [0, n) for one value (FEA4)."""
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and isinstance(dtype, T.NumericType):
        return F.pmod(F.coalesce(col.cast("bigint"), F.lit(0)), F.lit(n)).cast("bigint")
    if method == "xxhash64":
        return F.pmod(F.xxhash64(F.coalesce(col.cast("string"), F.lit("None"))), F.lit(n)).cast("bigint")
    if method == "blake2b":
        return blake2b_bucket(col, n)
    raise ValueError("method must be 'xxhash64' or 'blake2b'")


def hash_array(c, n: int, numeric: bool, method: str = "xxhash64") -> Column:
    """Hash every element of an array column, as ``hash_bucket`` does."""
    col = F.col(c) if isinstance(c, str) else c
    if numeric:
        return F.transform(col, lambda v: F.pmod(F.coalesce(v.cast("bigint"), F.lit(0)), F.lit(n)))
    if method == "xxhash64":
        return F.transform(col, lambda v: F.pmod(F.xxhash64(F.coalesce(v.cast("string"), F.lit("None"))), F.lit(n)).cast("bigint"))
    if method != "blake2b":
        raise ValueError("method must be 'xxhash64' or 'blake2b'")

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def _udf(s: pd.Series) -> pd.Series:
        return s.map(lambda arr: None if arr is None else [int(x) for x in _blake2b_mod(pd.Series(list(arr), dtype=object), n)])

    return _udf(col)
