"""Lookups in fitted tables of any size (JN5, FEA8, FEA17, SCR7).

A table whose measured bytes fit the broadcast limit is broadcast. Beyond it rows and table meet by a shuffle, where one frequent
value would fill one task: a frequent-items sketch (mergeable, one scan, nothing shuffled) names the values that are more than half a
task's share, their few table rows are broadcast, and only the other rows are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featpipe.session import shuffle_partitions

# items a sketch keeps at least; for p tasks it keeps 32 p or more, so its error stays below an eighth of the share it looks for
SKETCH_ITEMS = 10_000
MOST_SKETCH_ITEMS = 1_000_000


def broadcast_limit(df: DataFrame) -> int:
    """The session's own limit for broadcasts in bytes (negative: none are made)."""
    limit = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).lower()
    m = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", limit)
    return int(m.group(1)) * 1024 ** " kmgt".index(m.group(2) or " ") if m else 10 << 20


def fits_broadcast(df: DataFrame, n_bytes: int) -> bool:
    """Whether a fitted table of this measured size may be broadcast: the session's own threshold decides."""
    return 0 <= n_bytes <= broadcast_limit(df)


def measured(frame: DataFrame, value: str, extra: int) -> tuple[int, int]:
    """Rows and bytes of a fitted table: its value as text plus ``extra`` bytes a row."""
    r = frame.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0)).cast("long")).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0) + int(r["n"]) * extra


def frequent_hashes(df: DataFrame, key: Column, tasks: int) -> list[int]:
    """Hashes of the values of ``key`` that more than one in ``2 * tasks`` rows hold; at most ``2 * tasks`` of them.

    NULL counts as a value. Counts come from a sketch: a value near the border may be named or not, which decides only the way its
    rows take. An empty table has none."""
    most = min(2 * tasks, 100_000)
    items = min(max(SKETCH_ITEMS, 32 * tasks), MOST_SKETCH_ITEMS)
    r = df.select(F.xxhash64(key).alias("h")).agg(F.expr(f"approx_top_k(h, {most}, {items})").alias("top"), F.count("*").alias("n")).first()
    return [t["item"] for t in r["top"] or [] if t["count"] * 2 * tasks > r["n"]]


def look_up(df: DataFrame, on: str, table: DataFrame, table_on: str, n_bytes: int, row_bytes: int, null_safe: bool = True,
            limit: int | None = None) -> DataFrame:
    """Every row of ``df`` with the other columns of the ``table`` row of its key (NULLs where there is none).

    ``table`` holds a key at most once and ``n_bytes`` in all, ``row_bytes`` a row beside the key; its column names must not occur in
    ``df``. With ``null_safe`` a NULL key finds the table's NULL row, else nothing. ``limit``: bytes up to which a table is broadcast
    (default: the session's). Where no value is frequent the rows are joined by one shuffle; else ``df`` is read once for the
    frequent values' rows, which are not shuffled, and once for the others."""
    limit = broadcast_limit(df) if limit is None else limit
    fields = [c for c in table.columns if c != table_on]

    def joined(rows: DataFrame, found: DataFrame) -> DataFrame:
        same = rows[on].eqNullSafe(found[table_on]) if null_safe else rows[on] == found[table_on]
        return rows.join(found, same, "left").select(*[rows[c] for c in df.columns], *[found[c] for c in fields])

    if 0 <= n_bytes <= limit:
        return joined(df, F.broadcast(table))
    # both sides hash the key in its common type, so equal keys have equal hashes
    key = F.coalesce(df[on], F.lit(None).cast(table.schema[table_on].dataType))
    table_key = F.coalesce(table[table_on], F.lit(None).cast(df.schema[on].dataType))
    hashes = frequent_hashes(df, key, shuffle_partitions(df.sparkSession)) if limit >= 0 else []
    if not hashes:
        return joined(df, table)
    few = table.where(F.xxhash64(table_key).isin(hashes))
    if measured(few, table_on, row_bytes)[1] > limit:
        return joined(df, table)  # rows too wide to broadcast even these: Spark splits the skewed partitions
    frequent = F.xxhash64(key).isin(hashes)
    return joined(df.where(frequent), F.broadcast(few)).union(joined(df.where(~frequent), table))
