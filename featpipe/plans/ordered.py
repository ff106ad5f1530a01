"""Order-dependent computations (row numbers, running totals, lag) that stay parallel.

A plain ``Window.partitionBy(k).orderBy(o)`` sends every row of one ``k`` to one task. When
``k`` is a class label (two or three values) or absent (a global order), that task holds a
third or all of the table. Here *heavy* keys - those with more than ``N / (2 * partitions)``
rows, so at most ``2 * partitions`` of them - have their order column cut into ranges; every other
key keeps its whole window. The window then runs per ``(k, range)``, the heavy keys' per-range totals
are combined with a small window over the ``(k, range)`` table and joined back. The same plan runs
at every size; results are exact, only the work split depends on the sketch.

All public functions take and return DataFrames; nothing row-level goes through the driver.
Only the heavy keys and the range bounds are collected. Ranges split on the first
order column, so it should be close to unique (ids, timestamps, values already reduced to
distinct rows); rows sharing one value of it always share a range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_B = "_fp_bucket"
_H = "_fp_heavy"
# a range of heavy keys aims at this many rows at most; its number has no upper limit
ROWS_PER_RANGE = 1_000_000
# rank error about 0.1 % of the rows at some 100 KB per sketch
SKETCH_K = 4096
# sketches are merged in two steps, the first over this many groups of tasks
SKETCH_GROUPS = 256
TEXT_SAMPLE_PER_RANGE = 32


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def default_buckets(df: DataFrame, rows: int = 0) -> int:
    """Ranges for ``rows`` rows: four per shuffle partition, more where a range would exceed ROWS_PER_RANGE."""
    conf = df.sparkSession.conf.get("featpipe.ordered.buckets", None)
    if conf:
        return max(1, int(conf))
    return max(16, 4 * partitions(df), -(-rows // ROWS_PER_RANGE))


def order_key(c: Column, dtype: T.DataType) -> Column | None:
    """A double that never decreases as ``c`` increases, for numeric, date and timestamp
    columns (None for other types). Range bounds and range lookups both use it."""
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # wall-clock seconds built from zone-free parts (a zone-based conversion is not monotone
        # across daylight-saving changes)
        return (F.unix_date(c.cast("date")).cast("double") * F.lit(86400.0) + F.hour(c) * F.lit(3600.0)
                + F.minute(c) * F.lit(60.0) + F.date_part(F.lit("SECOND"), c).cast("double"))
    return None


def range_bounds(df: DataFrame, col: str, n_buckets: int | None = None) -> list:
    """Sorted, distinct cut points that split ``col`` into ranges (``[]``: one range).

    For numeric, date and timestamp columns the bounds are quantiles of ``order_key(col)`` from mergeable
    KLL sketches, merged in two steps so that no task receives a sketch from every other. For other
    types they are values of a random sample of fixed size per range.
    """
    key = order_key(F.col(col), df.schema[col].dataType)
    return [b for b in _bounds(df, col, key, n_buckets) if not (isinstance(b, float) and math.isnan(b))]


def _bounds(df: DataFrame, col: str, key: Column | None, n_buckets: int | None, distinct: bool = True) -> list:
    if key is not None:
        v = df.select(key.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
        part = v.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("p")).agg(
            F.kll_sketch_agg_double("v", SKETCH_K).alias("s"))
        sketch, n = part.agg(F.kll_merge_agg_double("s").alias("s")).select("s", F.kll_sketch_get_n_double("s")).first()
        ranges = n_buckets or default_buckets(df, n or 0)
        if not n or ranges <= 1:
            return []
        ranks = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
        one = df.sparkSession.sql("SELECT 1 AS one").select(F.kll_sketch_get_quantile_double(F.lit(bytes(sketch)), ranks).alias("q"))
        vals = one.first()["q"]  # evaluated on the driver: no job
        return sorted(set(vals)) if distinct else sorted(vals)
    n = n_buckets or default_buckets(df, 0 if n_buckets else df.count())
    if n <= 1:
        return []
    # Python sorts str by code point, which equals Spark's byte order on UTF-8
    rows = df.select(col).where(F.col(col).isNotNull()).orderBy(F.rand(17)).limit(TEXT_SAMPLE_PER_RANGE * n).collect()
    sample = sorted(r[0] for r in rows)
    return sorted(set(sample[len(sample) * i // n] for i in range(1, n))) if sample else []


def bucket_of(c: Column, bounds: Sequence, dtype: T.DataType, fan: int = 256) -> Column:
    """Number of bounds <= c. Up to ``fan`` bounds: a balanced CASE tree (log2 depth, stays in code generation).
    Beyond: a tree over every n-th bound picks a group of bounds, which is then counted through.

    Monotone in ``c``; NULL maps to -1 so it sorts before every range, like Spark's
    ascending NULLS FIRST.
    """

    def tree(cuts: Sequence) -> Column:
        def build(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi + 1) // 2
            return F.when(c >= F.lit(cuts[mid - 1]).cast(dtype), build(mid, hi)).otherwise(build(lo, mid - 1))

        return build(0, len(cuts))

    if len(bounds) <= fan:
        found = tree(bounds)
    else:
        step = -(-len(bounds) // fan)
        groups = [list(bounds[i : i + step]) for i in range(0, len(bounds), step)]
        lists = F.array(*[F.array(*[F.lit(b).cast(dtype) for b in g]) for g in groups])
        # the tree over the groups' first bounds gives the group (none: 0 bounds <= c)
        g = tree([x[0] for x in groups])
        found = F.when(g == 0, F.lit(0)).otherwise(
            (g - 1) * step + F.size(F.filter(F.get(lists, g - 1), lambda b: b <= c)))
    return F.when(c.isNull(), F.lit(-1)).otherwise(found)


def with_buckets(df: DataFrame, order_col: str, n_buckets: int | None = None, bounds: list | None = None
                 ) -> DataFrame:
    """Add the range index of ``order_col`` (NULL -> -1, before every range).

    ``bounds`` computed earlier (e.g. on the raw column, before an aggregation) skip the sketch
    job; any sorted list gives exact results, the bounds only decide how evenly work is split.
    Numeric and temporal columns are looked up by binary search (MLlib ``Bucketizer``, a JVM
    function) on ``order_key``; text columns by ``bucket_of``.
    """
    if bounds is None:
        bounds = range_bounds(df, order_col, n_buckets)
    dtype = df.schema[order_col].dataType
    key = order_key(F.col(order_col), dtype)
    if key is None:
        return df.withColumn(_B, bucket_of(F.col(order_col), bounds, dtype))
    from pyspark.ml.feature import Bucketizer

    splits = sorted(set(float(b) for b in bounds if b is not None and b == b and not math.isinf(b)))
    if not splits:
        return df.withColumn(_B, F.when(F.col(order_col).isNull(), F.lit(-1)).when(F.isnan(key), F.lit(1)).otherwise(F.lit(0)))
    bz = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_fp_key", outputCol="_fp_bkt",
                    handleInvalid="keep")  # NaN -> one more range after all others (NaN sorts last)
    out = bz.transform(df.withColumn("_fp_key", key))
    return out.withColumn(_B, F.when(F.col(order_col).isNull(), F.lit(-1)).otherwise(F.col("_fp_bkt").cast("int"))) \
        .drop("_fp_key", "_fp_bkt")


@dataclass
class Split:
    """How an ordered computation is cut: which keys are heavy (``None``: all of them) and the ranges for those."""

    keys: list[str]
    heavy: list[tuple] | None
    bounds: list = field(default_factory=list)


def heavy_keys(df: DataFrame, keys: Sequence[str]) -> list[tuple]:
    """Keys with more rows than ``N / (2 * partitions)``: at most ``2 * partitions`` of them."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_fp_n"))
    limit = counts.agg(F.sum("_fp_n") / F.lit(2.0 * partitions(df))).scalar()
    return [tuple(r) for r in counts.where(F.col("_fp_n") > limit).select(*keys).collect()]


def plan_split(df: DataFrame, partition_by: Sequence[str], order_col: str, n_buckets: int | None = None) -> Split:
    """Find the heavy keys (one count per key, combined map-side) and, if there are any, the ranges of their rows."""
    keys = list(partition_by)
    if not keys or n_buckets is not None:
        return Split(keys, None, range_bounds(df, order_col, n_buckets))
    heavy = heavy_keys(df, keys)
    if not heavy:
        return Split(keys, [])
    own = df.where(_is_heavy(keys, heavy)) if len(heavy) < 4 * partitions(df) else df
    return Split(keys, heavy, range_bounds(own, order_col))


def _is_heavy(keys: list[str], heavy: list[tuple]) -> Column:
    if len(keys) == 1:
        plain = [h[0] for h in heavy if h[0] is not None]
        out = F.col(keys[0]).isin(plain) if plain else F.lit(False)
        out = F.coalesce(out, F.lit(False))
        return out | F.col(keys[0]).isNull() if len(plain) < len(heavy) else out
    one = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, h, strict=True)]) for h in heavy]
    return reduce(lambda a, b: a | b, one)


def _cut(df: DataFrame, split: Split, order_col: str) -> DataFrame:
    """Add the range (0 for the whole window of a key that is not heavy) and the heavy flag."""
    if split.heavy is None:
        return with_buckets(df, order_col, bounds=split.bounds).withColumn(_H, F.lit(True))
    if not split.heavy:
        return df.withColumn(_B, F.lit(0)).withColumn(_H, F.lit(False))
    x = with_buckets(df.withColumn(_H, _is_heavy(split.keys, split.heavy)), order_col, bounds=split.bounds)
    return x.withColumn(_B, F.when(F.col(_H), F.col(_B)).otherwise(F.lit(0)))


def _key_surrogates(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Non-null stand-ins for grouping keys: (value or a typed default, is-null flag).

    Grouping, the window and the join back all use the same plain columns, so the join
    finds its input already hash-partitioned by the window's keys and shuffles only the small
    side (a null-safe ``<=>`` join would rewrite the keys and reshuffle the big side).
    """
    names = []
    for i, k in enumerate(keys):
        dt = df.schema[k].dataType
        if isinstance(dt, T.StringType):
            d = F.lit("")
        elif isinstance(dt, T.BooleanType):
            d = F.lit(False)
        elif isinstance(dt, T.NumericType):
            d = F.lit(0).cast(dt)
        elif isinstance(dt, T.DateType):
            d = F.lit("1970-01-01").cast(dt)
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            d = F.lit("1970-01-01 00:00:00").cast(dt)
        elif isinstance(dt, T.BinaryType):
            d = F.lit(b"")
        else:
            d = None
        if not df.schema[k].nullable:
            names.append(k)
            continue
        if d is None:
            raise TypeError(f"{k}: {dt.simpleString()} cannot be a grouping key of an ordered computation")
        df = df.withColumn(f"_fp_kv{i}", F.coalesce(F.col(k), d)).withColumn(f"_fp_kn{i}", F.col(k).isNull())
        names += [f"_fp_kv{i}", f"_fp_kn{i}"]
    return df, names


def _order_cols(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order_by]


# combine(op) is how per-range totals fold across ranges
_ROW_OP = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}
_FOLD_OP = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


def running(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: Sequence[str | Column],
    specs: Sequence[tuple[str, str, str | Column, bool]],
    n_buckets: int | None = None,
    bounds: list | None = None,
    split: Split | None = None,
) -> DataFrame:
    """Running aggregates along ``order_by`` within ``partition_by``.

    ``specs`` holds ``(out_name, op, column, inclusive)`` with op in sum/min/max/count.
    ``inclusive`` False gives the value over strictly preceding rows (NULL/0 when none).
    The first ``order_by`` entry must be a column name sorted ascending; later entries break
    ties. With a unique order, ``("rn", "count", "*", True)`` is ROW_NUMBER().
    """
    partition_by = list(partition_by)
    first = order_by[0]
    if not isinstance(first, str):
        raise ValueError("the first order column must be given by name (ascending)")
    order = _order_cols(order_by)

    def colof(c):
        if isinstance(c, Column):
            return c
        return F.lit(1) if c == "*" else F.col(c)

    if _B in df.columns:  # cut by the caller
        x = df.withColumn(_H, F.lit(True))
        split = Split(partition_by, None)
    else:
        if split is None:
            split = Split(partition_by, None, bounds) if bounds is not None else plan_split(df, partition_by, first, n_buckets)
        x = _cut(df, split, first)
    if split.heavy == []:
        w = Window.partitionBy(*partition_by).orderBy(*order)
        return df.select("*", *[
            _ROW_OP[op](colof(c)).over(w.rowsBetween(Window.unboundedPreceding, 0 if inc else -1)).alias(name)
            for name, op, c, inc in specs])
    x, pkeys = _key_surrogates(x, partition_by)
    keys = pkeys + [_B]

    totals = x.where(_H).groupBy(*keys).agg(*[_ROW_OP[op](colof(c)).alias(f"_fp_t{i}") for i, (_, op, c, _) in enumerate(specs)])
    wb = Window.partitionBy(*pkeys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(
        *keys,
        *[_FOLD_OP[op](F.col(f"_fp_t{i}")).over(wb).alias(f"_fp_o{i}") for i, (_, op, _, _) in enumerate(specs)],
    )
    wl = Window.partitionBy(*keys).orderBy(*order)
    local_cols = []
    for i, (_, op, c, inclusive) in enumerate(specs):
        frame = wl.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local_cols.append(_ROW_OP[op](colof(c)).over(frame).alias(f"_fp_l{i}"))
    local = x.select("*", *local_cols)
    j = local.join(offs, on=keys, how="left")
    outs = []
    for i, (name, op, _, _) in enumerate(specs):
        o, l = F.col(f"_fp_o{i}"), F.col(f"_fp_l{i}")
        if op in ("sum", "count"):
            if op == "count":
                v = F.coalesce(o, F.lit(0)) + F.coalesce(l, F.lit(0))
            else:
                v = F.when(o.isNull() & l.isNull(), F.lit(None)).otherwise(F.coalesce(o, F.lit(0)) + F.coalesce(l, F.lit(0)))
        elif op == "min":
            v = F.least(o, l)
        else:
            v = F.greatest(o, l)
        outs.append(v.alias(name))
    keep = [c for c in df.columns if c != _B]
    return j.select(*[F.col(c) for c in keep], *outs)


def row_number(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column], out: str = "rn",
               n_buckets: int | None = None, bounds: list | None = None) -> DataFrame:
    """Exact ROW_NUMBER() OVER (PARTITION BY .. ORDER BY ..); the order must be unique."""
    return running(df, partition_by, order_by, [(out, "count", "*", True)], n_buckets, bounds).withColumn(
        out, F.col(out).cast("int")
    )


def lag(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column], col: str, out: str,
        n_buckets: int | None = None, split: Split | None = None) -> DataFrame:
    """Exact LAG(col) OVER (PARTITION BY .. ORDER BY ..); heavy keys have their order cut into ranges."""
    partition_by = list(partition_by)
    first = order_by[0]
    order = _order_cols(order_by)
    split = split or plan_split(df, partition_by, first, n_buckets)
    if split.heavy == []:
        return df.select("*", F.lag(F.col(col)).over(Window.partitionBy(*partition_by).orderBy(*order)).alias(out))
    x, pkeys = _key_surrogates(_cut(df, split, first), partition_by)
    keys = pkeys + [_B]
    wl = Window.partitionBy(*keys).orderBy(*order)
    local = x.select("*", F.lag(F.col(col)).over(wl).alias("_fp_lag"), (F.row_number().over(wl) == 1).alias("_fp_first"))
    last = x.where(_H).groupBy(*keys).agg(F.max_by(F.col(col), F.struct(*order)).alias("_fp_last"))
    prev = last.select(*keys, F.lag("_fp_last").over(Window.partitionBy(*pkeys).orderBy(_B)).alias("_fp_prev"))
    j = local.join(prev, on=keys, how="left")
    return j.select(*[F.col(c) for c in df.columns],
                    F.when(F.col("_fp_first"), F.col("_fp_prev")).otherwise(F.col("_fp_lag")).alias(out))


def lead(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column], col: str, out: str,
         n_buckets: int | None = None, split: Split | None = None) -> DataFrame:
    """Exact LEAD(col) OVER (PARTITION BY .. ORDER BY ..), cut like ``lag``."""
    partition_by = list(partition_by)
    first = order_by[0]
    order = _order_cols(order_by)
    split = split or plan_split(df, partition_by, first, n_buckets)
    if split.heavy == []:
        return df.select("*", F.lead(F.col(col)).over(Window.partitionBy(*partition_by).orderBy(*order)).alias(out))
    x, pkeys = _key_surrogates(_cut(df, split, first), partition_by)
    keys = pkeys + [_B]
    wl = Window.partitionBy(*keys).orderBy(*order)
    local = x.select("*", F.lead(F.col(col)).over(wl).alias("_fp_lead"), F.lead(F.lit(1)).over(wl).isNull().alias("_fp_last"))
    heads = x.where(_H).groupBy(*keys).agg(F.min_by(F.col(col), F.struct(*order)).alias("_fp_head"))
    after = heads.select(*keys, F.lead("_fp_head").over(Window.partitionBy(*pkeys).orderBy(_B)).alias("_fp_next"))
    j = local.join(after, on=keys, how="left")
    return j.select(*[F.col(c) for c in df.columns],
                    F.when(F.col("_fp_last"), F.col("_fp_next")).otherwise(F.col("_fp_lead")).alias(out))


def collapsed(raw: DataFrame, groups: Sequence[str], value: str, sums: dict[str, Column], n_buckets: int | None = None,
              descending: bool = False) -> DataFrame:
    """``(groups, value, sums)`` with one row per distinct value, cut into ranges of ``value`` and ready for ``running``.

    One exchange serves the aggregation and the window after it: rows go to their (groups, range) and are summed there. Values
    that fill a range or more (bounds the sketch gives twice) are summed before that exchange, so none of them piles up.
    """
    groups = list(groups)
    all_bounds = _bounds(raw, value, F.col(value).cast("double"), n_buckets, distinct=False)
    bounds = sorted(set(all_bounds))
    hot = sorted({a for a, b in zip(all_bounds, all_bounds[1:], strict=False) if a == b})
    each = raw.select(*groups, value, *[c.alias(n) for n, c in sums.items()])
    total = [F.sum(n).alias(n) for n in sums]
    if hot:
        is_hot = F.coalesce(F.col(value).isin(hot), F.lit(False))
        each = each.where(~is_hot).unionByName(each.where(is_hot).groupBy(*groups, value).agg(*total))
    order = f"_fp_neg_{value}" if descending else value
    if descending:
        each = each.withColumn(order, -F.col(value))
        bounds = sorted(-b for b in bounds)
    x = with_buckets(each, order, bounds=bounds)
    x, keys = _key_surrogates(x, groups)
    x = x.repartition(*keys, _B)
    made = [k for k in keys if k not in groups]
    return x.groupBy(*dict.fromkeys([*keys, _B, *groups, value, order])).agg(*total).drop(*made)


def dense_index(values: DataFrame, col: str, out: str = "idx", nulls_last: bool = True,
                n_buckets: int | None = None) -> DataFrame:
    """0-based position of each distinct ``col`` in sorted order (the vocabulary index).

    ``values`` is reduced to distinct values first (partial aggregation), then ranked with
    the range-split row number. NULL is one more category, placed last when ``nulls_last``.
    """
    d = values.select(col).distinct()
    # computed and written once: the sample of the bounds, the ranking and the NULL row all read this table
    if values.sparkSession.sparkContext.getCheckpointDir() is not None:
        d = d.checkpoint(eager=True)
    non_null = row_number(d.where(F.col(col).isNotNull()), [], [col], "_fp_rn", n_buckets)
    non_null = non_null.select(F.col(col), (F.col("_fp_rn") - 1).cast("int").alias(out))
    if not nulls_last:
        return non_null
    # NULL takes index = number of non-null values; computed as a scalar subquery
    null_row = d.where(F.col(col).isNull()).select(F.col(col), d.agg(F.count(col)).scalar().cast("int").alias(out))
    return non_null.unionByName(null_row)
