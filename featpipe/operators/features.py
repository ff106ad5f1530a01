"""Feature operators with fitted state (FEA1-FEA21).

A *fit* is one aggregation over the training rows and returns a small state: numbers (a dict
per column) or a dictionary DataFrame (value -> index). A *transform* is a column
expression; numbers are folded into it as literals so the plan stays in whole-stage codegen,
and dictionaries are joined (broadcast when their size, known from the fit, is below a limit).

All fits that need plain aggregates share one ``agg`` pass (``fit_numeric_stats``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featpipe.operators.lookup import look_up, measured as _measured
from featpipe.plans import ordered, selection

# Fixed value: ranges / deviations at or below this count as zero.
EPS = 1e-8


class FeatureError(ValueError):
    pass


def _bad(v) -> bool:
    return v is None or (isinstance(v, float) and (math.isnan(v) or math.isinf(v)))


# ---------------------------------------------------------------- numeric statistics

def fit_numeric_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """count, mean, sample std, min, max of every column in one aggregation pass."""
    aggs = []
    for c in columns:
        aggs += [
            F.count(c).alias(f"{c}__n"),
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_samp(c).alias(f"{c}__std"),
            F.min(c).cast("double").alias(f"{c}__min"),
            F.max(c).cast("double").alias(f"{c}__max"),
        ]
    row = df.agg(*aggs).first()
    return {c: {k: row[f"{c}__{k}"] for k in ("n", "mean", "std", "min", "max")} for c in columns}


def fit_standard_scaler(df: DataFrame, columns: Sequence[str], eps: float | None = None) -> dict:
    """Mean and sample std per column. A std that is NULL/NaN (one row), 0, or <= eps becomes 1."""
    stats = fit_numeric_stats(df, columns)
    state = {}
    for c, s in stats.items():
        std = s["std"]
        if _bad(std) or std == 0 or (eps is not None and std <= eps):
            std = 1.0
        state[c] = {"mean": s["mean"], "std": std}
    return {"kind": "standard", "columns": list(columns), "params": state}


def standard_scale(state: dict, c: str) -> Column:
    p = state["params"][c]
    if p["mean"] is None:
        return F.lit(None).cast("double")
    return (F.col(c).cast("double") - F.lit(float(p["mean"]))) / F.lit(float(p["std"]))


def fit_minmax(df: DataFrame, columns: Sequence[str], feature_range=(0.0, 1.0), eps: float = EPS) -> dict:
    """min/max per column; a range <= eps becomes [min, min + 1] (FEA11)."""
    lo, hi = feature_range
    if lo >= hi:
        raise FeatureError("feature_range must have min < max")
    stats = fit_numeric_stats(df, columns)
    params = {}
    for c, s in stats.items():
        mn, mx = s["min"], s["max"]
        if mn is not None and mx is not None and mx - mn <= eps:
            mx = mn + 1.0
        params[c] = {"min": mn, "max": mx}
    return {"kind": "minmax", "columns": list(columns), "params": params, "range": [lo, hi]}


def minmax_scale(state: dict, c: str) -> Column:
    p = state["params"][c]
    lo, hi = state["range"]
    if p["min"] is None:
        return F.lit(None).cast("double")
    norm = (F.col(c).cast("double") - F.lit(float(p["min"]))) / F.lit(float(p["max"] - p["min"]))
    return norm * F.lit(float(hi - lo)) + F.lit(float(lo))


def fit_minmax_sql(df: DataFrame, columns: Sequence[str]) -> dict:
    """The SQL recipe ``(v - min) / (max - min)`` fitted on training rows (FEA16): no range fix."""
    stats = fit_numeric_stats(df, columns)
    return {"kind": "minmax_sql", "columns": list(columns),
            "params": {c: {"min": s["min"], "max": s["max"]} for c, s in stats.items()}}


def apply_minmax_sql(state: dict, c: str) -> Column:
    p = state["params"][c]
    if p["min"] is None or p["max"] is None or p["max"] == p["min"]:
        return F.lit(None).cast("double")
    return (F.col(c).cast("double") - F.lit(float(p["min"]))) / F.lit(float(p["max"] - p["min"]))


# ---------------------------------------------------------------- exact quantiles

def approx_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                     names: Sequence[str] | None = None, accuracy: int = 10000) -> DataFrame:
    """Opt-in sketch quantiles (``percentile_approx``): one pass, fixed memory per group;
    rank error about 1/accuracy."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    q = F.percentile_approx(F.col(value_col).cast("double"), list(probs), accuracy)
    out = df.groupBy(*group_cols).agg(q.alias("_fp_q"))
    return out.select(*group_cols, *[F.col("_fp_q")[i].alias(n) for i, n in enumerate(names)])


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                    names: Sequence[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (``quantile_cont`` / pandas default).

    The values at ranks ``floor(p(n-1))`` and ``ceil(p(n-1))`` are selected without moving the column (``plans/selection.py``), for the whole
    table or for the groups that hold many rows each (at most twice the shuffle partitions). Where there are more groups than
    that, the others are small: each is sorted by a plain window. Returns one row per group with one column per probability (none for an empty
    table); NULL is a group, NULL values are left out, NaN counts as the largest. ``n_buckets`` is no longer used.
    """
    g = list(group_cols)
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    keys = [f"_fp_k{i}" for i in range(len(g))]
    raw = df.where(F.col(value_col).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(g, keys, strict=True)],
                                                        F.col(value_col).cast("double").alias("v"))
    few = 2 * ordered.partitions(df)
    chosen = light = None
    if g:
        counts = raw.groupBy(*keys).agg(F.count("*").alias("n"))
        if len(counts.select("n").limit(few + 1).collect()) > few:
            heavy = ordered.heavy_keys(raw, keys)
            is_heavy = ordered._is_heavy(keys, heavy) if heavy else F.lit(False)
            light, chosen = raw.where(~is_heavy), (raw.where(is_heavy) if heavy else None)
        else:
            chosen = raw
    else:
        chosen = raw
    schema = T.StructType([T.StructField(k, raw.schema[k].dataType) for k in keys])
    for i in range(len(names)):
        schema = schema.add(f"_fp_q{i}", T.DoubleType())
    rows = []
    for group, n, at in selection.order_statistics(chosen, keys, sorted(set(probs))) if chosen is not None else []:
        part = {p: p * (n - 1) - math.floor(p * (n - 1)) for p in probs}
        rows.append((*group, *[at[p][0] if not part[p] else at[p][0] + part[p] * (at[p][1] - at[p][0]) for p in probs]))
    out = df.sparkSession.createDataFrame(rows, schema)
    if light is not None:
        w = Window.partitionBy(*keys)
        ranked = light.withColumn("r", F.row_number().over(w.orderBy("v")) - 1).withColumn("n", F.count("*").over(w) - 1)
        pos = [F.lit(float(p)) * F.col("n") for p in probs]
        lo = [F.max(F.when(F.col("r") == F.floor(x), F.col("v"))) for x in pos]
        hi = [F.max(F.when(F.col("r") == F.ceil(x), F.col("v"))) for x in pos]
        part = [F.max(x - F.floor(x)) for x in pos]
        out = out.unionByName(ranked.groupBy(*keys).agg(*[
            F.when(f == 0, a).otherwise(a + f * (b - a)).alias(f"_fp_q{i}") for i, (a, b, f) in enumerate(zip(lo, hi, part, strict=True))]))
    return out.select(*[F.col(k).alias(c) for c, k in zip(g, keys, strict=True)], *[F.col(f"_fp_q{i}").alias(nm) for i, nm in enumerate(names)])


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     names: Sequence[str] | None = None) -> dict[str, dict]:
    """Exact quantiles of several columns in one pass: the columns are unpivoted to
    ``(column, value)`` and the column name becomes the group. Returns
    ``{column: {name: value}}`` (a few numbers per column)."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    if len(columns) == 1:  # nothing to share: the ungrouped plan is cheaper
        row = exact_quantiles(df, columns[0], probs, names=names).first()
        return {columns[0]: {n: (row[n] if row else None) for n in names}}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_fp_col"), F.col(c).cast("double").alias("_fp_val")) for c in columns
    ])).alias("_fp_kv")).select("_fp_kv.*")
    q = exact_quantiles(long, "_fp_val", probs, ["_fp_col"], names)
    got = {r["_fp_col"]: {n: r[n] for n in names} for r in q.collect()}  # one row per column
    return {c: got.get(c, {n: None for n in names}) for c in columns}


def fit_robust(df: DataFrame, columns: Sequence[str], eps: float = EPS) -> dict:
    """Median and IQR per column (FEA12); an IQR <= eps becomes 1. Distributed, exact, all
    columns in one pass."""
    qs = column_quantiles(df, columns, [0.25, 0.5, 0.75], ["q1", "med", "q3"])
    params = {}
    for c in columns:
        q1, med, q3 = qs[c]["q1"], qs[c]["med"], qs[c]["q3"]
        iqr = None if q1 is None else q3 - q1
        if iqr is not None and iqr <= eps:
            iqr = 1.0
        params[c] = {"median": med, "iqr": iqr}
    return {"kind": "robust", "columns": list(columns), "params": params}


def robust_scale(state: dict, c: str) -> Column:
    p = state["params"][c]
    if p["median"] is None:
        return F.lit(None).cast("double")
    return (F.col(c).cast("double") - F.lit(float(p["median"]))) / F.lit(float(p["iqr"]))


# ---------------------------------------------------------------- imputation (FEA15)

def fit_median_imputer(df: DataFrame, columns: Sequence[str]) -> dict:
    """Training-set median of every column (FEA15), all columns in one pass."""
    qs = column_quantiles(df, columns, [0.5], ["med"])
    return {"kind": "median_impute", "columns": list(columns), "params": {c: qs[c]["med"] for c in columns}}


def impute(state: dict, c: str) -> Column:
    v = state["params"][c]
    return F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double"))


def impute_constant(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill(values)


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


# ---------------------------------------------------------------- dictionaries (FEA7/8/13/20)

@dataclass
class Vocabulary:
    """A fitted value -> index dictionary, held as a DataFrame ``(value, idx)``."""

    column: str
    frame: DataFrame
    size: int
    version: int = 1
    meta: dict = field(default_factory=dict)
    n_bytes: int | None = None


def fit_label_encoder(df: DataFrame, col: str, include_null: bool = True, n_buckets: int | None = None,
                      cut_lineage: bool = True) -> Vocabulary:
    """Sorted distinct values -> 0..k-1; NULL is one more category and sorts last (FEA7).

    The dictionary is ranked in parallel and written once to the checkpoint folder, so later
    joins do not recompute the distinct + rank.
    """
    vocab = ordered.dense_index(df, col, "idx", nulls_last=include_null, n_buckets=n_buckets)
    vocab = vocab.select(F.col(col).alias("value"), "idx")
    if cut_lineage:
        vocab = vocab.checkpoint(eager=True)
    size, n_bytes = _measured(vocab, "value", 12)
    return Vocabulary(col, vocab, size, n_bytes=n_bytes)


def label_encode(df: DataFrame, col: str, vocab: Vocabulary, out: str | None = None,
                 handle_unknown: str = "use_unknown_value", unknown_value: int | None = None, limit: int | None = None) -> DataFrame:
    """Index of each value; unseen values -> ``unknown_value`` (default: vocabulary size), or
    an error that lists up to 10 known values (FEA8). ``limit``: bytes up to which the dictionary is broadcast, see ``look_up``."""
    out = out or f"{col}_idx"
    v = vocab.frame.select(F.col("value").alias("_fp_value"), F.col("idx").alias("_fp_idx"))
    n_bytes = _measured(vocab.frame, "value", 12)[1] if vocab.n_bytes is None else vocab.n_bytes
    j = look_up(df, col, v, "_fp_value", n_bytes, 12, limit=limit)
    if handle_unknown == "error":
        unseen = j.where(F.col("_fp_idx").isNull()).select(col).limit(1).collect()
        if unseen:
            known = [r["value"] for r in vocab.frame.orderBy("idx").limit(10).collect()]
            shown = ", ".join(repr(k) for k in known)
            if vocab.size > 10:
                shown += f", ... ({vocab.size} total)"
            raise FeatureError(f"{col}: value {unseen[0][0]!r} was not seen in fitting; known values are {shown}")
    elif handle_unknown != "use_unknown_value":
        raise FeatureError("handle_unknown must be 'use_unknown_value' or 'error'")
    unk = vocab.size if unknown_value is None else unknown_value
    return j.select(*[j[c] for c in df.columns], F.coalesce(F.col("_fp_idx"), F.lit(unk)).cast("bigint").alias(out))


def fit_categories(df: DataFrame, col: str, max_categories: int | None = 1000) -> list[str]:
    """Sorted distinct non-NULL values as text (one-hot fit, FEA13). One-hot makes a column per category; more than
    ``max_categories`` is an error (``None``: no limit). See ``one_hot_sparse`` for large dictionaries."""
    got = fit_categories_many(df, [col], max_categories)[col]
    return got


def fit_categories_many(df: DataFrame, columns: Sequence[str], max_categories: int | None = 1000, sparse: bool = False
                        ) -> dict[str, list[str] | Vocabulary]:
    """``fit_categories`` for several columns in two passes whatever their number: distinct
    counts per column first (so nothing above the limit is collected), then the distinct
    (column, value) pairs. With ``sparse`` a column above the limit gets a distributed ``Vocabulary`` instead
    of an error; it is encoded as a sparse vector."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_fp_col"), F.col(c).cast("string").alias("_fp_val")) for c in columns
    ])).alias("_fp_kv")).select("_fp_kv.*").where(F.col("_fp_val").isNotNull()).distinct()
    counts = {r["_fp_col"]: r["n"] for r in pairs.groupBy("_fp_col").agg(F.count("*").alias("n")).collect()}
    out: dict[str, list[str] | Vocabulary] = {}
    for c in columns:
        if not counts.get(c):
            raise FeatureError(f"{c}: every value is NULL or there are no rows to fit on")
        if max_categories is not None and counts[c] > max_categories:
            if not sparse:
                raise FeatureError(f"{c}: {counts[c]} categories exceed the limit of {max_categories}; raise "
                                   "max_categories, or ask for the sparse form")
            out[c] = fit_label_encoder(df.select(F.col(c).cast("string").alias(c)).where(F.col(c).isNotNull()), c, include_null=False)
        else:
            out[c] = []
    dense = [c for c in columns if isinstance(out[c], list)]
    if dense:
        for r in pairs.where(F.col("_fp_col").isin(dense)).collect():  # within the limit the caller set
            out[r["_fp_col"]].append(r["_fp_val"])
    return {c: sorted(v) if isinstance(v, list) else v for c, v in out.items()}


def one_hot(df: DataFrame, col: str, categories: Sequence[str], handle_unknown: str = "ignore",
            drop_input: bool = False) -> DataFrame:
    """``{col}_{cat}`` 0/1 columns; unknown values give all zeros, or an error (FEA13/FEA14)."""
    s = F.col(col).cast("string")
    if handle_unknown == "error":
        bad = df.where(s.isNotNull() & ~s.isin(list(categories))).select(col).limit(1).collect()
        if bad:
            raise FeatureError(f"{col}: {bad[0][0]!r} is none of the fitted categories")
    cols = [F.when(s == F.lit(c), F.lit(1)).otherwise(F.lit(0)).alias(f"{col}_{c}") for c in categories]
    base = [c for c in df.columns if not (drop_input and c == col)]
    return df.select(*base, *cols)


def one_hot_sparse(df: DataFrame, col: str, vocab: Vocabulary, out: str | None = None, handle_unknown: str = "ignore") -> DataFrame:
    """One-hot as an MLlib sparse vector, for many categories (FEA13): the dictionary index,
    then ``OneHotEncoder`` sized from the dictionary itself. Unknown values -> all zeros, or an error (NULL is never one)."""
    from pyspark.ml.feature import OneHotEncoder

    out = out or f"{col}_onehot"
    if handle_unknown == "error":
        label_encode(df.where(F.col(col).isNotNull()).select(col), col, vocab, handle_unknown="error")
    idx = label_encode(df, col, vocab, out="_fp_no").withColumn("_fp_no", F.col("_fp_no").cast("double"))
    # the unknown index (= size) is "invalid": kept as an extra slot, which dropLast removes
    enc = OneHotEncoder(inputCols=["_fp_no"], outputCols=[out], dropLast=True, handleInvalid="keep")
    model = enc.fit(vocab.frame.select(F.col("idx").cast("double").alias("_fp_no")))
    return model.transform(idx).drop("_fp_no")


def save_vocabulary(vocab: Vocabulary, path: str) -> None:
    """Persist as typed parquet ``(feature, value, idx, version)`` (FEA20). Every feature and version has its own
    folder; saving replaces that folder only, so other versions stay readable."""
    vocab.frame.select("value", "idx", F.lit(vocab.column).alias("feature"), F.lit(vocab.version).alias("version")).write.mode(
        "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature", "version").parquet(path)


def load_vocabulary(spark, path: str, column: str, version: int | None = None) -> Vocabulary:
    """The given version of a feature's dictionary (default: the latest); an absent one is an error."""
    df = spark.read.parquet(path).where(F.col("feature") == column)
    known = [int(r["version"]) for r in df.select("version").distinct().collect()]
    if not known or (version is not None and version not in known):
        raise FeatureError(f"{path} holds no version {version or ''} of {column}'s dictionary (there are {sorted(known)})")
    version = max(known) if version is None else int(version)
    frame = df.where(F.col("version") == version).select("value", "idx")
    size, n_bytes = _measured(frame, "value", 12)
    return Vocabulary(column, frame, size, version, n_bytes=n_bytes)


# ---------------------------------------------------------------- target encoding (FEA17)

@dataclass
class TargetEncoding:
    column: str
    frame: DataFrame  # (value, n, mean)
    global_mean: float
    smoothing: float
    size: int = 0
    n_bytes: int | None = None


def fit_target_encoder(df: DataFrame, col: str, target: str, smoothing: float = 1.0,
                       cut_lineage: bool = True) -> TargetEncoding:
    """Per category count and target mean on training rows, plus the global mean.

    Encoded value: ``(n * mean_c + s * mean) / (n + s)``; an unseen category gets the global
    mean. (The reference declares this operator without a body; this is our definition.)
    The per-category table is the fitted state: written once to the checkpoint folder, its
    size and the global mean are then read from it, and it is broadcast when small.
    """
    if smoothing < 0:
        raise FeatureError("smoothing must be >= 0")
    frame = df.groupBy(F.col(col).alias("value")).agg(F.count(target).alias("n"),
                                                      F.sum(F.col(target).cast("double")).alias("_fp_s"))
    if cut_lineage:
        frame = frame.checkpoint(eager=True)
    tot = frame.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("_fp_s").alias("s"), F.sum(F.coalesce(
        F.octet_length(F.col("value").cast("string")), F.lit(0)).cast("long")).alias("b")).first()
    g = None if not tot["n"] else tot["s"] / tot["n"]
    frame = frame.select("value", "n", (F.col("_fp_s") / F.col("n")).alias("mean"))
    return TargetEncoding(col, frame, g, float(smoothing), int(tot["k"]), int(tot["b"] or 0) + 24 * int(tot["k"]))


def save_target_encoding(enc: TargetEncoding, path: str) -> None:
    """Persist the per-category table with the global mean and smoothing as typed columns (FEA17)."""
    enc.frame.select(F.lit(enc.column).alias("feature"), "value", "n", "mean", F.lit(enc.global_mean).cast("double").alias("global_mean"),
                     F.lit(enc.smoothing).alias("smoothing")).write.mode("overwrite").parquet(path)


def load_target_encoding(spark, path: str) -> TargetEncoding:
    t = spark.read.parquet(path)
    head = t.select("feature", "global_mean", "smoothing").first()
    if head is None:
        raise FeatureError(f"{path} holds no target encoding")
    size, n_bytes = _measured(t, "value", 24)
    return TargetEncoding(head["feature"], t.select("value", "n", "mean"), head["global_mean"], head["smoothing"], size, n_bytes)


def target_encode(df: DataFrame, enc: TargetEncoding, out: str | None = None, limit: int | None = None) -> DataFrame:
    """The smoothed mean of each row's category; unseen ones get the global mean (FEA17). ``limit``: see ``look_up``."""
    out = out or f"{enc.column}_te"
    s, g = F.lit(enc.smoothing), F.lit(enc.global_mean).cast("double")
    f = enc.frame.select(F.col("value").alias("_fp_value"), F.col("n").alias("_fp_n"), F.col("mean").alias("_fp_mean"))
    n_bytes = _measured(enc.frame, "value", 24)[1] if enc.n_bytes is None else enc.n_bytes
    j = look_up(df, enc.column, f, "_fp_value", n_bytes, 24, limit=limit)
    val = F.when(F.col("_fp_n").isNull() | ((F.col("_fp_n") + s) == 0), g) \
        .otherwise((F.col("_fp_n") * F.col("_fp_mean") + s * g) / (F.col("_fp_n") + s))
    return j.select(*[j[c] for c in df.columns], val.alias(out))


# ---------------------------------------------------------------- arrays (FEA1/FEA5/FEA6)

def assemble_vector(columns: Sequence[str]) -> Column:
    """Columns -> ``array<float>``; NULL or non-numeric -> 0 (FEA1)."""
    return F.array(*[F.coalesce(F.col(c).try_cast("float"), F.lit(0.0).cast("float")) for c in columns])


def sequence_shift(c, direction: str = "left", fill=0) -> Column:
    """Shift each row's array by one: left drops the head and appends ``fill``; right
    prepends ``fill`` and drops the tail. Empty arrays stay empty (FEA6)."""
    a = F.col(c) if isinstance(c, str) else c
    n = F.size(a)
    fillv = F.array(F.lit(fill).cast(_elem_type_hint(fill)))
    if direction == "left":
        shifted = F.concat(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), fillv)
    elif direction == "right":
        shifted = F.concat(fillv, F.slice(a, 1, F.greatest(n - 1, F.lit(0))))
    else:
        raise FeatureError(f"cannot shift a sequence to '{direction}': left and right are the two ways")
    return F.when(n <= 0, a).otherwise(shifted)


def _elem_type_hint(v) -> str:
    return "double" if isinstance(v, float) else "bigint"


def hash_and_pad(c, num_buckets: int = 1000, max_length: int = 1, fill: int = 0, numeric: bool = True,
                 method: str = "xxhash64") -> Column:
    """Hash each item into [0, n), keep the first ``max_length``, right-pad with ``fill`` (FEA5)."""
    if max_length <= 0:
        raise FeatureError("hash_and_pad needs a max_length of 1 or more")
    from featpipe.functions.hashing import hash_array

    hashed = hash_array(c, num_buckets, numeric, method)
    padded = F.concat(hashed, F.array_repeat(F.lit(fill).cast("bigint"), max_length))
    return F.slice(padded, 1, max_length)


def array_dims_check(c, n: int) -> Column:
    """True when the row's array has the expected length (INP4 row-shape check)."""
    return F.size(F.col(c) if isinstance(c, str) else c) == F.lit(n)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
