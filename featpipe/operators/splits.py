"""Train / validation / test splits without leakage (SPL1-SPL6).

Every split is a column on the input rows, so one scan feeds all parts; separate tables are
filtered writes of that column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featpipe.functions.hashing import md5_bucket
from featpipe.plans import ordered
from featpipe.sources.files import scratch_path

TRAIN, VALID, TEST = "training", "validation", "test"


def stratified_split(df: DataFrame, target: str, order_by: str, train_tenths: int = 8, out: str = "split",
                     n_buckets: int | None = None) -> DataFrame:
    """``MOD(ROW_NUMBER() OVER (PARTITION BY target ORDER BY key), 10) < k`` -> training.

    ``order_by`` must be unique within a class. The row number is computed with the
    range-split window (``ordered.row_number``): a class holding half of the table is cut
    into many tasks instead of one.
    """
    ranked = ordered.row_number(df, [target], [order_by], "_fp_rn", n_buckets)
    split = F.when(F.col("_fp_rn") % 10 < train_tenths, F.lit(TRAIN)).otherwise(F.lit(VALID))
    return ranked.withColumn(out, split).drop("_fp_rn")


def hash_split(df: DataFrame, key: str | Sequence[str], weights: Sequence[int] = (8, 2), names: Sequence[str] | None = None,
               out: str = "split", method: str = "md5") -> DataFrame:
    """Deterministic split by a hash of ``key`` mod 10: the same entity always lands on one side.

    ``weights`` are tenths, e.g. (8, 2) or (7, 2, 1); ``names`` default to
    training/validation/test. ``method="md5"`` gives the same buckets as SQL engines
    (``conv(substr(md5(key), 1, 8), 16, 10)``); ``"xxhash64"`` is the cheaper JVM hash.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if len(keys) > 1:  # the keys' texts together; the separator keeps (1, 23) and (12, 3) apart
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    else:
        key = F.col(keys[0])
    if sum(weights) != 10:
        raise ValueError("weights are tenths and must sum to 10")
    names = list(names or [TRAIN, VALID, TEST][: len(weights)])
    if method == "md5":
        b = md5_bucket(key, 10)
    elif method == "xxhash64":
        b = F.pmod(F.xxhash64(key), F.lit(10))
    else:
        raise ValueError("method must be 'md5' or 'xxhash64'")
    # bucket < w0 -> names[0], < w0+w1 -> names[1], ..., else the last name
    expr = F.lit(names[-1])
    cum = []
    acc = 0
    for w in weights[:-1]:
        acc += w
        cum.append(acc)
    for edge, name in reversed(list(zip(cum, names[:-1]))):
        expr = F.when(b < F.lit(edge), F.lit(name)).otherwise(expr)
    return df.withColumn(out, expr)


def random_split_exact(df: DataFrame, key: str, val_ratio: float = 0.2, seed: int = 42, out: str = "split",
                       n_buckets: int | None = None, method: str = "xxhash64") -> DataFrame:
    """Exactly ``int(n * val_ratio)`` validation rows, chosen by a seeded hash permutation.

    The permutation is the order of ``xxhash64(key, seed)`` (ties broken by key), ranked
    with the range-split row number, so the sizes are exact without a single-task sort.
    ``n`` is a scalar subquery; nothing row-level reaches the driver. ``method="md5"`` orders by the md5 of
    ``key|seed`` instead: the same rows in any engine.
    """
    if method == "md5":
        h = df.withColumn("_fp_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    elif method == "xxhash64":
        h = df.withColumn("_fp_h", F.xxhash64(F.col(key), F.lit(seed)))
    else:
        raise ValueError("method must be 'xxhash64' or 'md5'")
    ranked = ordered.row_number(h, [], ["_fp_h", key], "_fp_rn", n_buckets)
    n_val = F.floor(df.agg(F.count("*")).scalar() * F.lit(float(val_ratio)))
    return ranked.withColumn(out, F.when(F.col("_fp_rn") <= n_val, F.lit(VALID)).otherwise(F.lit(TRAIN))) \
        .drop("_fp_h", "_fp_rn")


def random_split_approx(df: DataFrame, val_ratio: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Spark's ``randomSplit``: sizes are approximate, no shuffle at all."""
    train, val = df.randomSplit([1.0 - val_ratio, val_ratio], seed)
    return train, val


def split_tables(df: DataFrame, split_col: str = "split", names: Sequence[str] = (TRAIN, VALID, TEST)
                 ) -> dict[str, DataFrame]:
    """``_train/_val/_test`` frames from one split column (SPL4)."""
    return {n: df.where(F.col(split_col) == F.lit(n)).drop(split_col) for n in names}


def write_split_tables(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> dict[str, str]:
    """All parts in one pass: ``path/split=training``, ``path/split=validation``, ... (SPL4).

    One scan and one write instead of one filtered scan per part; each folder reads back as
    its own table, and a filter on the split column prunes to one folder."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
    return {n: f"{path}/{split_col}={n}" for n in (TRAIN, VALID, TEST)}


def training_stats(df: DataFrame, columns: Sequence[str], split_col: str = "split") -> dict:
    """AVG and sample STDDEV of ``columns`` over training rows only (SPL5), one pass.

    Returns a small dict (two numbers per column) that transforms fold in as literals.
    """
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    row = df.where(F.col(split_col) == F.lit(TRAIN)).agg(*aggs).first()
    return {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in columns}


def zscore_nullif(c: str, mean, std):
    """``(x - mean) / NULLIF(std, 0)`` with the fitted numbers as literals."""
    if mean is None or std is None or std == 0:
        return F.lit(None).cast("double")
    return (F.col(c) - F.lit(float(mean))) / F.lit(float(std))


def scaled_training_set(df: DataFrame, features: Sequence[str], target: Column | str, order_by: str,
                        strat_col: str, id_cols: Sequence[str] = (), train_tenths: int = 8,
                        rename: dict | None = None, n_buckets: int | None = None) -> DataFrame:
    """The full training-set recipe (SPL6): drop rows with NULL inputs, stratified split,
    statistics from training rows only, scaled features + target + split. The ranked rows are written once
    under the shared checkpoint folder; statistics and result read them from there."""
    cols = list(features) + [strat_col]
    clean = df.where(F.lit(True) if not cols else F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)))
    path = scratch_path(df.sparkSession, "training_set")
    stratified_split(clean, strat_col, order_by, train_tenths, "split", n_buckets).write.parquet(path)
    split = df.sparkSession.read.parquet(path)
    stats = training_stats(split, features)
    rename = rename or {}
    tgt = F.col(target) if isinstance(target, str) else target
    return split.select(
        *[F.col(c) for c in id_cols],
        *[zscore_nullif(c, *stats[c]).alias(rename.get(c, c)) for c in features],
        tgt.alias("target"),
        F.col("split"),
    )



def check_output_contract(df: DataFrame, target: str, split_col: str = "split") -> dict:
    """A training table has numeric features, the target, and ``split`` holding only
    training/validation (SPL7). Returns the findings; one aggregation pass."""
    from pyspark.sql import types as T

    problems = []
    if split_col not in df.columns:
        problems.append(f"missing '{split_col}' column")
    if target not in df.columns:
        problems.append(f"missing target '{target}'")
    feats = [f for f in df.schema.fields if f.name not in (target, split_col)]
    text = [f.name for f in feats if not isinstance(f.dataType, T.NumericType)]
    if text:
        problems.append(f"non-numeric feature columns: {text}")
    if split_col in df.columns:
        bad = df.agg(F.count_if(~F.col(split_col).isin(TRAIN, VALID) | F.col(split_col).isNull()).alias("n")).first()["n"]
        if bad:
            problems.append(f"{bad} rows with a split other than {TRAIN}/{VALID}")
    return {"ok": not problems, "problems": problems}
