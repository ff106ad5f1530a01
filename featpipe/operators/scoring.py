"""Model input binding, batch scoring and training (INP1-INP4, SCR1-SCR7, TRN1-TRN3).

Scoring is a narrow transformation: no shuffle, one pass, any table size — Spark partitions
replace the reference's 10,000-row chunks and its row-by-row prediction inserts.

* Linear and logistic models are pure column expressions (weights folded as literals).
* Dense layer stacks (Linear, ReLU, Sigmoid, Tanh, Softmax) run as an Arrow-batched
  ``mapInPandas`` with numpy; the weights are the model and have a fixed, small size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featpipe.operators.lookup import look_up

# Dtype names accepted in input specs -> Spark SQL types (unknown -> float), and
# the output names preferred when a model has several outputs.
DTYPES = {
    "float32": "float", "float": "float", "float64": "double", "double": "double",
    "int32": "int", "int": "int", "int64": "bigint", "long": "bigint", "bool": "boolean",
}

OUTPUT_PREFERENCE = ("probabilities", "probs", "probability", "prob")


class ScoringError(ValueError):
    pass


# ---------------------------------------------------------------- inputs (INP1-INP4)

def bind_inputs(df: DataFrame, inputs: dict[str, dict], out: str = "inputs") -> DataFrame:
    """Named model inputs: ``{name: {"columns": [...], "dtype": "float32"}}`` ->
    ``struct<name: array<dtype>>`` (INP1). Missing columns and empty column lists are errors."""
    fields = []
    for name, spec in inputs.items():
        cols = spec.get("columns") or []
        if not cols:
            raise ScoringError(f"input '{name}' has no columns")
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ScoringError(f"input '{name}': columns not found: {missing}")
        t = DTYPES.get(str(spec.get("dtype", "float32")).lower(), "float")
        fields.append(F.array(*[F.col(c).cast(t) for c in cols]).alias(name))
    return df.withColumn(out, F.struct(*fields))


def features_and_targets(df: DataFrame, features: Sequence[str], targets: Sequence[str] = (),
                         limit: int | None = None, sample: float | None = None, seed: int = 42,
                         order_by: Sequence[str] | None = None) -> DataFrame:
    """Select feature and target columns with checks (INP2/INP3).

    String features are rejected (encode them first); numeric ones are cast to double.
    ``sample`` keeps a fraction (a sampling feature); ``limit`` needs an order.
    """
    missing = [c for c in list(features) + list(targets) if c not in df.columns]
    if missing:
        raise ScoringError(f"columns not found: {missing}")
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    text = [c for c in features if isinstance(types[c], T.StringType)]
    if text:
        raise ScoringError(f"string feature columns {text}: label-encode or one-hot them first")
    out = df.select(*[F.col(c).cast("double").alias(c) for c in features], *targets)
    if sample is not None:
        out = out.sample(False, float(sample), seed)
    if limit is not None:
        if not order_by:
            raise ScoringError("a limit needs an order")
        out = out.orderBy(*order_by).limit(int(limit))
    return out


def shape_check(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose array does not have ``n`` elements, counted (INP4 as a data check)."""
    return df.agg(F.count_if(F.size(col) != F.lit(n)).alias("bad_rows"), F.count("*").alias("rows"))


# ---------------------------------------------------------------- linear models (SCR1)

def linear_score(weights: dict[str, float], bias: float = 0.0, link: str = "identity") -> Column:
    """``bias + sum(w * x)`` with an optional sigmoid link."""
    z = F.lit(float(bias))
    for c, w in weights.items():
        z = z + F.lit(float(w)) * F.col(c).cast("double")
    if link == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    if link != "identity":
        raise ScoringError(f"unknown link {link}")
    return z


def score_columns(df: DataFrame, outputs: dict[str, Column], prefix: str = "pred_") -> DataFrame:
    """Add one ``pred_<output>`` column per model output (SCR1/SCR3, SNK4 layout)."""
    return df.select("*", *[c.cast("double").alias(f"{prefix}{name}") for name, c in outputs.items()])


def score_frame(df: DataFrame, weights: dict[str, float], bias: float = 0.0, link: str = "identity",
                output: str = "score") -> DataFrame:
    """Score a frame with a column check (SCR3): all inputs must be numeric columns of it, and the output must be new."""
    missing = [c for c in weights if c not in df.columns]
    text = [c for c in weights if c in df.columns and not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    if missing or text:
        raise ScoringError(f"the model needs numeric columns: missing {missing}, not numeric {text}")
    if f"pred_{output}" in df.columns:
        raise ScoringError(f"pred_{output} is already a column")
    return score_columns(df, {output: linear_score(weights, bias, link)})


def choose_output(outputs: Sequence[str], name: str | None = None) -> str:
    """Named output, else the first of probabilities/probs/probability/prob, else the first (SCR4)."""
    if name:
        if name not in outputs:
            raise ScoringError(f"output '{name}' not in {list(outputs)}")
        return name
    for p in OUTPUT_PREFERENCE:
        if p in outputs:
            return p
    if not outputs:
        raise ScoringError("model has no outputs")
    return outputs[0]


# ---------------------------------------------------------------- dense graphs (SCR1, SCR2)

@dataclass
class Dense:
    """A stack of layers: ("linear", W[in,out], b[out]) | ("relu",) | ("sigmoid",) | ("tanh",)
    | ("softmax",)."""

    layers: list

    @property
    def n_out(self) -> int:
        for layer in reversed(self.layers):
            if layer[0] == "linear":
                return np.asarray(layer[2]).shape[0]
        raise ScoringError("no linear layer")

    def apply(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            kind = layer[0]
            if kind == "linear":
                x = x @ np.asarray(layer[1], dtype=np.float64) + np.asarray(layer[2], dtype=np.float64)
            elif kind == "relu":
                x = np.maximum(x, 0.0)
            elif kind == "sigmoid":
                x = 1.0 / (1.0 + np.exp(-x))
            elif kind == "tanh":
                x = np.tanh(x)
            elif kind == "softmax":
                e = np.exp(x - x.max(axis=1, keepdims=True))
                x = e / e.sum(axis=1, keepdims=True)
            else:
                raise ScoringError(f"unknown layer {kind}")
        return x


def dense_score(df: DataFrame, model: Dense, features: str, keep: Sequence[str], out: str = "scores") -> DataFrame:
    """Apply a dense model to an ``array<float>`` column, one Arrow batch at a time.

    Narrow (no shuffle): every partition scores its own rows with numpy matrix products.
    """
    import pandas as pd

    keep = list(keep)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    # the weights ship once per executor as a broadcast variable, not inside every task closure
    layers = df.sparkSession.sparkContext.broadcast(model.layers)

    def run(batches):
        local = Dense(layers.value)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[features].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
            y = local.apply(x)
            res = pdf[keep].copy()
            res[out] = pd.Series(list(y), index=pdf.index).map(list)
            yield res

    return df.select(*keep, features).mapInPandas(run, schema)


# ---------------------------------------------------------------- embeddings (SCR7)

def embedding_lookup(df: DataFrame, idx_col: str, table: DataFrame, table_idx: str, table_vec: str,
                     out: str, dim: int, limit: int | None = None) -> DataFrame:
    """Row ``idx`` of a (vocab x dim) table; an index outside the table (the unknown index
    = vocab size) gets a zero vector, the one extra row (D17), as does NULL. The table is broadcast
    only if its counted bytes fit; frequent indexes never meet in one task (``look_up``)."""
    t = table.select(F.col(table_idx).alias("_fp_i"), F.col(table_vec).alias("_fp_vec"))
    row_bytes = 8 * dim + 24
    j = look_up(df, idx_col, t, "_fp_i", t.select("_fp_i").count() * (row_bytes + 8), row_bytes, null_safe=False, limit=limit)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return j.select(*[j[c] for c in df.columns], F.coalesce("_fp_vec", zero).alias(out))


def with_numbers(vector: Column | str, columns: Sequence[str]) -> Column:
    """An embedding row followed by numeric features, as one array (SCR7)."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.concat(v.cast("array<double>"), F.array(*[F.col(c).cast("double") for c in columns]))


# ---------------------------------------------------------------- training (TRN1, TRN3)

def loss_to_estimator(loss: str, hidden: Sequence[int] | None = None):
    """Map a loss name to the MLlib estimator that fits the same task (TRN1).

    mse -> linear regression; l1 / mae / huber -> robust (Huber) linear regression;
    bce / bce_with_logits -> logistic regression; cross_entropy / nll -> multinomial logistic
    regression, or a multilayer perceptron when hidden layer sizes are given.
    """
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.regression import LinearRegression

    name = loss.lower().replace("-", "_")
    if name in ("mse", "mse_loss", "l2"):
        return LinearRegression
    if name in ("l1", "l1_loss", "mae", "huber"):
        return lambda **kw: LinearRegression(loss="huber", **kw)
    if name in ("bce", "bce_loss", "bce_with_logits", "binary_cross_entropy", "bcewithlogits"):
        return LogisticRegression
    if name in ("cross_entropy", "ce", "nll", "nll_loss"):
        if hidden:
            return MultilayerPerceptronClassifier
        return lambda **kw: LogisticRegression(family="multinomial", **kw)
    raise ScoringError(f"unknown loss {loss}")


def train(df: DataFrame, features: Sequence[str], label: str, loss: str = "bce",
          hidden: Sequence[int] | None = None, invalid: str = "error", **params):
    """Fit an MLlib model for the task the loss names; returns (model, assembler).

    Training is distributed by MLlib (tree aggregation of gradients), not a driver loop. Rows with a NULL, NaN or infinite
    feature or label never reach the optimiser: they are an error that names the columns, or left out (``invalid="skip"``)."""
    from pyspark.ml.feature import VectorAssembler

    if invalid not in ("error", "skip"):
        raise ScoringError("invalid must be 'error' or 'skip'")
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"))
    good = {c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))) for c in [*features, "label"]}
    if invalid == "error":
        bad = rows.agg(*[F.count_if(~F.coalesce(g, F.lit(False))).alias(c) for c, g in good.items()]).first().asDict()
        if any(bad.values()):
            raise ScoringError(f"rows that cannot train, by column: { {c: n for c, n in bad.items() if n} }")
    else:
        rows = rows.where(reduce(lambda a, b: a & b, good.values()))
    vec = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    data = vec.transform(rows)
    if hidden:
        n_classes = int(data.agg(F.max("label")).first()[0]) + 1
        params["layers"] = [len(features), *hidden, n_classes]
    est = loss_to_estimator(loss, hidden)(featuresCol="features", labelCol="label", **params)
    return est.fit(data), vec


def pretraining_checks(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows, NULL / NaN / Inf per feature and distinct targets in one pass (TRN3)."""
    aggs = [F.count("*").alias("rows"), F.count_distinct(target).alias("target_distinct"),
            F.count_if(F.col(target).isNull()).alias("target_nulls")]
    for c in features:
        x = F.col(c).cast("double")
        aggs += [F.count_if(x.isNull()).alias(f"{c}_nulls"), F.count_if(F.isnan(x)).alias(f"{c}_nan"),
                 F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"{c}_inf")]
    return df.agg(*aggs)
