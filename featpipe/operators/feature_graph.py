"""Spec-driven feature pipelines with fitted state (FEA0, FEA2, FEA18, FEA19, FEA21, FEA22).

A spec is an ordered list of operators. Names live in three namespaces:

* ``tensors.<name>`` — a column of the DataFrame (scalar or array);
* ``vars.<name>``    — a Python scalar (e.g. the number of features);
* ``states.<name>``  — fitted state: a dict of numbers or a ``Vocabulary``.

Training mode runs everything; prediction mode skips ``fit.*``, ``inspect.*`` and operators
marked ``train_only`` and requires the saved states. All ``fit.standard_scaler`` statistics of
one array are computed in one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featpipe.functions.hashing import hash_bucket
from featpipe.operators import features as FE


class PipelineError(ValueError):
    pass


NAMESPACES = ("tensors", "vars", "states")


def _ns(name: str) -> tuple[str, str]:
    """Namespace and key of a global name; the key may itself hold dots."""
    space, dot, key = str(name).partition(".")
    if not dot or not key or space not in NAMESPACES:
        raise PipelineError(f"{name!r} is no global name: it must start with one of {', '.join(n + '.' for n in NAMESPACES)}")
    return space, key


def _as_ops(spec: dict) -> tuple[list[dict], list[str], list[str]]:
    """The spec's operators in one shape, its output names and its target columns.

    Two shapes are read: ``ops`` with one ``output`` each and a list of ``outputs``; or ``processors`` whose
    ``outputs`` map global names to the operator's own result names, beside ``feature_columns`` and
    ``target_columns``, which processors may name as inputs. All tensors are then outputs.
    """
    if spec.get("ops"):
        return list(spec["ops"]), list(spec.get("outputs") or []), list(spec.get("target_columns") or [])
    steps = spec.get("processors")
    if not steps:
        raise PipelineError("the feature spec has neither 'ops' nor 'processors'")
    lists = {k: list(spec.get(k) or []) for k in ("feature_columns", "target_columns")}
    ops, outputs = [], []
    for i, step in enumerate(steps):
        label = step.get("name") or step.get("op") or f"number {i + 1}"
        if step.get("op") not in REGISTRY:
            raise PipelineError(f"processor {label}: {step.get('op')!r} is no known operator")
        made = step.get("outputs") or {}
        if not made:
            raise PipelineError(f"processor {label}: it has no outputs")
        for name, source in made.items():
            if source != RESULT[step["op"].split(".")[0]] :
                raise PipelineError(f"processor {label}: {step['op']} has no result named {source!r}")
            inputs = {k: lists[v] if isinstance(v, str) and v in lists else v for k, v in (step.get("inputs") or {}).items()}
            ops.append({"op": step["op"], "inputs": inputs, "output": name, "train_only": bool(step.get("train_only"))})
            if name.startswith("tensors.") and name not in outputs:
                outputs.append(name)
    return ops, outputs, lists["target_columns"]


# fixed values: result names of the operators, by kind
RESULT = {"transform": "output", "fit": "state", "inspect": "n_features"}


class FeaturePipeline:
    """Runs a feature spec on a DataFrame (FEA0)."""

    def __init__(self, spec: dict):
        self.spec = spec
        self.ops, self.outputs, self.targets = _as_ops(spec)
        for op in self.ops:
            if op.get("op") not in REGISTRY:
                raise PipelineError(f"{op.get('op')!r} is no known operator")
            _ns(op["output"])

    def run(self, df: DataFrame, training: bool = True, states: dict | None = None,
            keep: Sequence[str] = ()) -> tuple[DataFrame, dict, dict]:
        """``df``'s kept and target columns with the output tensors, the states and the vars."""
        states = dict(states or {})
        vars_: dict = {}
        widths: dict[str, int] = {}
        keep = [*keep, *(c for c in self.targets if c not in keep)]
        needed = set(keep)
        for op in self.ops:
            for v in (op.get("inputs") or {}).values():
                for item in (v if isinstance(v, list) else [v]):
                    if isinstance(item, str) and not item.startswith(("tensors.", "vars.", "states.")) and item in df.columns:
                        needed.add(item)
            for item in _columns_read(op):
                needed.add(item)
        missing = [c for c in needed if c not in df.columns]
        if missing:
            raise PipelineError(f"columns not found: {sorted(missing)}")
        cur = df.select(*[c for c in df.columns if c in needed])  # prune to what the spec reads
        prefit: dict[int, dict] = {}
        for pos, op in enumerate(self.ops):
            name = op["op"]
            if not training and (name.startswith(("fit.", "inspect.")) or op.get("train_only")):
                continue
            ns, key = _ns(op["output"])
            ctx = {"states": states, "vars": vars_, "widths": widths}
            if name == "fit.standard_scaler" and training:
                if pos not in prefit:
                    prefit.update(_fit_standard_batch(cur, self.ops, pos, ctx))
                result = prefit[pos]
            else:
                result = REGISTRY[name](cur, op.get("inputs") or {}, key, ctx)
            if ns == "tensors":
                cur = result
            elif ns == "states":
                states[key] = result
            else:
                vars_[key] = result
        outs = [_ns(o)[1] for o in self.outputs]
        cols = list(keep) + [o for o in outs if o not in keep and o in cur.columns]
        return cur.select(*cols), states, vars_


def _columns_read(op: dict) -> list[str]:
    """Raw columns an operator names as its data input."""
    found = []
    for k in ("x", "tensor", "columns"):
        v = (op.get("inputs") or {}).get(k)
        for item in v if isinstance(v, list) else [v]:
            if isinstance(item, str) and not item.startswith(("tensors.", "vars.", "states.")):
                found.append(item)
    return found


def _tensor(ref):
    if isinstance(ref, str) and ref.startswith("tensors."):
        return ref.split(".", 1)[1]
    return ref


def _state(ref, ctx):
    if not isinstance(ref, str) or not ref.startswith("states."):
        raise PipelineError(f"expected a states.* reference, got {ref!r}")
    k = ref.split(".", 1)[1]
    if k not in ctx["states"]:
        raise PipelineError(f"state '{k}' is missing (prediction needs the saved states)")
    return ctx["states"][k]


def _assemble(df, inputs, out, ctx):
    cols = [_tensor(c) for c in inputs.get("columns") or []]
    if not cols:
        raise PipelineError("assemble_vector: name at least one column")
    ctx["widths"][out] = len(cols)
    return df.withColumn(out, FE.assemble_vector(cols))


def _width(df, col, ctx) -> int:
    if col in ctx["widths"]:
        return ctx["widths"][col]
    if isinstance(df.schema[col].dataType, T.ArrayType):
        row = df.agg(F.max(F.size(col)).alias("a"), F.min(F.size(col)).alias("b")).first()
        if row["a"] != row["b"]:
            raise PipelineError(f"{col}: rows have different lengths ({row['b']}..{row['a']}); 2-D input required")
        return int(row["a"] or 0)
    return 1


def _feature_stats(df, inputs, out, ctx):
    x = _tensor(inputs.get("tensor"))
    if not isinstance(df.schema[x].dataType, T.ArrayType):
        raise PipelineError(f"feature_stats: {x} is no array column")
    return _width(df, x, ctx)


def _fit_standard(df, inputs, out, ctx):
    x = _tensor(inputs.get("x"))
    if isinstance(df.schema[x].dataType, T.ArrayType):
        n = _width(df, x, ctx)
        aggs = []
        for i in range(n):
            e = F.col(x)[i].cast("double")
            aggs += [F.avg(e).alias(f"m{i}"), F.stddev_samp(e).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        mean = [row[f"m{i}"] for i in range(n)]
        std = [row[f"s{i}"] for i in range(n)]
    else:
        row = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
        mean, std = [row["m"]], [row["s"]]
    std = [1.0 if (s is None or (isinstance(s, float) and math.isnan(s)) or s == 0) else s for s in std]
    return {"kind": "standard_vector", "mean": mean, "std": std}


def _fit_standard_batch(df, ops, start, ctx) -> dict[int, dict]:
    """All ``fit.standard_scaler`` ops from ``start`` on whose input already exists and is not written again before
    them, fitted in one aggregation (one pass for all fits of a level)."""
    todo, written = [], set()
    for i, op in enumerate(ops[start:], start):
        x = _tensor((op.get("inputs") or {}).get("x"))
        if op["op"] == "fit.standard_scaler" and (i == start or (x in df.columns and x not in written)):
            todo.append((i, x))
        space, key = _ns(op["output"])
        if space == "tensors":
            written.add(key)
    aggs, layout = [], {}
    for i, x in todo:
        if isinstance(df.schema[x].dataType, T.ArrayType):
            n = _width(df, x, ctx)
            elems = [F.col(x)[j].cast("double") for j in range(n)]
        else:
            elems = [F.col(x).cast("double")]
        layout[i] = len(elems)
        for j, e in enumerate(elems):
            aggs += [F.avg(e).alias(f"m{i}_{j}"), F.stddev_samp(e).alias(f"s{i}_{j}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, n in layout.items():
        mean = [row[f"m{i}_{j}"] for j in range(n)]
        std = [row[f"s{i}_{j}"] for j in range(n)]
        std = [1.0 if (v is None or (isinstance(v, float) and math.isnan(v)) or v == 0) else v for v in std]
        out[i] = {"kind": "standard_vector", "mean": mean, "std": std}
    return out


def _transform_standard(df, inputs, out, ctx):
    x = _tensor(inputs.get("x"))
    st = _state(inputs.get("state"), ctx)
    if "mean" not in st or "std" not in st:
        raise PipelineError(f"standard_scaler: the state {inputs.get('state')!r} holds no means and deviations")
    if isinstance(df.schema[x].dataType, T.ArrayType):
        elems = [(F.col(x)[i].cast("double") - F.lit(float(m))) / F.lit(float(s))
                 for i, (m, s) in enumerate(zip(st["mean"], st["std"]))]
        ctx["widths"][out] = len(elems)
        return df.withColumn(out, F.array(*elems))
    return df.withColumn(out, (F.col(x).cast("double") - F.lit(float(st["mean"][0]))) / F.lit(float(st["std"][0])))


def _fit_label(df, inputs, out, ctx):
    return FE.fit_label_encoder(df, _tensor(inputs.get("x")))


def _transform_label(df, inputs, out, ctx):
    st = _state(inputs.get("state"), ctx)
    return FE.label_encode(df, _tensor(inputs.get("x")), st, out=out,
                           handle_unknown=inputs.get("handle_unknown", "use_unknown_value"),
                           unknown_value=inputs.get("unknown_value"))


def _hash_bucket(df, inputs, out, ctx):
    x = _tensor(inputs.get("x"))
    n = int(inputs.get("num_buckets", 1000))
    return df.withColumn(out, hash_bucket(x, n, df.schema[x].dataType, inputs.get("method", "xxhash64")))


def _hash_pad(df, inputs, out, ctx):
    x = _tensor(inputs.get("x"))
    et = df.schema[x].dataType
    numeric = isinstance(et, T.ArrayType) and isinstance(et.elementType, T.NumericType)
    return df.withColumn(out, FE.hash_and_pad(x, int(inputs.get("num_buckets", 1000)),
                                              int(inputs.get("max_length", 0)), int(inputs.get("fill_value", 0)),
                                              numeric, inputs.get("method", "xxhash64")))


def _shift(df, inputs, out, ctx):
    return df.withColumn(out, FE.sequence_shift(_tensor(inputs.get("x")), inputs.get("direction", "left"),
                                                inputs.get("fill_value", 0)))


# operator registry (FEA18). The operator names and the processor aliases.
REGISTRY = {
    "transform.assemble_vector": _assemble,
    "inspect.feature_stats": _feature_stats,
    "fit.standard_scaler": _fit_standard,
    "transform.standard_scaler": _transform_standard,
    "fit.label_encoder": _fit_label,
    "transform.label_encode": _transform_label,
    "transform.hash_bucket": _hash_bucket,
    "transform.hash_and_pad": _hash_pad,
    "transform.sequence_shift": _shift,
}
ALIASES = {
    "StandardNormalization": "standard", "ZScore": "standard", "Standardization": "standard",
    "MinMaxNormalization": "minmax", "Normalization": "minmax", "RobustNormalization": "robust",
    "CategoricalEncoding": "onehot", "OneHot": "onehot",
}


# ---------------------------------------------------------------- processors in order (FEA21)

def fit_processors(df: DataFrame, steps: Sequence[tuple[str, Sequence[str], dict]]) -> list[dict]:
    """Fit ``[(kind or alias, columns, params)]`` in order; each fit sees the previous output. One-hot columns with more than
    ``max_categories`` (1000) categories become one sparse vector; with ``sparse`` false they are an error."""
    states = []
    cur = df
    for kind, cols, params in steps:
        k = ALIASES.get(kind, kind)
        if k == "standard":
            st = FE.fit_standard_scaler(cur, cols, eps=params.get("eps", FE.EPS))
        elif k == "minmax":
            st = FE.fit_minmax(cur, cols, tuple(params.get("feature_range", (0.0, 1.0))))
        elif k == "robust":
            st = FE.fit_robust(cur, cols)
        elif k == "onehot":
            st = {"kind": "onehot", "columns": list(cols),
                  "params": FE.fit_categories_many(cur, cols, params.get("max_categories", 1000), params.get("sparse", True)),
                  "handle_unknown": params.get("handle_unknown", "ignore")}
        else:
            raise PipelineError(f"unknown processor {kind}")
        states.append(st)
        cur = apply_processor(cur, st)
    return states


def apply_processor(df: DataFrame, st: dict) -> DataFrame:
    k = st["kind"]
    if k == "onehot":
        for c in st["columns"]:
            known = st["params"][c]
            unknown = st.get("handle_unknown", "ignore")
            df = FE.one_hot_sparse(df, c, known, handle_unknown=unknown) if isinstance(known, FE.Vocabulary) else FE.one_hot(
                df, c, known, unknown)
        return df
    fn = {"standard": FE.standard_scale, "minmax": FE.minmax_scale, "robust": FE.robust_scale}[k]
    return df.withColumns({c: fn(st, c) for c in st["columns"]})


def apply_processors(df: DataFrame, states: Sequence[dict]) -> DataFrame:
    for st in states:
        df = df.transform(lambda d, s=st: apply_processor(d, s))
    return df


# ---------------------------------------------------------------- state round trip (FEA19)

_LEAF = "path array<string>, whole long, number double, text string, flag boolean"


def _leaves(value, path=()):
    """A nested state as typed rows: keys as ``k:name``, list places as ``i:number``; NULLs for what a leaf is not."""
    if isinstance(value, dict):
        if not value:
            yield (list(path) + ["{}"], None, None, None, None)
        for k, v in value.items():
            yield from _leaves(v, (*path, f"k:{k}"))
    elif isinstance(value, (list, tuple)):
        if not value:
            yield (list(path) + ["[]"], None, None, None, None)
        for i, v in enumerate(value):
            yield from _leaves(v, (*path, f"i:{i}"))
    elif isinstance(value, bool):
        yield (list(path), None, None, None, value)
    elif isinstance(value, int):
        yield (list(path), value, None, None, None)
    elif value is None or isinstance(value, float):
        yield (list(path), None, value, None, None)
    else:
        yield (list(path), None, None, str(value), None)


def _nested(rows):
    """The state that ``_leaves`` took apart."""
    if len(rows) == 1 and not rows[0][0]:
        return next((v for v in rows[0][1:] if v is not None), None)
    if rows[0][0][0] in ("{}", "[]"):
        return {} if rows[0][0][0] == "{}" else []
    parts: dict[str, list] = {}
    for r in rows:
        parts.setdefault(r[0][0], []).append((r[0][1:], *r[1:]))
    if rows[0][0][0].startswith("i:"):
        return [_nested(parts[k]) for k in sorted(parts, key=lambda k: int(k[2:]))]
    return {k[2:]: _nested(v) for k, v in parts.items()}


def save_numeric_state(spark, state: dict, path: str) -> None:
    """A state of numbers and names as typed parquet rows, one per leaf."""
    spark.createDataFrame([(state["kind"], *r) for r in _leaves(state)], f"kind string, {_LEAF}").coalesce(1).write.mode(
        "overwrite").parquet(path)


def load_numeric_state(spark, path: str, kind: str) -> dict:
    rows = spark.read.parquet(path).collect()  # one row per fitted number
    if not rows:
        raise PipelineError(f"no state at {path}")
    if rows[0]["kind"] != kind:
        raise PipelineError(f"{path} holds a state of kind {rows[0]['kind']}, not {kind}")
    return _nested([tuple(r)[1:] for r in rows])


def save_states(spark, states: dict, path: str) -> None:
    """Every state of a pipeline under one folder: ``index`` names them and their form, each has its own typed table."""
    index = []
    for i, (name, st) in enumerate(sorted(states.items())):
        own = f"{path}/state_{i}"
        if isinstance(st, FE.Vocabulary):
            FE.save_vocabulary(st, own)
            index.append((name, "vocabulary", f"state_{i}", st.column))
        elif isinstance(st, FE.TargetEncoding):
            FE.save_target_encoding(st, own)
            index.append((name, "target_encoding", f"state_{i}", st.column))
        else:
            save_numeric_state(spark, {"kind": "", **st} if "kind" not in st else st, own)
            index.append((name, "numbers", f"state_{i}", st.get("kind", "")))
    spark.createDataFrame(index, "name string, form string, place string, detail string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/index")


def load_states(spark, path: str) -> dict:
    """The states that ``save_states`` wrote, by name."""
    out = {}
    for r in spark.read.parquet(f"{path}/index").collect():
        own = f"{path}/{r['place']}"
        out[r["name"]] = FE.load_vocabulary(spark, own, r["detail"]) if r["form"] == "vocabulary" else FE.load_target_encoding(
            spark, own) if r["form"] == "target_encoding" else load_numeric_state(spark, own, r["detail"])
    return out
