"""Model graphs with several inputs and outputs, scored in Arrow batches (SCR1, SCR2, SCR4, SCR7).

A graph is a set of named nodes; each has an operation, the names of its inputs (graph inputs or other nodes) and its weights. Nodes run
in topological order on whole batches; only those that a wanted output needs run at all. Scoring is narrow: no shuffle, one pass, every
partition on its own. Weights travel as one broadcast of checked size; embedding tables beyond that are joined (``scoring.embedding_lookup``).
"""

from __future__ import annotations

import graphlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featpipe.operators.scoring import Dense, ScoringError, choose_output

LARGEST = 512 << 20  # bytes of weights that are broadcast


def _embedding(x, w):
    """Rows of the table; an index outside it (NULL too) gets the extra zero row."""
    i = np.where(np.isfinite(x[:, 0]), x[:, 0], -1).astype(np.int64)
    known = (i >= 0) & (i < len(w["table"]))
    return np.where(known[:, None], w["table"][np.where(known, i, 0)], 0.0)


def _softmax(x):
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _normal(x, w):
    mean, spread = x.mean(1, keepdims=True), x.var(1, keepdims=True)
    return (x - mean) / np.sqrt(spread + w.get("eps", 1e-5)) * w.get("scale", 1.0) + w.get("shift", 0.0)


# operation -> (number of inputs, None: two or more; function of the inputs and the weights)
OPERATIONS = {
    "linear": (1, lambda x, w: x[0] @ w["weight"] + w.get("bias", 0.0)),
    "relu": (1, lambda x, w: np.maximum(x[0], 0.0)),
    "leaky_relu": (1, lambda x, w: np.where(x[0] > 0, x[0], w.get("slope", 0.01) * x[0])),
    "sigmoid": (1, lambda x, w: 1.0 / (1.0 + np.exp(-x[0]))),
    "tanh": (1, lambda x, w: np.tanh(x[0])),
    "softmax": (1, lambda x, w: _softmax(x[0])),
    "embedding": (1, lambda x, w: _embedding(x[0], w)),
    "layer_norm": (1, lambda x, w: _normal(x[0], w)),
    "batch_norm": (1, lambda x, w: (x[0] - w["mean"]) / np.sqrt(w["var"] + w.get("eps", 1e-5)) * w.get("scale", 1.0) + w.get("shift", 0.0)),
    "identity": (1, lambda x, w: x[0]),  # dropout and the like, when scoring
    "slice": (1, lambda x, w: x[0][:, w["start"] : w["end"]]),
    "mean": (1, lambda x, w: x[0].mean(1, keepdims=True)),
    "concat": (None, lambda x, w: np.concatenate(x, 1)),
    "add": (None, lambda x, w: sum(x[1:], x[0])),
    "multiply": (None, lambda x, w: np.prod(np.broadcast_arrays(*x), 0)),
}


@dataclass
class Node:
    op: str
    inputs: list[str]
    weights: dict = field(default_factory=dict)


@dataclass
class Graph:
    """``inputs``: name -> number of values; ``outputs``: name -> node."""

    inputs: dict[str, int]
    nodes: dict[str, Node]
    outputs: dict[str, str]

    def __post_init__(self):
        for name, node in self.nodes.items():
            if node.op not in OPERATIONS:
                raise ScoringError(f"node '{name}': unknown operation {node.op}")
            n = OPERATIONS[node.op][0]
            if (n or 2) > len(node.inputs) or (n and len(node.inputs) > n):
                raise ScoringError(f"node '{name}': {node.op} takes {n or 'two or more'} inputs, not {len(node.inputs)}")
            missing = [i for i in node.inputs if i not in self.nodes and i not in self.inputs]
            if missing:
                raise ScoringError(f"node '{name}' reads {missing}, which are no nodes or inputs")
            if name in self.inputs:
                raise ScoringError(f"'{name}' is an input and a node")
            node.weights = {k: np.asarray(v, np.float64) if isinstance(v, (list, np.ndarray)) else v for k, v in node.weights.items()}
        for name, of in self.outputs.items():
            if of not in self.nodes and of not in self.inputs:
                raise ScoringError(f"output '{name}' names {of}, which is no node")
        if not self.outputs:
            raise ScoringError("model has no outputs")
        try:
            self.order = list(graphlib.TopologicalSorter({k: n.inputs for k, n in self.nodes.items()}).static_order())
        except graphlib.CycleError as e:
            raise ScoringError("the graph has a cycle: " + " -> ".join(reversed(e.args[1]))) from e

    @classmethod
    def from_dense(cls, model: Dense, n_inputs: int, output: str = "output") -> Graph:
        nodes, last = {}, "x"
        for k, layer in enumerate(model.layers):
            weights = {"weight": layer[1], "bias": layer[2]} if layer[0] == "linear" else {}
            nodes[f"layer{k}"] = Node(layer[0], [last], weights)
            last = f"layer{k}"
        return cls({"x": n_inputs}, nodes, {output: last})

    def needed(self, outputs: Sequence[str]) -> set[str]:
        """Nodes and inputs that the outputs depend on."""
        found, todo = set(), [self.outputs[o] for o in outputs]
        while todo:
            k = todo.pop()
            if k not in found:
                found.add(k)
                todo += self.nodes[k].inputs if k in self.nodes else []
        return found

    def apply(self, values: dict[str, np.ndarray], outputs: Sequence[str] | None = None) -> dict[str, np.ndarray]:
        """Outputs (rows, width) of the named inputs (rows, width)."""
        outputs = list(outputs or self.outputs)
        need, values = self.needed(outputs), dict(values)
        for k in self.order:
            if k in need and k in self.nodes:
                node = self.nodes[k]
                try:
                    values[k] = OPERATIONS[node.op][1]([values[i] for i in node.inputs], node.weights)
                except ValueError as e:
                    shapes = [values[i].shape[1] for i in node.inputs]
                    raise ScoringError(f"node '{k}' ({node.op}) does not fit inputs of widths {shapes}: {e}") from e
        return {o: values[self.outputs[o]] for o in outputs}

    def size(self) -> int:
        return sum(v.nbytes for n in self.nodes.values() for v in n.weights.values() if isinstance(v, np.ndarray))


def _filled(x: Column, lost: float) -> Column:
    return F.transform(x, lambda v: F.coalesce(v, F.lit(lost)))


def score_graph(df: DataFrame, graph: Graph, inputs: dict[str, str | list[str]], keep: Sequence[str], outputs: Sequence[str] | str | None = None,
                prefix: str = "pred_") -> DataFrame:
    """``keep`` and one ``pred_<output>`` column per output: a double where it has one value, else an array.

    ``inputs``: for each graph input an array column, or a list of columns. ``outputs``: the wanted ones (all by default, or one by
    ``choose_output`` where a string is given, "" for the preferred one). Missing numbers count as 0, missing embedding indexes as unknown;
    an array of another length than its input is an error. Rows stay rows, an empty table gives an empty table.
    """
    wanted = [choose_output(list(graph.outputs), outputs or None)] if isinstance(outputs, str) else list(outputs or graph.outputs)
    unknown = [o for o in wanted if o not in graph.outputs]
    if unknown:
        raise ScoringError(f"outputs {unknown} not in {list(graph.outputs)}")
    need = graph.needed(wanted)
    used = [k for k in graph.inputs if k in need]
    unbound = [k for k in used if k not in inputs]
    if unbound:
        raise ScoringError(f"inputs {unbound} are bound to no columns")
    if graph.size() > LARGEST:
        raise ScoringError(f"{graph.size()} bytes of weights are too many to broadcast; join large embedding tables by embedding_lookup")
    taken = [f"{prefix}{o}" for o in wanted if f"{prefix}{o}" in keep]
    if taken:
        raise ScoringError(f"{taken} are already columns")
    indexes = {n.inputs[0] for n in graph.nodes.values() if n.op == "embedding"}
    bound = []
    for k, name in enumerate(used):
        of, lost = inputs[name], float("nan") if name in indexes else 0.0
        missing = [c for c in ([of] if isinstance(of, str) else of) if c not in df.columns]
        if missing:
            raise ScoringError(f"input '{name}': columns not found: {missing}")
        x = F.col(f"`{of}`").cast("array<double>") if isinstance(of, str) else F.array(*[F.col(f"`{c}`").cast("double") for c in of])
        bound.append(_filled(x, lost).alias(f"_fp_in{k}"))
    widths = {o: v.shape[1] for o, v in graph.apply({k: np.zeros((1, graph.inputs[k])) for k in used}, wanted).items()}
    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    for o in wanted:
        schema = schema.add(f"{prefix}{o}", T.DoubleType() if widths[o] == 1 else T.ArrayType(T.DoubleType()))
    sent = df.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        g = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            values = {}
            for k, name in enumerate(used):
                column, n = b.column(f"_fp_in{k}"), g.inputs[name]
                if column.null_count or (np.diff(column.offsets.to_numpy()) != n).any():
                    raise ScoringError(f"input '{name}' takes {n} values in every row")
                values[name] = column.flatten().to_numpy().reshape(-1, n)
            found = g.apply(values, wanted)
            made = [pa.array(np.ascontiguousarray(v[:, 0])) if widths[o] == 1 else pa.ListArray.from_arrays(
                np.arange(0, v.size + 1, widths[o], dtype=np.int32), np.ascontiguousarray(v, np.float64).ravel()) for o, v in found.items()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in range(len(keep))], *made], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], *bound).mapInArrow(run, schema)
