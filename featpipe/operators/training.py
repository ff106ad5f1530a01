"""Training by epochs: gradients summed over the cluster, weights on the driver, one state row saved an epoch (TRN1, TRN2).

The training rows are written once, packed, and dealt into ``batches`` folders; a step reads one folder, every task sums its rows'
gradients and losses with numpy, and Spark adds the tasks' sums (as many numbers as the model has parameters). With one batch an epoch is
one step over all rows, and the pass that scores the validation rows after a step is also the next step's gradient pass: n epochs take
n + 1 passes. After each epoch the weights, the optimiser's state and the losses are saved to ``run_dir``; a run that starts there again
goes on behind the last saved epoch.

Models are dense stacks (no hidden layer: linear, logistic and multinomial regression) and come out as ``scoring.Dense``.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featpipe.operators.scoring import Dense, ScoringError
from featpipe.session import checkpoint_root

# fixed values: loss names and their aliases
LOSSES = {"mse": "mse", "mse_loss": "mse", "l2": "mse", "l1": "mae", "l1_loss": "mae", "mae": "mae", "huber": "huber", "smooth_l1": "huber",
          "bce": "bce", "bce_loss": "bce", "bce_with_logits": "bce", "binary_cross_entropy": "bce", "bcewithlogits": "bce",
          "cross_entropy": "cross_entropy", "ce": "cross_entropy", "nll": "cross_entropy", "nll_loss": "cross_entropy"}
STATE = ("epoch int, train_loss double, val_loss double, steps long, waited int, best_epoch int, best_loss double, params array<double>, "
         "best array<double>, slots array<double>, settings string")


def loss_and_slope(loss: str, z: np.ndarray, y: np.ndarray, pos_weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its derivative by the outputs ``z`` (rows, outputs)."""
    if loss == "cross_entropy":
        top = z.max(1, keepdims=True)
        e = np.exp(z - top)
        total, at = e.sum(1), (np.arange(len(y)), y.astype(np.int64))
        slope = e / total[:, None]
        slope[at] -= 1.0
        return np.log(total) + top[:, 0] - z[at], slope
    z, off = z[:, 0], z[:, 0] - y
    if loss == "mse":
        each, slope = off * off, 2.0 * off
    elif loss == "mae":
        each, slope = np.abs(off), np.sign(off)
    elif loss == "huber":
        each, slope = np.where(np.abs(off) < 1, 0.5 * off * off, np.abs(off) - 0.5), np.clip(off, -1.0, 1.0)
    else:  # bce on logits
        weight = np.where(y > 0, pos_weight, 1.0)
        each = weight * (np.maximum(z, 0.0) - z * y + np.log1p(np.exp(-np.abs(z))))
        slope = weight * (1.0 / (1.0 + np.exp(-z)) - y)
    return each, slope[:, None]


@dataclass
class Stack:
    """Sizes of a dense stack (inputs, hidden ..., outputs) whose parameters lie in one vector, layer by layer: weights, then biases."""

    sizes: tuple[int, ...]
    activation: str = "relu"

    @property
    def n_params(self) -> int:
        return sum((a + 1) * b for a, b in zip(self.sizes[:-1], self.sizes[1:], strict=True))

    def layers(self, params: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes[:-1], self.sizes[1:], strict=True):
            out.append((params[at : at + a * b].reshape(a, b), params[at + a * b : at + (a + 1) * b]))
            at += (a + 1) * b
        return out

    def start(self, seed: int) -> np.ndarray:
        """Zeros without hidden layers, else uniform weights by the layer's inputs."""
        if len(self.sizes) == 2:
            return np.zeros(self.n_params)
        r = np.random.default_rng(seed)
        return np.concatenate([np.concatenate([r.uniform(-1, 1, a * b) * np.sqrt(6.0 / a), np.zeros(b)])
                               for a, b in zip(self.sizes[:-1], self.sizes[1:], strict=True)])

    def sums(self, params: np.ndarray, loss: str, x: np.ndarray, y: np.ndarray, pos_weight: float, slopes: bool) -> tuple[np.ndarray, float]:
        """Gradient and loss summed over rows."""
        layers, seen = self.layers(params), [x]
        for k, (w, b) in enumerate(layers):
            z = seen[-1] @ w + b
            if k + 1 < len(layers):
                z = np.maximum(z, 0.0) if self.activation == "relu" else np.tanh(z)
            seen.append(z)
        each, slope = loss_and_slope(loss, seen[-1], y, pos_weight)
        if not slopes:
            return np.zeros(0), float(each.sum())
        grads = []
        for k in range(len(layers) - 1, -1, -1):
            grads.append(np.concatenate([(seen[k].T @ slope).ravel(), slope.sum(0)]))
            if k:
                slope = slope @ layers[k][0].T
                slope = slope * (seen[k] > 0 if self.activation == "relu" else 1.0 - seen[k] ** 2)
        return np.concatenate(grads[::-1]), float(each.sum())


@dataclass
class Optimizer:
    """Plain or momentum gradient descent, or Adam; its memory lies in one vector."""

    kind: str = "sgd"
    rate: float = 0.1
    momentum: float = 0.0
    betas: tuple[float, float] = (0.9, 0.999)
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: int = 0

    def step(self, params: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.steps += 1
        if self.kind == "adam":
            if not len(self.slots):
                self.slots = np.zeros(2 * len(params))
            m, v = np.split(self.slots, 2)
            m, v = self.betas[0] * m + (1 - self.betas[0]) * slope, self.betas[1] * v + (1 - self.betas[1]) * slope**2
            self.slots = np.concatenate([m, v])
            return params - self.rate * (m / (1 - self.betas[0] ** self.steps)) / (np.sqrt(v / (1 - self.betas[1] ** self.steps)) + 1e-8)
        if self.momentum:
            self.slots = slope + self.momentum * (self.slots if len(self.slots) else np.zeros(len(params)))
            slope = self.slots
        return params - self.rate * slope


@dataclass
class Trained:
    model: Dense
    history: DataFrame  # epoch, train_loss, val_loss, params: one row an epoch, read from the run's folder
    best_epoch: int
    epochs: int
    stopped_early: bool


def _prepare(df: DataFrame, features: Sequence[str], label: str, validation, batches: int, invalid: str, seed: int) -> DataFrame:
    """Rows packed as (part: batch, -1 for validation rows; y; x), written to the shared folder."""
    x = [F.col(f"`{c}`").cast("double").alias(f"f{k}") for k, c in enumerate(features)]
    rows = df.select(*x, F.col(f"`{label}`").cast("double").alias("y"), F.coalesce(validation, F.lit(False)).alias("v"))
    names = [f"f{k}" for k in range(len(features))]
    good = F.forall(F.array(*names, "y"), lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    good = F.coalesce(good, F.lit(False))
    if invalid == "error":
        bad = rows.where(~good).count()
        if bad:
            raise ScoringError(f"{bad} rows have a feature or a label that is NULL or not finite")
    # the batch of a row follows from its values: dealing again after a lost task gives the same batch
    part = F.when(F.col("v"), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.lit(seed), *names, "y"), F.lit(batches)).cast("int"))
    path = f"{checkpoint_root(df.sparkSession)}/training-{uuid.uuid4().hex}"
    rows.where(good).select(part.alias("part"), "y", F.array(*names).alias("x")).write.partitionBy("part").parquet(path)
    return df.sparkSession.read.schema("y double, x array<double>, part int").parquet(path)


def _sums(rows: DataFrame, stack: Stack, params: np.ndarray, loss: str, pos_weight: float, slopes: bool) -> dict:
    """One pass: gradient and loss of the training rows, loss of the validation rows, and both counts."""
    sent = rows.sparkSession.sparkContext.broadcast(params)
    n, width = stack.n_params, stack.sizes[0]

    def run(batches):
        total = np.zeros(n + 4)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(-1, width)
            y, held = b.column("y").to_numpy(), b.column("part").to_numpy() < 0
            if (~held).any():
                grad, cost = stack.sums(sent.value, loss, x[~held], y[~held], pos_weight, slopes)
                total[: len(grad)] += grad
                total[n] += cost
            if held.any():
                total[n + 2] += stack.sums(sent.value, loss, x[held], y[held], pos_weight, False)[1]
            total[n + 1] += (~held).sum()
            total[n + 3] += held.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 4, dtype=np.int32)), pa.array(total)], ["k", "value"])

    total = np.zeros(n + 4)
    for r in rows.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).collect():
        total[r.k] = r.value
    sent.unpersist()
    return {"slope": total[:n], "loss": total[n], "n": total[n + 1], "val_loss": total[n + 2], "val_n": total[n + 3]}


def _saved(spark: SparkSession, run_dir: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(STATE).parquet(run_dir) if fs.exists(path) else None


def fit_epochs(df: DataFrame, features: Sequence[str], label: str, loss: str = "bce", validation=None, epochs: int = 10,
               learning_rate: float = 0.1, optimizer: str = "sgd", momentum: float = 0.0, batches: int = 1, hidden: Sequence[int] = (),
               activation: str = "relu", classes: int | None = None, pos_weight: float = 1.0, l2: float = 0.0, patience: int | None = None,
               min_delta: float = 0.0, seed: int = 42, invalid: str = "error", run_dir: str | None = None) -> Trained:
    """Train by gradient descent, ``batches`` steps an epoch, and report the mean loss of training and validation rows per epoch.

    ``validation``: a boolean Column; its rows are never trained on. ``train_loss`` is the mean over an epoch's rows at the weights
    before each step; ``val_loss`` at the weights after the epoch (NULL without validation rows). ``patience``: training stops when the
    validation loss (else the training loss) has not fallen by more than ``min_delta`` for so many epochs, and the best epoch's weights are
    returned. ``run_dir``: where epochs are saved; a folder with saved epochs of the same settings is resumed, of others refused.
    """
    spark, name = df.sparkSession, LOSSES.get(loss.lower().replace("-", "_"))
    if name is None:
        raise ScoringError(f"unknown loss {loss}")
    if optimizer not in ("sgd", "adam") or activation not in ("relu", "tanh") or invalid not in ("error", "skip"):
        raise ScoringError("optimizer is sgd or adam, activation relu or tanh, invalid error or skip")
    if epochs < 1 or batches < 1:
        raise ScoringError("at least one epoch and one batch")
    rows = _prepare(df, features, label, F.lit(False) if validation is None else validation, batches, invalid, seed)
    if name == "cross_entropy" and classes is None:
        classes = int(rows.agg(F.max("y")).first()[0] or 0) + 1
    stack = Stack((len(features), *hidden, classes if name == "cross_entropy" else 1), activation)
    settings = hashlib.sha256(json.dumps([list(features), label, name, learning_rate, optimizer, momentum, batches, stack.sizes, activation, pos_weight,
                                          l2, seed]).encode()).hexdigest()
    run_dir = run_dir or f"{checkpoint_root(spark)}/training-run-{uuid.uuid4().hex}"
    params, opt = stack.start(seed), Optimizer(optimizer, learning_rate, momentum)
    done, waited, best_epoch, best_loss, best = 0, 0, 0, float("inf"), params
    saved = _saved(spark, run_dir)
    if saved is not None and (last := saved.orderBy(F.desc("epoch")).limit(1).collect()):
        s = last[0]
        if s.settings != settings:
            raise ScoringError(f"{run_dir} holds epochs of a run with other settings")
        params, best, opt.slots, opt.steps = np.array(s.params), np.array(s.best), np.array(s.slots), s.steps
        done, waited, best_epoch, best_loss = s.epoch, s.waited, s.best_epoch, s.best_loss

    penalised = np.concatenate([np.concatenate([np.ones(a * b), np.zeros(b)]) for a, b in zip(stack.sizes[:-1], stack.sizes[1:], strict=True)])
    held, ahead, stopped = rows.where("part < 0"), None, patience is not None and done > 0 and waited >= patience
    epoch = done
    while epoch < epochs and not stopped:
        epoch += 1
        cost = n = 0.0
        for k in range(batches):
            got = ahead or _sums(rows if batches == 1 else rows.where(F.col("part") == k), stack, params, name, pos_weight, True)
            ahead = None
            if got["n"]:  # a batch may be empty
                params = opt.step(params, got["slope"] / got["n"] + l2 * penalised * params)
            cost, n = cost + got["loss"], n + got["n"]
        if not n:
            raise ScoringError("no rows to train on")
        after = _sums(rows if batches == 1 else held, stack, params, name, pos_weight, batches == 1)
        ahead = after if batches == 1 else None
        train_loss, val_loss = float(cost / n), float(after["val_loss"] / after["val_n"]) if after["val_n"] else None
        watched = train_loss if val_loss is None else val_loss
        if not (np.isfinite(watched) and np.isfinite(train_loss)):
            raise ScoringError(f"the loss of epoch {epoch} is not finite")
        if watched < best_loss - min_delta:
            best, best_epoch, best_loss, waited = params, epoch, watched, 0
        else:
            waited += 1
        spark.createDataFrame([(epoch, train_loss, val_loss, opt.steps, waited, best_epoch, float(best_loss), params.tolist(), best.tolist(),
                                opt.slots.tolist(), settings)], STATE).coalesce(1).write.mode("append").parquet(run_dir)
        stopped = patience is not None and waited >= patience
    chosen = best if patience is not None and best_epoch else params
    layers = []
    for w, b in stack.layers(chosen):
        layers += [("linear", w, b), (activation,)]
    layers[-1:] = {"bce": [("sigmoid",)], "cross_entropy": [("softmax",)]}.get(name, [])
    history = spark.read.schema(STATE).parquet(run_dir).select("epoch", "train_loss", "val_loss", "params")
    return Trained(Dense(layers), history, best_epoch, epoch, stopped)
