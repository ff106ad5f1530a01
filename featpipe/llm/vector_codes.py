"""Vector code compression: product codes whose codebooks are moved by Ball k-means.

A vector becomes integers floor(scale * x) and is cut into equal parts; each part position has a codebook of its own. Entries start
as parts of the rows with the smallest keys. A round assigns every part to the nearest entry (ties to the lower index) and moves each
entry to the componentwise floor of its parts' mean.

The parts of an entry form a ball: its radius is the distance of the farthest one. Only entries whose gap to the ball's own entry is at
most twice the radius are its neighbours. A part nearer to its entry than half the gap to the nearest neighbour lies in the ball's
stable core and is left alone; the others walk outward through the rings between half gaps and compare with the neighbours up to
their own ring only. All of it is integer arithmetic on squared distances, so the codes equal those of a full search. A ball covers the
members in one Arrow batch: its radius is at most that of all members, so it has no neighbour too few.

Rows lie packed in the shared folder, one write a round; entries come from sums that are combined by Spark before they reach the driver
(entries x dimensions numbers, whatever the rows).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featpipe.llm.common import stored

LARGEST = 1 << 26  # of an integer component: sums of squares stay exact in 64 bits
NEVER = np.iinfo(np.int64).max


def finite(vector: str) -> Column:
    """True where the vector is there and all its components are finite numbers."""
    v = F.col(f"`{vector}`")
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """(rows, dimensions) of floor(scale * x). Rows of unlike length and components beyond LARGEST are an error."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // scale}: squared distances would not fit 64 bits")
    return x.astype(np.int64).reshape(len(lengths), -1)


@dataclass
class Codebooks:
    """``books``: (parts, entries, width) integers."""

    books: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: bytes) -> np.ndarray:
        """The integer vector that a code stands for."""
        return self.books[np.arange(len(self.books)), np.frombuffer(code, np.uint8)].ravel()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(-1)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """First assignment, when no ball is known: index of the nearest entry, ties to the lower one."""
    far = np.zeros((len(x), len(book)), np.int64)
    for k in range(book.shape[1]):
        far += (x[:, k, None] - book[None, :, k]) ** 2
    return far.argmin(1)


def reassign(x: np.ndarray, code: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance to it) of each part, from the balls of the assignment ``code``.

    An entry j can only be as near as the own entry e if gap(e, j) <= 2 * distance, squared: gap <= 4 * own.
    """
    own = squared(x, book[code])
    at, best = code.copy(), own.copy()
    if len(book) < 2 or not len(x):
        return at, best
    gaps = squared(book[:, None], book[None])
    np.fill_diagonal(gaps, -1)  # the own entry is no neighbour; equal entries have a gap of 0
    order = gaps.argsort(1, kind="stable")[:, 1:]
    gaps = np.take_along_axis(gaps, order, 1)
    radius = np.full(len(book), -1, np.int64)
    np.maximum.at(radius, code, own)
    gaps[gaps > 4 * radius[:, None]] = NEVER  # beyond the ball's neighbours
    live = np.flatnonzero(gaps[code, 0] <= 4 * own)  # the rest are stable
    for ring in range(1, len(book)):
        if not len(live):
            break
        other = order[code[live], ring - 1]
        far = squared(x[live], book[other])
        better = (far < best[live]) | ((far == best[live]) & (other < at[live]))
        moved = live[better]
        at[moved], best[moved] = other[better], far[better]
        if ring < len(book) - 1:
            live = live[gaps[code[live], ring] <= 4 * own[live]]
    return at, best


PACKED = "key {key}, label {label}, vector binary, code binary, error long"


def _packed_batch(like, vectors: np.ndarray, codes: np.ndarray, error: np.ndarray):
    return pa.RecordBatch.from_arrays(
        [like.column("key"), like.column("label"), pa.array([v.tobytes() for v in vectors.astype(np.int32)], pa.binary()),
         pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(error, pa.int64())],
        ["key", "label", "vector", "code", "error"])


def _unpacked(batch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    vectors = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int32).astype(np.int64).reshape(n, -1)
    return vectors, np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).astype(np.int64).reshape(n, -1)


def _first(books: np.ndarray, scale: int):
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column("vector"), scale)
            if x.shape[1] != parts * width:
                raise ValueError("vectors differ in length")
            codes = np.stack([nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)], 1)
            error = sum(squared(x[:, p * width : (p + 1) * width], books[p][codes[:, p]]) for p in range(parts))
            yield _packed_batch(b, x, codes, error)

    return run


def _again(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, codes = _unpacked(b)
            found = [reassign(x[:, p * width : (p + 1) * width], codes[:, p], books[p]) for p in range(parts)]
            yield _packed_batch(b, x, np.stack([f[0] for f in found], 1), sum(f[1] for f in found))

    return run


def _sums(parts: int, entries: int, width: int):
    """Per task: (part, entry, position, sum); position ``width`` holds the count."""

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, codes = _unpacked(b)
            for p in range(parts):
                for k in range(width):
                    total[p, :, k] += np.bincount(codes[:, p], x[:, p * width + k], entries).astype(np.int64)
                total[p, :, width] += np.bincount(codes[:, p], minlength=entries)
        at = np.nonzero(total)
        if len(at[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.ravel_multi_index(at, total.shape).astype(np.int32)), pa.array(total[at])],
                                             ["cell", "value"])

    return run


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' mean; unused ones stay."""
    parts, entries, width = books.shape
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for r in rows.mapInArrow(_sums(parts, entries, width), "cell int, value long").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r.cell] = r.value
    total = total.reshape(parts, entries, width + 1)
    count = total[..., width:]
    return np.where(count > 0, total[..., :width] // np.maximum(count, 1), books)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id",
             vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """(key, label, code binary: one byte a part, error: summed squared distances) of every kept row, and the codebooks.

    Rows whose vector is NULL or holds a NULL or non-finite component are left out; other columns are not looked at. Repeated rows
    are rows; among rows of one key the order of their vectors decides which is the smaller, NULL keys are the largest. With
    fewer rows than ``entries`` the codebooks have as many entries as rows. An empty table gives an empty table and no codebooks.
    Vectors of unlike length, a length that ``parts`` does not divide and components beyond LARGEST / scale are errors.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    own = vectors.where(finite(vector)).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    kinds = dict(own.dtypes)
    schema = PACKED.format(key=kinds["key"], label=kinds["label"])
    first = own.select("key", "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], schema).drop("vector"), None
    x = integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), scale)
    if not x.shape[1] or x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} components can't be cut into {parts} equal parts")
    books = np.ascontiguousarray(x.reshape(len(x), parts, -1).swapaxes(0, 1))
    rows = stored(own.mapInArrow(_first(books, scale), schema), "codes-first")
    for _ in range(rounds):
        books = _moved(rows, books)
        rows = stored(rows.mapInArrow(_again(books), schema), "codes-round")
    return rows.drop("vector"), Codebooks(books)


def label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error: error summed over the rows of a label, NULL labels together."""
    total = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels").withColumnRenamed("label", "of")
    return codes.join(total, F.col("label").eqNullSafe(F.col("of"))).drop("of")
