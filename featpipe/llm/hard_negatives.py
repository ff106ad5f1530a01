"""Hard-negative mining over an inverted multi-index.

Vectors become integers and are cut into two halves, each with a codebook of its own (k-means on a bounded sample); a cell is a pair of
half-space entries. Every row is indexed: rows are sorted by cell into shards of bounded size, and each shard keeps, for its own rows,
the radius of every half-space entry (the distance of its farthest member).

An anchor's inner product with a member of an entry is at most <half, centre> + |half| * radius. A multi-sequence heap visits the
cells in the order of the two halves' summed bounds, rows of visited cells are scored exactly, and the visit ends when the next cell's
bound certifies that no window (the best rows of the anchor's label; the best rows of other labels between two scores) can still change. The
search is exact whatever the codebooks; they decide its cost alone. Each shard gives its first rows per window, which meet by anchor.

Anchors (the stated query set) go to the shards in blocks of bounded bytes, one pass over the index a block.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featpipe.llm.common import stored
from featpipe.llm.vector_codes import finite, integers

SAMPLE = 20_000  # rows the half-space codebooks are fitted on, at most: those of the smallest key hashes
CELLS = 24  # entries of a half-space codebook
SHARD = 8_192  # rows of a shard, about
BLOCK_BYTES = 32 << 20  # packed anchors that go out at once, at most
STEP = 8  # cells scored together between two looks at the stopping rule

INDEX = "row long, key long, label {label}, a int, b int, vector binary"


def half_codebooks(x: np.ndarray, entries: int, rounds: int = 8) -> list[np.ndarray]:
    """Two codebooks (entries, half) from rows ``x``; entries start at rows spread over the sample."""
    books = []
    for part in np.split(x.astype(np.float64), [x.shape[1] // 2], 1):
        distinct = np.unique(part, axis=0)
        book = distinct[np.linspace(0, len(distinct) - 1, min(entries, len(distinct))).astype(int)].copy()
        for _ in range(rounds):
            code = codes_of(part, book)
            count = np.bincount(code, minlength=len(book))
            total = np.zeros_like(book)
            np.add.at(total, code, part)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
        books.append(book)
    return books


def codes_of(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1)[None] - 2 * part @ book.T).argmin(1)


class Shard:
    """Rows of one shard in the order of their cells, with the bounds' parts: entries in use, centres and radii of both halves."""

    def __init__(self, row, key, none, label, a, b, vectors, books):
        order = np.lexsort((b, a))
        self.row, self.key, self.none, self.label, self.vectors = row[order], key[order], none[order], label[order], vectors[order]
        a, b = a[order], b[order]
        cut = vectors.shape[1] // 2
        self.cut, self.entries, self.centres, self.radii = cut, [], [], []
        for codes, part, book in ((a, self.vectors[:, :cut], books[0]), (b, self.vectors[:, cut:], books[1])):
            used, at = np.unique(codes, return_inverse=True)
            far = np.zeros(len(used))
            np.maximum.at(far, at, np.sqrt(((part - book[codes]) ** 2).sum(1)))
            self.entries.append(used)
            self.centres.append(book[used])
            self.radii.append(far)
        place = np.searchsorted(self.entries[0], a) * len(self.entries[1]) + np.searchsorted(self.entries[1], b)
        self.starts = np.searchsorted(place, np.arange(len(self.entries[0]) * len(self.entries[1]) + 1))

    def bounds(self, q: np.ndarray) -> tuple[list, list, list, list, float]:
        """Entries of both halves by falling bound, the bounds, and a margin above their rounding errors."""
        out, slack = [], 1e-6
        for half, centres, radii in zip((q[: self.cut], q[self.cut :]), self.centres, self.radii, strict=True):
            norm = np.sqrt((half**2).sum())
            bound = centres @ half + norm * radii
            order = np.argsort(-bound, kind="stable")
            out += [order.tolist(), bound[order].tolist()]
            slack += 1e-9 * norm * float(np.sqrt((centres**2).sum(1)).max() + radii.max())
        return *out, slack

    def visit(self, q: np.ndarray):
        """Multi-sequence visit: (bound, start, end) of the cells with rows, by falling bound. What is left is below the last bound."""
        first, u, second, v, slack = self.bounds(q)
        wide = len(self.entries[1])
        heap = [(-(u[0] + v[0]), 0, 0)]
        starts = self.starts
        while heap:
            low, i, j = heapq.heappop(heap)
            if j + 1 < len(v):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
            at = first[i] * wide + second[j]
            if starts[at] < starts[at + 1]:
                yield slack - low, starts[at], starts[at + 1]

    def search(self, q: np.ndarray, wanted, done):
        """Scores rows cell by cell. ``wanted(rows, scores)`` takes them; the visit ends when ``done(bound)`` is true of the next bound."""
        pending, count = [], 0
        for bound, start, end in self.visit(q):
            if count % STEP == 0:
                if pending:
                    self._score(q, pending, wanted)
                    pending = []
                if done(bound):
                    return
            pending.append((start, end))
            count += 1
        if pending:
            self._score(q, pending, wanted)

    def _score(self, q, cells, wanted):
        rows = np.concatenate([np.arange(s, e) for s, e in cells])
        wanted(rows, self.vectors[rows] @ q)


class Best:
    """The first ``k`` rows by (score falling, key, rows without a key last) among those offered."""

    def __init__(self, k: int):
        self.k, self.rows, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self):
        """The score that a row must reach to come in; none while there is room."""
        return self.scores[-1] if len(self.scores) == self.k else None

    def offer(self, shard: Shard, rows, scores):
        if len(self.scores) == self.k:
            on = scores >= self.scores[-1]
            rows, scores = rows[on], scores[on]
        if not len(rows):
            return
        rows, scores = np.concatenate([self.rows, rows]), np.concatenate([self.scores, scores])
        if len(rows) > 4 * self.k:  # only what reaches the k-th score is sorted
            on = scores >= np.partition(scores, -self.k)[-self.k]
            rows, scores = rows[on], scores[on]
        order = np.lexsort((shard.row[rows], shard.key[rows], shard.none[rows], -scores))[: self.k]
        self.rows, self.scores = rows[order], scores[order]


def first_of_label(shard: Shard, row: int, label, q: np.ndarray, k: int) -> Best:
    """The shard's best ``k`` rows of the anchor's label, without the anchor."""
    best = Best(k)

    def wanted(rows, scores):
        on = (shard.label[rows] == label) & (shard.row[rows] != row)
        best.offer(shard, rows[on], scores[on])

    def done(bound):
        return best.least() is not None and bound < best.least()

    if (shard.label == label).any():
        shard.search(q, wanted, done)
    return best


def first_in_windows(shard: Shard, label, q: np.ndarray, windows: list[tuple], k: int) -> list[Best]:
    """For each window (low, high): the shard's best ``k`` rows of other labels with low <= score <= high."""
    found = [Best(k) for _ in windows]

    def wanted(rows, scores):
        on = shard.label[rows] != label
        rows, scores = rows[on], scores[on]
        for best, (low, high) in zip(found, windows, strict=True):
            on = (scores >= low) & (scores <= high)
            if on.any():
                best.offer(shard, rows[on], scores[on])

    def done(bound):
        return all(bound < low or (best.least() is not None and bound < best.least()) for best, (low, high) in zip(found, windows, strict=True))

    if windows:
        shard.search(q, wanted, done)
    return found


def _matrix(blobs: list[bytes]) -> np.ndarray:
    """Integer vectors as doubles where all inner products are exact in them, else as 64-bit integers."""
    x = np.frombuffer(b"".join(blobs), np.int32).reshape(len(blobs), -1)
    return x.astype(np.float64) if not x.size or int(np.abs(x.astype(np.int64)).max()) ** 2 * x.shape[1] < 1 << 52 else x.astype(np.int64)


def _shards(batches, books, rows: int):
    """The index rows of a task as shards of about ``rows``."""
    held, count = [], 0

    def shard():
        t = pa.Table.from_batches(held)
        key = t.column("key")
        return Shard(t.column("row").to_numpy(), key.fill_null(0).to_numpy(), key.is_null().to_numpy(), t.column("label").to_numpy(zero_copy_only=False),
                     t.column("a").to_numpy(), t.column("b").to_numpy(), _matrix(t.column("vector").to_pylist()), books)

    for b in batches:
        if b.num_rows:
            held.append(b)
            count += b.num_rows
        if count >= rows:
            yield shard()
            held, count = [], 0
    if held:
        yield shard()


def _emit(shard: Shard, found: list[tuple], label_names: list[str]):
    """One batch of (anchor row, window, key, score) for all that a shard found."""
    at = [r for *_, best in found for r in best.rows]
    out = [np.array([f[0] for f in found for _ in f[-1].rows], np.int64), np.array([f[1] for f in found for _ in f[-1].rows], np.int32),
           pa.array(shard.key[at], pa.int64(), mask=shard.none[at]) if at else pa.array([], pa.int64()),
           np.array([int(s) for *_, best in found for s in best.scores], np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out], label_names)


def _positives(block, books, k: int, rows: int, batches):
    anchors, vectors = block.value
    for shard in _shards(batches, books, rows):
        found = [(row, 0, first_of_label(shard, row, label, q, k)) for (row, label), q in zip(anchors, _matrix(vectors), strict=True)]
        yield _emit(shard, found, ["anchor", "window", "key", "score"])


def _negatives(block, books, k: int, rows: int, batches):
    anchors, vectors, windows = block.value
    for shard in _shards(batches, books, rows):
        found = []
        for (row, label), q, own in zip(anchors, _matrix(vectors), windows, strict=True):
            found += [(row, i, best) for i, best in enumerate(first_in_windows(shard, label, q, own, k))]
        yield _emit(shard, found, ["anchor", "window", "key", "score"])


FOUND = "anchor long, window int, key long, score long"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor's window over all shards, with their place from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _indexed(books, scale: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column("vector"), scale)
            if x.shape[1] != sum(book.shape[1] for book in books):
                raise ValueError("vectors differ in length")
            cut = books[0].shape[1]
            a, c = codes_of(x[:, :cut].astype(np.float64), books[0]), codes_of(x[:, cut:].astype(np.float64), books[1])
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("key"), b.column("label"), pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32)),
                 pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary())], ["row", "key", "label", "a", "b", "vector"])

    return run


def index(vectors: DataFrame, key: str, vector: str, label: str, scale: int, cells: int, sample: int, shard: int):
    """The stored index (every row that takes part, sorted by cell into shards) and its half-space codebooks; None of an empty table."""
    own = vectors.where(finite(vector) & F.col(f"`{label}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector"))
    fit = own.select("vector").orderBy(F.xxhash64("key", F.lit(7)), "vector").limit(sample).toArrow()
    if not fit.num_rows:
        return None, None, 0
    x = integers(fit.column("vector").combine_chunks(), scale)
    if x.shape[1] < 2:
        raise ValueError("a vector of fewer than two components has no two halves")
    books = half_codebooks(x, cells)
    numbered = own.withColumn("row", F.monotonically_increasing_id())
    # numbered once, in a written table: a row keeps its number whatever is computed again
    coded = stored(numbered.mapInArrow(_indexed(books, scale), INDEX.format(label=dict(own.dtypes)["label"])), "negatives-rows")
    n = coded.count()
    ranges = max(1, -(-n // shard))
    return stored(coded.repartitionByRange(ranges, "a", "b", "row").sortWithinPartitions("a", "b"), "negatives-index"), books, x.shape[1]


def mine(vectors: DataFrame, anchors: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
         key: str = "vec_id", vector: str = "embedding", label: str = "label", cells: int = CELLS, sample: int = SAMPLE,
         shard: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for every anchor and positive with negatives.

    Anchors are the rows whose key ``anchors`` divides; their positives are the first ``positives`` other rows of the same label by
    integer inner product (ties: smaller key); negatives are the first ``negatives`` rows of other labels with low % to high % of the positive's
    score. Rows with a NULL label, a NULL vector or a NULL or non-finite component take no part. Rows with a NULL key are no anchors, and
    come after all keys among equal scores. Repeated rows are rows: each is an anchor, a positive or a negative of its own. Other columns are
    not looked at. Empty tables, and tables without anchors, give no rows. Vectors of unlike length are an error.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, books, width = index(vectors, key, vector, label, scale, cells, sample, shard)
    if rows is None:
        return spark.createDataFrame([], schema)
    asking = rows.where(F.col("key") % anchors == 0)
    blocks = max(1, -(-asking.count() * width * 4 // BLOCK_BYTES))
    out = []
    for k in range(blocks):
        mine = asking.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)
        block = mine.select("row", "label", "vector").orderBy("row").collect()
        if not block:
            continue
        queries, packed = [(r["row"], r["label"]) for r in block], [bytes(r["vector"]) for r in block]
        sent = spark.sparkContext.broadcast((queries, packed))
        best = stored(_merged(rows.mapInArrow(partial(_positives, sent, books, positives, shard), FOUND), positives), "negatives-positives")
        windows: dict = {}
        for r in best.orderBy("anchor", "place").toLocalIterator():
            # low * positive <= 100 * negative <= high * positive, in integers
            windows.setdefault(r.anchor, []).append((-(-low * r.score // 100), high * r.score // 100))
        sent2 = spark.sparkContext.broadcast((queries, packed, [windows.get(row, []) for row, _ in queries]))
        worst = stored(_merged(rows.mapInArrow(partial(_negatives, sent2, books, negatives, shard), FOUND), negatives), "negatives-found")
        ids = mine.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
        first = best.select("anchor", (F.col("place") - 1).alias("window"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
        out.append(worst.select("anchor", "window", F.col("place").cast("int").alias("rank"), F.col("key").alias("negative_id"),
                                F.col("score").alias("negative_score")).join(first, ["anchor", "window"]).join(ids, "anchor"))
    if not out:
        return spark.createDataFrame([], schema)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
