"""SimHash near duplicates, joined by pivot distance tables.

A text's fingerprint has a bit where over half of its shingle hashes have it. Two fingerprints link at ``most`` or fewer differing bits.

The join works on distinct fingerprints. For many fixed reference fingerprints (pivots) the Hamming distance of every fingerprint is tabled.
Two fingerprints within ``most`` bits differ by ``most`` at the utmost in every coordinate (triangle inequality), so

* cells: the range of a pivot's distances is cut into intervals; a fingerprint lies in its interval and, where it is within ``most`` above its
  lower end, in the one below as well. Every linked pair shares a cell. Crowded cells are cut again by the next pivots, until they are small;
* inside a cell pairs are discarded by the largest coordinate difference, over pivots that did not cut it, and the survivors are
  verified by their differing bits.

A cell that stays crowded although it was cut holds fingerprints that are close to each other, where distances to pivots tell little. Those
go an exact way that needs no pairs: two fingerprints within 2 * r bits share a fingerprint within r bits of either, so each fingerprint meets the
others at the (at most 65, for r = 1) fingerprints around it, and no meeting point has more than those. Nothing is dropped or capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featpipe.llm.common import components, mix, stored

PIVOTS = 48  # reference fingerprints: the first of the list cut cells, all that did not cut one discard pairs in it
CUTS = 4  # pivots by which a crowded cell is cut at once
WIDE = 9  # distances in an interval of a cut
CELL = 4_096  # fingerprints of a cell that is joined as it stands, at most
SLICE = 1 << 18  # shingles voted on at once


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The fixed reference fingerprints: a 64-bit finaliser of 1, 2, 3, ..."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: bytes, n: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The A-Z-lowered words joined by spaces, and where each n-word shingle starts and ends in them."""
    words = text.lower().split()
    if not words:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(n, len(words))
    return b" ".join(words), starts[: len(words) - n + 1], ends[n - 1 :]


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """A bit is set if over half of the shingles' XXH64 hashes (seed 42) have it; no words: zero."""
    if not text:
        return 0
    joined, starts, ends = shingles(text, n)
    count = len(starts)
    if not count:
        return 0
    votes = np.zeros(64, np.int64)
    for k in range(0, count, SLICE):
        s, e = starts[k : k + SLICE].tolist(), ends[k : k + SLICE].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(s, e, strict=True)), np.uint64, len(s))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(n: int):
    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t, n) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found.view(np.int64))], ["id", "print"])

    return run


def fingerprints(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id and print (the fingerprint's 64 bits as a signed long) of every row; NULL, empty and wordless texts have zero."""
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return own.mapInArrow(_fingerprints(n), "id long, print long")


def hex_digits(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def distances(prints: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The pivot distance table: (fingerprints, pivots)."""
    return np.bitwise_count(prints[:, None] ^ refs[None]).astype(np.int16)


def _cut(first: int, most: int):
    """Rows (cell, print, crowd) into the cells that the pivots ``first`` to ``first + CUTS`` cut from theirs."""
    refs = pivots()[first : first + CUTS]

    def run(batches):
        for b in batches:
            cell, prints = b.column("cell").to_numpy().view(np.uint64), b.column("print").to_numpy().view(np.uint64)
            crowd, table = b.column("crowd").to_numpy(), distances(prints, refs)
            for p in range(len(refs)):
                at = table[:, p] // WIDE
                low = np.flatnonzero((table[:, p] % WIDE < most) & (at > 0))  # partners may lie in the interval below
                both, at = np.concatenate([np.arange(len(at)), low]), np.concatenate([at, at[low] - 1])
                cell = mix(cell[both] * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) + np.uint64(1))
                prints, crowd, table = prints[both], crowd[both], table[both]
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(crowd)],
                                             ["cell", "print", "crowd"])

    return run


def merge(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of ``i`` and ``j`` in ``up``, where every member points to the first of its group."""
    while len(i):
        a, b = up[i], up[j]
        on = a != b
        i, j, a, b = i[on], j[on], a[on], b[on]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not (up == up[up]).all():
            up[:] = up[up]


def groups_of(prints: np.ndarray, table: np.ndarray, most: int) -> np.ndarray:
    """Index of the first member of each fingerprint's group, linked by pairs within ``most`` bits. ``table``: pivot distances."""
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + most, side="right")  # the first coordinate: a window of the sorted order
    up, place = np.arange(len(prints)), np.arange(len(prints))
    for s in range(0, len(prints), 512):
        e = min(s + 512, len(prints))
        top = ends[e - 1]
        near = np.abs(table[s:e, 1, None] - table[None, s:top, 1]) <= most
        near &= (place[None, s:top] > place[s:e, None]) & (place[None, s:top] < ends[s:e, None])
        i, j = np.nonzero(near)
        i, j = i + s, j + s
        for p in range(2, table.shape[1]):
            on = np.abs(table[i, p] - table[j, p]) <= most
            i, j = i[on], j[on]
        on = np.bitwise_count(prints[i] ^ prints[j]) <= most
        merge(up, i[on], j[on])
    back = np.empty_like(order)
    back[order] = order[up]
    return back


def _join(first: int, most: int):
    """Edges that connect exactly the linked fingerprints of one cell, which the pivots before ``first`` have cut."""
    refs = pivots()[first:]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        prints = pdf["print"].to_numpy().view(np.uint64)
        own, of = prints.view(np.int64), groups_of(prints, distances(prints, refs), most)
        on = of != np.arange(len(of))
        return pd.DataFrame({"a": own[on], "b": own[of[on]]})

    return run


def masks(bits: int) -> np.ndarray:
    """All 64-bit masks of ``bits`` set bits at most, by number of bits."""
    found = [np.zeros(1, np.uint64)]
    for k in range(bits):
        single = np.uint64(1) << np.arange(64, dtype=np.uint64)
        more = (found[-1][:, None] | single[None]).ravel()
        found.append(np.unique(more[np.bitwise_count(more) == k + 1]))
    return np.concatenate(found)


def _around(most: int):
    """Each fingerprint at every meeting point around it; near: within the smaller of the two radii that sum to ``most``."""
    all_, few = masks(most - most // 2), len(masks(most // 2))

    def run(batches):
        for b in batches:
            prints = b.column("print").to_numpy().view(np.uint64)
            for s in range(0, len(prints), 1024):
                own = prints[s : s + 1024]
                points = (own[:, None] ^ all_[None]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(points.view(np.int64)), pa.array(own.repeat(len(all_)).view(np.int64)),
                     pa.array(np.tile(np.arange(len(all_)) < few, len(own)))], ["point", "print", "near"])

    return run


def _meeting(prints: DataFrame, most: int) -> DataFrame:
    """Edges that connect exactly the linked fingerprints, without pairs: a point holds no more of them than it has masks around it."""
    met = prints.mapInArrow(_around(most), "point long, print long, near boolean").groupBy("point").agg(
        F.min(F.when(F.col("near"), F.col("print"))).alias("a"), F.collect_list("print").alias("all"))
    return met.where("a IS NOT NULL AND size(all) > 1").select("a", F.explode("all").alias("b")).where("a <> b").distinct()


EDGE = "a long, b long"


def links(prints: DataFrame, most: int = 2, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within ``most`` bits of each other. ``prints``: distinct ones, column print."""
    n = prints.count()
    crowded = prints.select(F.lit(0).cast("long").alias("cell"), "print", F.lit(n).cast("long").alias("crowd"))
    if n <= cell:
        return stored(crowded.groupBy("cell").applyInPandas(_join(0, most), EDGE), "simhash-links")
    edges, close = [], []
    for first in range(0, PIVOTS - 16, CUTS):
        cut = stored(crowded.mapInArrow(_cut(first, most), "cell long, print long, crowd long"), "simhash-cells")
        sizes = stored(cut.groupBy(F.col("cell").alias("of")).agg(F.count("*").alias("n"), F.max("crowd").alias("was")), "simhash-sizes")
        sized = cut.drop("crowd").join(sizes, F.col("cell") == F.col("of")).drop("of")
        small, whole = F.col("n") <= cell, 2 * F.col("n") > F.col("was")
        edges.append(stored(sized.where(small).select("cell", "print").groupBy("cell").applyInPandas(_join(first + CUTS, most), EDGE), "simhash-links"))
        close.append(sized.where(~small & whole).select("print"))  # most of its crowd stayed together
        crowded = sized.where(~small & ~whole).select("cell", "print", F.col("n").alias("crowd"))
        if sizes.where(~small & ~whole).isEmpty():
            break
    else:
        close.append(crowded.select("print"))
    for more in close:
        edges.append(_meeting(more.distinct(), most))
    whole = edges[0]
    for more in edges[1:]:
        whole = whole.unionByName(more)
    return whole


def near_duplicates(docs: DataFrame, n: int = 3, most: int = 2, key: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """key, print (fingerprint as a signed long) and component_id (the smallest key reachable by links of ``most`` or fewer differing bits).

    NULL, empty and wordless texts have the fingerprint zero, which links like any other; a text of fewer than ``n`` words is one
    shingle. Very long texts are voted on in slices. Rows with a NULL key take part and get the smallest key of their component, if it has one.
    Repeated rows are rows. Other columns are not looked at. An empty table gives an empty table.
    """
    rows = stored(fingerprints(docs, n, key, text), "simhash-rows")
    names = stored(rows.groupBy("print").agg(F.min("id").alias("least")), "simhash-prints")
    found = stored(components(links(names.select("print"), most, cell)), "simhash-groups")
    of = names.join(found, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("label", "print").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    known = of.join(least, "label").select(F.col("print").alias("of"), "component_id")
    return rows.join(stored(known, "simhash-components"), F.col("print") == F.col("of")).select(F.col("id").alias(key), "print", "component_id")
