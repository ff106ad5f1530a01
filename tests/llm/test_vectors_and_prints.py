"""Vector codes, hard negatives and SimHash groups against full searches, and on odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from featpipe.llm import hard_negatives, simhash, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [(900, None, 1), (901, [0.1, None] * 16, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] + [0.0] * 31, 2)]


def _rows(n, labels=4, spread=0.3, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 32))
    return [(i, (centres[i % 6] + r.normal(size=32) * spread).astype(np.float32).tolist(), int(r.integers(labels))) for i in range(n)]


# ---------------------------------------------------------------- vector codes

def _full_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    x = np.floor(np.array([r[1] for r in kept], np.float64) * 256).astype(np.int64).reshape(len(kept), parts, -1)
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = x[order].swapaxes(0, 1).copy()

    def assign():
        far = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        return far.argmin(-1), far.min(-1)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    code, far = assign()
    return sorted((str(r[0]), str(r[2]), bytes(c.astype(np.uint8)), int(f.sum())) for r, c, f in zip(kept, code, far, strict=True)), books


@pytest.mark.parametrize("rows", [_rows(400) + ODD + [(5, None, 3)],
                                  [(i % 90, [float(i % 3)] * 16 + [float(-i % 5)] * 16, None if i % 4 else 1) for i in range(200)],  # ties, repeats
                                  _rows(20) + [(None, [0.5] * 32, 1), (None, [0.25] * 32, None)]])
def test_codes_equal_a_full_search(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS key", "'x' AS code", "'x' AS vector", "7 AS error", "1 AS cell")
    codes, books = vector_codes.compress(df)
    want, full = _full_codes(rows)
    assert (books.books == full).all()
    got = codes.collect()
    assert sorted((str(r.key), str(r.label), bytes(r.code), r.error) for r in got) == want
    assert books.sha256() == hashlib.sha256(",".join(str(v) for v in full.ravel()).encode()).hexdigest()
    total = {}
    for r in got:
        total[r.label] = total.get(r.label, 0) + r.error
    assert all(r.label_error == total[r.label] for r in vector_codes.label_errors(codes).collect())
    assert len(books.decode(bytes(got[0].code))) == 32


def test_balls_skip_stable_parts_and_keep_ties_low():
    r = np.random.default_rng(1)
    book = r.integers(-1000, 1000, (40, 3))
    book[7] = book[3]  # equal entries: the lower one
    x = np.concatenate([book[r.integers(40, size=2000)] + r.integers(-15, 15, (2000, 3)), r.integers(-1000, 1000, (300, 3))])
    far = ((x[:, None] - book[None]) ** 2).sum(-1)
    for start in (far.argmin(1), r.integers(40, size=len(x))):  # a good and an arbitrary assignment before
        at, best = vector_codes.reassign(x, start, book)
        assert (at == far.argmin(1)).all() and (best == far.min(1)).all()
    asked = []
    squared = vector_codes.squared
    vector_codes.squared = lambda a, b: (asked.append(len(a)), squared(a, b))[1]
    try:
        vector_codes.reassign(x[:2000], far.argmin(1)[:2000], book)
    finally:
        vector_codes.squared = squared
    assert sum(asked[2:]) < 0.2 * 2000 * 39  # own distances and gaps aside


def test_codes_of_empty_tables_and_wrong_vectors(spark):
    codes, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert books is None and codes.count() == 0 and vector_codes.label_errors(codes).count() == 0
    assert vector_codes.compress(spark.createDataFrame(ODD, VECTORS))[1] is None
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 10, 1)], VECTORS))
    with pytest.raises(Exception, match="differ in length"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 32, 1), (2, [0.5] * 16, 1)], VECTORS))[0].count()
    with pytest.raises(ValueError, match="beyond"):
        vector_codes.integers(pa.array([[1e30]]), 256)


# ---------------------------------------------------------------- hard negatives

def _full_negatives(rows, anchors=50, positives=5, negatives=3):
    kept = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64).astype(object), y) for i, v, y in rows
            if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (i, q, y) in enumerate(kept):
        if i is None or i % anchors:
            continue
        score = [(int(q @ v), j, z) for b, (j, v, z) in enumerate(kept) if b != a]
        for ps, pid, _ in sorted((s for s in score if s[2] == y), key=last)[:positives]:
            fits = sorted((s for s in score if s[2] != y and 50 * ps <= 100 * s[0] <= 95 * ps), key=last)[:negatives]
            out += [(i, pid, k + 1, s[1], ps, s[0]) for k, s in enumerate(fits)]
    return sorted(map(str, out))


@pytest.mark.parametrize("rows", [_rows(700) + ODD + [(50, [0.5] * 32, None)],
                                  _rows(300, labels=2) + _rows(100) * 2 + [(None, [1.0] * 32, 1), (None, [1.0] * 32, 0)],  # repeats, no key
                                  [(i, [float(2**17)] * 31 + [float(i)], i % 3) for i in range(120)]])  # products beyond 2**53
def test_negatives_equal_a_full_search(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS key", "'x' AS row", "1 AS a", "'x' AS score", "'x' AS anchor")
    got = hard_negatives.mine(df, cells=6, shard=150).collect()
    assert sorted(str(tuple(r)) for r in got) == _full_negatives(rows)  # recall 1


def test_negatives_in_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 400)
    rows = _rows(400)
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), cells=4).collect()
    assert sorted(str(tuple(r)) for r in got) == _full_negatives(rows)


def test_visits_end_before_all_cells_are_seen():
    rows = _rows(3000, spread=0.1)
    x = np.floor(np.array([r[1] for r in rows]) * 256)
    books = hard_negatives.half_codebooks(x, 12)
    a, b = hard_negatives.codes_of(x[:, :16], books[0]), hard_negatives.codes_of(x[:, 16:], books[1])
    ids, label = np.arange(len(x)), np.array([r[2] for r in rows])
    shard = hard_negatives.Shard(ids, ids, np.zeros(len(x), bool), label, a, b, x, books)
    bounds = [list(zip(*[(bound, s, e) for bound, s, e in shard.visit(x[k])], strict=True)) for k in range(5)]
    assert all(list(u) == sorted(u, reverse=True) for u, _, _ in bounds)  # falling
    assert all(sum(e) - sum(s) == len(x) for _, s, e in bounds)  # every row is in a visited cell
    for k in range(5):
        for bound, s, e in shard.visit(x[k]):
            assert (shard.vectors[s:e] @ x[k]).max() <= bound
    seen = []
    score = shard._score
    shard._score = lambda q, cells, wanted: (seen.append(sum(e - s for s, e in cells)), score(q, cells, wanted))[1]
    hard_negatives.first_of_label(shard, 0, label[0], x[0], 5)
    assert 0 < sum(seen) < 0.7 * len(x)


def test_negatives_of_tables_without_rows_or_anchors(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [0.5] * 4, 1), (2, [0.5] * 4, 2)], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(50, [0.5] * 4, 1)], VECTORS)).count() == 0


# ---------------------------------------------------------------- SimHash

def _full_print(text, n=3):
    words = (text or "").encode().lower().split()
    said = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in said]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints, most):
    """First index of each group, over all pairs."""
    x = np.array(prints, np.uint64)
    up = np.arange(len(x))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= most)
    while True:
        new = up.copy()
        np.minimum.at(new, i, up[j])
        if (new == up).all():
            return up.tolist()
        up = new


def _links(spark, prints, most, cell):
    distinct = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in distinct], "print long")
    edges = [(np.int64(r.a).astype(np.uint64), np.int64(r.b).astype(np.uint64)) for r in simhash.links(df, most, cell).collect()]
    assert all(int(a ^ b).bit_count() <= 64 for a, b in edges)
    at = {p: k for k, p in enumerate(distinct)}
    up = np.arange(len(distinct))
    simhash.merge(up, np.array([at[int(a)] for a, _ in edges], int), np.array([at[int(b)] for _, b in edges], int))
    return up.tolist(), _classes(distinct, most)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_links_equal_all_pairs(spark, most):
    r = random.Random(most)
    base = [r.getrandbits(64) for _ in range(250)]
    near = [p ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for p in base for _ in range(2)]
    # a crowd around one fingerprint, beyond what a cell may hold: it goes by meeting points
    crowd = [base[0] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(700 if most < 3 else 150)]
    for cell in (10_000, 100):
        got, want = _links(spark, base + near + crowd + [0], most, cell)
        assert got == want


def test_prints_and_groups_of_documents(spark, prose):
    r = random.Random(2)
    texts = [prose(r.randint(1, 200), k) for k in range(60)]
    for k in range(60):
        words = texts[k].split()
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    rows = [(k, t.upper() if k % 5 == 0 else t.replace(" ", "\n\t ")) for k, t in enumerate(texts)] + [(500, "İ É"), (501, "a"), (502, "A")]
    got = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cell=16).withColumn(
        "hex", simhash.hex_digits(F.col("print"))).collect()}
    want = [_full_print(t) for _, t in rows]
    assert [got[k].hex for k, _ in rows] == [f"{p:016x}" for p in want]
    assert [got[k].component_id for k, _ in rows] == [rows[c][0] for c in _classes(want, 2)]


def test_print_of_a_text_longer_than_a_slice(monkeypatch, prose):
    monkeypatch.setattr(simhash, "SLICE", 7)
    text = prose(100, 1)
    assert simhash.fingerprint(text.encode()) == _full_print(text)


def test_prints_of_odd_tables(spark, odd_docs, empty_docs):
    got = simhash.near_duplicates(odd_docs()).collect()
    assert sorted((str(x.doc_id), x.component_id) for x in got) == sorted(
        [("1", 1), ("2", 1), ("3", 1), ("None", None), ("4", 4), ("4", 4), ("5", 4), ("6", 6)])
    assert {x.print for x in got if x.doc_id in (1, 2, 3)} == {0}
    assert simhash.near_duplicates(empty_docs).count() == 0
