"""Token counts by finite-state tokenizer compilation (byte-level BPE files of the ``tokenizers`` library).

Two deterministic transducers are composed:

1. The *cutter* reads character classes. Its transitions are annotated with the pre-tokens they begin (at this
   character, or late, at the one before it). All texts of a batch form one class string with an end symbol after each text
   and in place of each special string. The string is dealt into chunks; every chunk's state map (entry state ->
   exit state) is computed for all chunks side by side, the maps compose through a parallel prefix scan, and with
   the entry states so found all chunks emit their cuts side by side.
2. The *lexicon* reads a pre-token and emits its number of tokens. It is compiled on demand: the distinct pre-tokens
   of a batch run through the merge table together, one merge of each per round, as array operations.

The tables depend on the tokenizer file alone (about 3 MB) and are broadcast.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1024  # characters of a chunk
SLICE = 4 << 20  # characters worked on at once

# character classes; the letters that end a contraction have their own
OTHER, NUMBER, BLANK, SPACE, QUOTE, LETTER, STMD, R, V, LL, E, END, PAD = range(13)
_LETTERS = (LETTER, STMD, R, V, LL, E)
# states: at a start; in a run of letters, numbers, others; one blank or other space; several, the last a blank or
# other; a quote that began a pre-token; such a quote and r, v or l; after a contraction
START, IN_L, IN_N, IN_O, ONE_B, ONE_S, MANY_B, MANY_S, Q, QR, QV, QL, DONE = range(13)
HERE, BEFORE = 1, 2  # annotations: a pre-token begins at this character, one began at the character before


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """Transition and annotation tables, [state, class], of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    go, mark = np.zeros((13, 13), np.uint8), np.zeros((13, 13), np.uint8)
    run = {**{c: IN_L for c in _LETTERS}, NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O}

    def begin(s, c, extra=0):  # a new pre-token begins at this character
        go[s, c] = {QUOTE: Q, BLANK: ONE_B, SPACE: ONE_S}.get(c, run.get(c))
        mark[s, c] = HERE | extra

    for s in range(13):
        go[s, PAD] = s
        go[s, END] = START
        mark[s, END] = BEFORE if s in (QR, QV, QL) else 0
        for c in range(END):
            begin(s, c)
    for s, same in ((IN_L, _LETTERS), (IN_N, (NUMBER,)), (IN_O, (OTHER, QUOTE))):
        for c in same:
            go[s, c], mark[s, c] = s, 0
    for s in (ONE_B, ONE_S, MANY_B, MANY_S):
        late = BEFORE if s in (MANY_B, MANY_S) else 0  # the last of several spaces stands alone or with what follows
        for c, to in run.items():
            if s in (ONE_B, MANY_B):
                go[s, c], mark[s, c] = to, late
            else:
                begin(s, c, late)
        go[s, BLANK], go[s, SPACE] = MANY_B, MANY_S
        mark[s, BLANK] = mark[s, SPACE] = 0
    go[Q, OTHER] = go[Q, QUOTE] = IN_O
    mark[Q, OTHER] = mark[Q, QUOTE] = 0
    for c, to in ((STMD, DONE), (R, QR), (V, QV), (LL, QL)):
        go[Q, c], mark[Q, c] = to, 0
    for s, closing in ((QR, E), (QV, E), (QL, LL)):
        for c in range(END):  # no contraction after all: the letter began a run
            go[s, c], mark[s, c] = go[IN_L, c], mark[IN_L, c] | BEFORE
        go[s, closing], mark[s, closing] = DONE, 0
    return go, mark


def run_chunks(classes: np.ndarray, go: np.ndarray, mark: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which pre-tokens begin, by chunk state maps and a prefix scan over them."""
    n = len(classes)
    k = -(-n // chunk)
    grid = np.full(k * chunk, PAD, np.uint8)
    grid[:n] = classes
    steps = np.ascontiguousarray(grid.reshape(k, chunk).T)
    flat_go, flat_mark = go.ravel(), mark.ravel()
    states = go.shape[0]
    # every entry state at first; once all of them agree in every chunk, one is enough
    at = np.broadcast_to(np.arange(states, dtype=np.uint8), (k, states)).copy()
    t = 0
    while t < chunk and at.shape[1] > 1:
        at = flat_go[at.astype(np.intp) * 13 + steps[t][:, None]]
        t += 1
        if (at == at[:, :1]).all():
            at = at[:, :1]
    for c in steps[t:]:
        at = flat_go[at.astype(np.intp) * 13 + c[:, None]]
    maps = np.broadcast_to(at, (k, states)).copy()
    hop = 1
    while hop < k:  # inclusive scan: the map of chunks 0..i
        maps[hop:] = np.take_along_axis(maps[hop:], maps[:-hop].astype(np.intp), 1)
        hop *= 2
    now = np.empty(k, np.uint8)
    now[0] = START
    now[1:] = maps[:-1, START]
    marks = np.empty((chunk, k), np.uint8)
    for t, c in enumerate(steps):
        x = now.astype(np.intp) * 13 + c
        marks[t] = flat_mark[x]
        now = flat_go[x]
    flat = marks.T.ravel()[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins)


class Compiled:
    """The tables of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Regex, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normaliser and added blank is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings that take white space are not supported")
        vocab = model["vocab"]
        # the printable stand-ins of bytes: printable Latin-1 bytes stand for themselves, the rest follow from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in plain]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made
        # classes of all characters as the library's own pattern engine sees them
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, points))
        points = np.array(points)
        self.classes = np.full(0x110000, OTHER, np.uint8)
        for cls, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            left = pre_tokenizers.Split(Regex(f"{pattern}+"), "isolated").pre_tokenize_str(text)
            member = np.zeros(len(points), bool)
            single = pre_tokenizers.Split(Regex(f"{pattern}+"), "removed").pre_tokenize_str(text)
            kept = {s for _, s in single}
            for _, (a, b) in left:
                if (a, b) not in kept:
                    member[a:b] = True
            self.classes[points[member]] = cls
        for c, cls in ((" ", BLANK), ("'", QUOTE), ("s", STMD), ("t", STMD), ("m", STMD), ("d", STMD), ("r", R),
                       ("v", V), ("l", LL), ("e", E)):
            self.classes[ord(c)] = cls
        self.go, self.mark = cutter()


NONE = np.int32(2**31 - 1)


def _ranks(c: Compiled, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left.astype(np.int64) << 32 | right
    i = np.minimum(np.searchsorted(c.keys, key), len(c.keys) - 1)
    return np.where((c.keys[i] == key) & (right >= 0), c.rank[i], NONE)


def _merge_together(c: Compiled, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Token counts of rows of equal width (-1 fills): each round does the first best merge of every row."""
    out = lengths.copy()
    rows = np.arange(len(ids))
    width = ids.shape[1]
    cols = np.arange(width)
    ranks = _ranks(c, ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((len(ids), 0), np.int32)
    while width > 1 and len(rows):
        best = ranks.argmin(1)
        r = ranks[np.arange(len(rows)), best]
        on = r < NONE
        if not on.all():
            rows, ids, best, r = rows[on], ids[on], best[on], r[on]
            if not len(rows):
                break
        out[rows] -= 1
        src = np.minimum(cols + (cols > best[:, None]), width)
        ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), src, 1)
        ids[np.arange(len(rows)), best] = c.made[r]
        ranks = _ranks(c, ids[:, :-1], ids[:, 1:])
    return out


def _merge_long(c: Compiled, word: bytes) -> int:
    """Token count of one long pre-token, by a heap of merges over a linked list."""
    ids = c.byte_ids[np.frombuffer(word, np.uint8)].astype(np.int64)
    n = len(ids)
    first = _ranks(c, ids[:-1], ids[1:])
    ids = ids.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r < NONE]
    heapq.heapify(heap)
    table = dict(zip(c.keys.tolist(), c.rank.tolist(), strict=True))
    alive = n
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = int(c.made[r]), -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        alive -= 1
        for p, q in ((before[i], i), (i, after[i])):
            if 0 <= p and q < n and (x := table.get(ids[p] << 32 | ids[q])) is not None:
                heapq.heappush(heap, (x, p, ids[p], ids[q]))
    return alive


def lexicon(c: Compiled, words: list[bytes]) -> np.ndarray:
    """Token counts of pre-tokens (distinct ones, for speed)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(words), np.int64)
    low = 0
    for width in (1, 2, 4, 6, 8, 10, 12, 16, 24, 32, 64):
        pick = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        for part in np.array_split(pick, -(-len(pick) * width // (1 << 21))) if len(pick) else ():
            own = lengths[part]
            data = np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8)
            ids = np.full((len(part), width), -1, np.int32)
            ids[np.arange(width) < own[:, None]] = c.byte_ids[data]
            out[part] = _merge_together(c, ids, own)
    for i in np.flatnonzero(lengths > low).tolist():
        out[i] = _merge_long(c, words[i])
    return out


def count(c: Compiled, texts: list[str | None]) -> np.ndarray:
    """Token counts of whole texts; NULL and empty texts have none."""
    counts = np.zeros(len(texts), np.int64)
    parts: list[str] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        if not t:
            continue
        pieces = [t]
        for s in c.special:
            pieces = [x for p in pieces for x in p.split(s)]
        counts[i] += len(pieces) - 1
        for p in pieces:
            parts.append(p)
            owner.append(i)
    if not parts:
        return counts
    text = "\0".join(parts) + "\0"  # the separator's class is set to END below
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = c.classes[points]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    classes[ends] = END
    begins = run_chunks(classes, c.go, c.mark)
    if not len(begins):
        return counts
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offset = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=offset[1:])
    part = np.searchsorted(ends, begins)  # the piece a pre-token lies in; it reaches to the next one or the piece's end
    stop = np.minimum(np.append(begins[1:], len(points)), ends[part])
    data = text.encode("utf-8", "surrogatepass")
    words = np.empty(len(begins), object)
    words[:] = [data[a:b] for a, b in zip(offset[begins].tolist(), offset[stop].tolist(), strict=True)]
    codes, uniq = pd.factorize(words)
    counts += np.bincount(np.array(owner)[part], lexicon(c, list(uniq))[codes], len(texts)).astype(np.int64)
    return counts


def _work(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = tables.value
        for batch in batches:
            texts = batch.column("__tc_text").to_pylist()
            got, start, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= SLICE or i + 1 == len(texts):
                    got.append(count(c, texts[start : i + 1]))
                    start, size = i + 1, 0
            n = pa.array(np.concatenate(got) if got else np.empty(0, np.int64), pa.int64())
            keep = [x for x in batch.schema.names if x != "__tc_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), n], [*keep, "__tc_n"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` and the token count of each whole text, as the library counts without added special tokens.

    Special strings inside texts count as one token each, as the library has it by default. NULL and empty
    texts count 0; rows may repeat; an empty table gives an empty table; a column named ``into`` is replaced.
    """
    tables = docs.sparkSession.sparkContext.broadcast(Compiled(tokenizer))
    names = [c for c in docs.columns if c != into]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__tc_c{k}") for k, c in enumerate(names)],
                        F.col(f"`{text}`").cast("string").alias("__tc_text"))
    kept = [f for f in inner.schema if f.name != "__tc_text"]
    out = inner.mapInArrow(_work(tables), T.StructType([*kept, T.StructField("__tc_n", T.LongType())]))
    return out.select(*[F.col(f"__tc_c{k}").alias(c) for k, c in enumerate(names)], F.col("__tc_n").alias(into))
