"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window of benchmark words is a pattern whose symbols are words. For each pattern length the tables hold, for
every block of two words, how far the search may jump (``shift``) and which windows end in that block (``ends``).
A position whose block lies in no window is skipped by almost a whole window; a block that ends windows leads
to direct comparison, word by word. Texts are scanned where they lie: the job is one pass without a shuffle.

The tables hold only the benchmark. Their size is checked before they are built: Spark counts the benchmark's words, a word
starts at most one window, and a window takes at most WINDOW_BYTES in memory. A benchmark whose tables would exceed
``table_bytes`` (or whose text ``block_bytes``) is dealt into blocks by item, and each block's tables go over all documents in their own pass; the passes'
hits are then merged per row. Equal words of a block are one object.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featpipe.llm.common import stored

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW_BYTES = 1024  # of tables for a benchmark word; measured: at most 980 while they are built, 580 then
TABLE_BYTES = 256 << 20  # of a block's tables, in the driver and in every Python worker
BLOCK_BYTES = 32 << 20  # of a block's text

# every byte that is no word byte becomes a blank; A-Z become a-z (words: 0-9, a-z and all non-ASCII characters)
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The comparison words of a text; NULL has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Tables:
    """Shift and bucket tables of all windows, one set for each window length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        by_length: dict[int, dict[tuple, set[str]]] = {}
        one: dict[bytes, bytes] = {}
        for item, text in items:
            w = [one.setdefault(x, x) for x in words_of(text)]
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
        self.sets = []
        for m, patterns in sorted(by_length.items()):
            width = min(2, m)
            shift: dict[tuple, int] = {}
            ends: dict[tuple, list] = {}
            for p, owners in patterns.items():
                for j in range(width, m + 1):
                    block = p[j - width : j]
                    shift[block] = min(shift.get(block, m), m - j)
                ends.setdefault(p[m - width :], []).append((list(p), sorted(owners)))
            self.sets.append((m, width, shift, ends, m - width + 1))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges [start, end) of all occurrences, and the items they belong to."""
        found, owners = [], set()
        n = len(words)
        for m, width, shift, ends, jump in self.sets:
            i = m
            if width == 2:
                while i <= n:
                    s = shift.get((words[i - 2], words[i - 1]), jump)
                    if s:
                        i += s
                        continue
                    for p, own in ends[words[i - 2], words[i - 1]]:
                        if words[i - m : i] == p:
                            found.append((i - m, i))
                            owners.update(own)
                    i += 1
            else:
                for i, w in enumerate(words):
                    for _, own in ends.get((w,), ()):
                        found.append((i, i + 1))
                        owners.update(own)
        return found, owners


def covered(ranges: list) -> int:
    """Words inside at least one range."""
    total, reach = 0, 0
    for a, b in sorted(map(tuple, ranges)):
        a = max(a, reach)
        if b > a:
            total, reach = total + b - a, b
    return total


def _scan(tables, many: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        for batch in batches:
            n_words, hits, items, spans = [], [], [], []
            for text in batch.column("__wm_text").to_pylist():
                w = words_of(text)
                found, owners = t.search(w)
                n_words.append(len(w))
                hits.append(covered(found) if found else 0)
                items.append(sorted(owners))
                spans.append([list(x) for x in sorted(set(found))] if many else [])
            keep = [c for c in batch.schema.names if c != "__wm_text"]
            made = [pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *MADE])

    return run


MADE = ["__wm_words", "__wm_hit", "__wm_items", "__wm_spans"]
KINDS = ["long", "long", "array<string>", "array<array<int>>"]


def _tag(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, keep_spans: bool,
         block_bytes: int, table_bytes: int) -> DataFrame:
    """Columns __wm_c0.. (those of ``docs``, in order) and MADE."""
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b"),
                     F.coalesce(F.sum(F.regexp_count("t", F.lit(WORD))), F.lit(0)).alias("words")).first()
    blocks = max(1, -(-int(size["b"]) // block_bytes), -(-int(size["words"]) * WINDOW_BYTES // table_bytes))
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__wm_c{k}") for k, c in enumerate(docs.columns)],
                        F.col(f"`{text}`").cast("string").alias("__wm_text"))
    if blocks > 1:  # rows need a name under which the passes' hits meet
        inner = stored(inner.withColumn("__wm_row", F.expr("uuid()")), "decontaminate")
    kept = [c for c in inner.columns if c != "__wm_text"]
    schema = T.StructType([T.StructField(c, inner.schema[c].dataType) for c in kept]
                          + [T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(MADE, KINDS, strict=True)])

    def scan(part: DataFrame | None, spans: bool) -> DataFrame:
        rows = [] if part is None else [(r["i"], r["t"]) for r in part.toLocalIterator()]
        return inner.mapInArrow(_scan(spark.sparkContext.broadcast(Tables(rows, window)), spans), schema)

    if blocks == 1:
        return scan(bench, keep_spans)
    passes = [scan(bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b), True).where("size(__wm_items) > 0")
              .select("__wm_row", "__wm_items", "__wm_spans") for b in range(blocks)]
    merged = reduce(DataFrame.unionByName, passes).groupBy("__wm_row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__wm_items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__wm_spans")))).alias("spans"))
    # words in a union of sorted ranges: each range adds what lies beyond the farthest end before it
    cover = F.aggregate(
        F.col("__wm_spans"), F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach")),
        lambda acc, x: F.struct(
            (acc["total"] + F.greatest(F.lit(0), x[1] - F.greatest(acc["reach"], x[0]))).alias("total"),
            F.greatest(acc["reach"], x[1]).alias("reach")),
        lambda acc: acc["total"])
    return (scan(None, False).drop("__wm_hit", "__wm_items", "__wm_spans").join(merged, "__wm_row", "left")
            .withColumn("__wm_items", F.coalesce("items", F.array().cast("array<string>")))
            .withColumn("__wm_spans", F.coalesce("spans", F.array().cast("array<array<int>>")))
            .withColumn("__wm_hit", cover).drop("__wm_row", "items", "spans"))


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, keep_spans: bool = False,
                 block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every column of ``docs`` and n_words, n_hit, items (sorted), spans (word ranges, if ``keep_spans``).

    NULL or wordless documents have no words and no hits; NULL or wordless items have no windows; items with the same
    text, and repeated rows, all count. A NULL item id is the empty string. An empty table gives no hits.
    Columns of ``docs`` named like a result column are replaced by the result.
    """
    tagged = _tag(docs, benchmark, text, item, item_text, window, keep_spans, block_bytes, table_bytes)
    names = ["n_words", "n_hit", "items", "spans"]
    return tagged.select(*[F.col(f"__wm_c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in names],
                         *[F.col(m).alias(c) for m, c in zip(MADE, names, strict=True)])


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """The contamination rule: at least one word in twenty inside benchmark windows."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without contamination, with their own columns. NULL, empty and wordless texts stay, repeated rows are
    judged alike, very long texts are searched whole; empty tables and columns with any names pass."""
    tagged = _tag(docs, benchmark, text, "item_id", "text", window, False, BLOCK_BYTES, TABLE_BYTES)
    return tagged.where(~is_contaminated("__wm_words", "__wm_hit")).select(
        *[F.col(f"__wm_c{k}").alias(c) for k, c in enumerate(docs.columns)])
