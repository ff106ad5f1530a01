"""Helpers shared by the training-data operators: table access, scratch tables, word tokens and packed rows."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featpipe.session import checkpoint_root

# fixed values: the white space that separates words, A-Z folding is ASCII only
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader only (the folder may be in a remote store)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder of this run under the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_root(spark)}/llm/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that neither filters nor later projections compute them again."""
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums and products of hashes spread over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lowered words of all texts in a row, and each text's word count.

    Each distinct word of the call is hashed once. NULL has no words.
    """
    try:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.string())))
    except (UnicodeError, pa.ArrowException):  # lone surrogates, or more than Arrow's lists take
        words = [split_words(t) for t in texts]
        return hashed([w for ws in words for w in ws]), np.array([len(ws) for ws in words], np.int64)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    codes, known = words.indices.to_numpy(zero_copy_only=False), words.dictionary.cast(pa.binary()).to_pylist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))[codes]
    if b"" in known:  # before and behind leading and trailing white space
        word = codes != known.index(b"")
        of = np.repeat(np.arange(len(counts)), counts)
        return h[word], np.bincount(of[word], minlength=len(counts)).astype(np.int64)
    return h, counts


def split_words(text: str | None) -> list[bytes]:
    """The A-Z-lowered words of a text. NULL has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once."""
    known = Numbered()
    codes = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))[codes]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n``-word shingles of one text; with fewer words, the whole sequence as one."""
    k = len(words)
    if k == 0:
        return words
    m = min(n, k)
    h = np.zeros(k - m + 1, np.uint64)
    for i in range(m):
        h = mix(h * M1 + words[i : k - m + 1 + i] + np.uint64(m))
    return h


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def buckets(spark: SparkSession) -> int:
    """How many parts packed rows are dealt into: as many as the session's shuffles have."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and what one task needed at its peak should not stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to do
        pass


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that edges (a, b) touch; the label is the smallest node of its component.

    Alternating large-star and small-star steps; each round's edges are written to the shared folder. Hubs are reduced by
    partial minimum before any shuffle, and joins on them are left to Spark's splitting of skewed joins.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = stored(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
