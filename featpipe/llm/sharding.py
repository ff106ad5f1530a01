"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

The unit that is placed is a group of equal texts. Each group goes to the shard where the dot product of
its (bytes, tokens, rows) vector with the shard's residual capacity is highest, large groups first.

* A group above ``max_share`` of a shard's capacity in any dimension is split by a hash of the row key into pieces of about
  1/``PIECES`` of a capacity (otherwise no balance exists when one text makes up a third of all rows). At most
  3 * shards / max_share groups are that large.
* Groups above 1/``HEAVY`` of a capacity are packed first, on the driver: at most 3 * HEAVY * shards of them can exist.
* All other groups are dealt by hash into blocks of about ``block_groups``; each block is packed in its own task against
  its part of the capacity the heavy groups left. Blocks rotate the order of shards, so that what one block leaves
  uneven does not add up with the next one's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featpipe.llm.common import WORD, stored

HEAVY = 64
PIECES = 16
ROW_BYTES = 16  # what a row costs besides its text
DIMS = ["bytes", "tokens", "rows"]
WEIGHTS = np.array([3.0, 1.0, 1.0])  # of the dimensions in the dot product: sizes matter most


def pack(items: np.ndarray, residual: np.ndarray, cap: np.ndarray, turn: int = 0) -> np.ndarray:
    """Shards for items (n x 3, placed in this order); ``residual`` (shards x 3) is used up in place."""
    shards, cap = len(residual), cap / np.sqrt(WEIGHTS)
    order = (np.arange(shards) + turn) % shards
    left = residual[order] / cap
    size = items / cap
    out = np.empty(len(items), np.int32)
    for i, v in enumerate(size):
        s = int(np.argmax(left @ v))
        left[s] -= v
        out[i] = order[s]
    residual[order] = left * cap
    return out


def _large_first(pdf: pd.DataFrame, cap: np.ndarray) -> pd.DataFrame:
    share = (pdf[DIMS].to_numpy(float) / cap).max(1)
    return pdf.iloc[np.lexsort((pdf["piece"], pdf["k"], -share))]


def assign_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", max_share: float = 0.5,
                  block_groups: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: the key, size, text_crc32, tokens, shard (0 to shards - 1) and slot (gapless from 0).

    A NULL text counts as the empty text (size 16, one group with it). NULL keys, repeated keys and repeated rows are
    ordinary rows. An empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = stored(docs.select(
        F.col(f"`{key}`").alias("id"), F.unhex(F.md5(t)).alias("k"), (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("n_tok"), F.crc32(t).alias("crc")), "shard-rows")
    total = rows.agg(F.sum("size"), F.sum("n_tok"), F.count("*")).first()
    cap = np.maximum(np.array([float(x or 0) for x in total]) / shards, 1e-9)
    share = F.greatest(*[F.col(d) / float(c) for d, c in zip(DIMS, cap, strict=True)])

    def sums(df, *by):
        return df.groupBy(*by).agg(F.sum("size").alias("bytes"), F.sum("n_tok").alias("tokens"), F.count("*").alias("rows"))

    # at most 3 * shards / max_share groups, so a broadcast is safe
    split = sums(rows, "k").where(share > max_share).select("k", F.ceil(share * PIECES).cast("int").alias("pieces"))
    rows = rows.join(F.broadcast(split), "k", "left").withColumn(
        "piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int"))
    groups = stored(sums(rows, "k", "piece"), "shard-groups")

    residual = np.tile(cap, (shards, 1))
    heavy = groups.where(share > 1 / HEAVY).toPandas()  # at most 3 * HEAVY * shards rows, pieces included
    heavy["k"] = heavy["k"].map(bytes)
    heavy = _large_first(heavy, cap)
    heavy["shard"] = pack(heavy[DIMS].to_numpy(float), residual, cap)
    light = groups.where(share <= 1 / HEAVY)
    blocks = max(1, -(-light.count() // block_groups))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        pdf = _large_first(pdf, cap)
        return pdf[["k", "piece"]].assign(shard=pack(pdf[DIMS].to_numpy(float), residual / blocks, cap, block * 7))

    placed = light.withColumn("block", F.pmod(F.xxhash64("k", "piece"), F.lit(blocks)).cast("int")).groupBy(
        "block").applyInPandas(place, "k binary, piece int, shard int")
    fixed = spark.createDataFrame(
        [(r.k, int(r.piece), int(r.shard)) for r in heavy.itertuples()], "k binary, piece int, shard int")
    return _slots(rows.join(placed.unionByName(fixed), ["k", "piece"]), total[2] or 0).select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("n_tok").alias("tokens"), "shard", "slot")


def _slots(rows: DataFrame, n: int, chunk_rows: int = 100_000) -> DataFrame:
    """Number each shard's rows from 0 without sorting a shard in one task: ranks in hashed chunks plus offsets."""
    chunks = max(1, -(-n // chunk_rows))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "k"), F.lit(chunks)).cast("int"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "k")) - 1)
    before = rows.groupBy("shard", "chunk").count().select(
        "shard", "chunk", (F.sum("count").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("count")).alias("before"))
    return ranked.join(before, ["shard", "chunk"]).withColumn("slot", (F.col("before") + F.col("r")).cast("long"))


def write_shards(docs: DataFrame, plan: DataFrame, path: str, key: str = "doc_id", files: int = 4) -> None:
    """Write ``docs`` into one folder per shard (``files`` files each), by a plan whose key is unique."""
    out = docs.join(plan.select(key, "shard", "slot"), key)
    out.repartition(F.col("shard"), F.pmod(F.col("slot"), F.lit(files))).write.partitionBy("shard").parquet(path)
