"""Records of delimited text whose quoted fields may hold line breaks, found in parallel.

A file is read as lines by Spark's splittable text scan, so a large file is read by as many tasks as it has splits. Whether a line break
ends a record depends on the quotes before it, back to the file's first byte. That is settled in three steps:

1. every split is summarised by its state map: how it ends if it is entered outside, or inside, a quoted field (one row a split);
2. a prefix scan over each file's split rows composes the maps and gives every split its true entry state, and, where a record
   runs across splits, the split in which it began;
3. the lines are put together to records, each split on its own. Only the pieces of records that cross a split border are shuffled.

A quote opens a field at the field's start only; inside a field, a doubled quote (or one after the escape character) is text. Lines
end with ``\\n``; a ``\\r`` before it is dropped at a record's end and kept inside quotes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLITS_SENT = 1_000_000  # rows of the split table that are broadcast (some 40 bytes each); beyond, lines are shuffled to them


@dataclass(frozen=True)
class Dialect:
    delim: str = ","
    quote: str = '"'
    escape: str | None = None


OUTSIDE, INSIDE, CLOSED, PLAIN = range(4)  # before a field's first character, in quotes, behind a closing quote, in an unquoted field


def ends_inside(line: str, inside: bool, d: Dialect) -> bool:
    """Whether a line that is entered inside (or outside) a quoted field ends inside one."""
    if d.escape and d.escape != d.quote:
        line = line.replace(d.escape * 2, "..").replace(d.escape + d.quote, "..")
    parts = line.split(d.quote)
    state = INSIDE if inside else OUTSIDE
    for k, before in enumerate(parts[:-1]):  # a quote follows each of them
        if state == INSIDE:
            state = CLOSED
        elif (state == CLOSED and not before) or before.endswith(d.delim) or (k == 0 and not before):
            state = INSIDE
        else:
            state = PLAIN
    return state == INSIDE


def lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", skip: int = 0) -> DataFrame:
    """(file, start, id, value): lines with their file and split, ids rising inside a split. The first ``skip`` lines of files are left out."""
    if encoding.upper().replace("-", "") == "UTF8":
        raw = spark.read.text(path, lineSep="\n")
    else:  # the text reader knows UTF-8 only: other encodings come as one uncut CSV field per line
        raw = spark.read.option("encoding", encoding).option("sep", "\x00").option("quote", "").schema("value STRING").csv(path)
    raw = raw.select(F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("start"),
                     F.monotonically_increasing_id().alias("id"), "value")
    if not skip:
        return raw
    # a line's number in its file: its place in the split and the lines of the splits before (one row a split)
    splits = raw.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = splits.select("file", "start", "first", before.alias("before")).where(F.col("before") < skip)
    numbered = raw.join(F.broadcast(heads), ["file", "start"], "left")  # at most ``skip`` splits of each file
    kept = numbered.where(F.col("first").isNull() | (F.col("before") + F.col("id") - F.col("first") >= skip))
    return kept.select("file", "start", "id", "value")


def _runs(batch):
    """(file, start, first row, last row + 1) of the stretches of one split."""
    file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    return [(int(file[s]), int(start[s]), s, e) for s, e in zip(edges[:-1], edges[1:], strict=True) if e > s]


MAPS = "file long, start long, out_to boolean, in_to boolean, opens boolean, closes boolean"


def _state_maps(d: Dialect):
    """One row a split: how it ends entered outside and inside; whether some line ends inside if entered outside (opens), or
    outside if entered inside (closes). Lines without a quote arrive as NULL: they change nothing."""

    def row(key, m):
        return pa.RecordBatch.from_pylist([dict(zip(["file", "start", "out_to", "in_to", "opens", "closes"], (*key, *m), strict=True))],
                                          schema=pa.schema([("file", pa.int64()), ("start", pa.int64()), ("out_to", pa.bool_()),
                                                            ("in_to", pa.bool_()), ("opens", pa.bool_()), ("closes", pa.bool_())]))

    def run(batches):
        key, m = None, None
        for b in batches:
            for file, start, s, e in _runs(b):
                if (file, start) != key:
                    if key:
                        yield row(key, m)
                    key, m = (file, start), [False, True, False, False]
                for line in b.column("value").slice(s, e - s).drop_null().to_pylist():
                    m[0], m[1] = ends_inside(line, m[0], d), ends_inside(line, m[1], d)
                    m[2] |= m[0]
                    m[3] |= not m[1]
        if key:
            yield row(key, m)

    return run


def split_states(raw: DataFrame, d: Dialect) -> DataFrame:
    """(file, start, head, inside, of, leaves, opens): whether a split is its file's first, its entry state, where the record open at its
    entry began, and whether it is left inside one. Composition of state maps: the last constant map decides, and the swaps since."""
    seen = raw.select("file", "start", F.when(F.col("value").contains(d.quote), F.col("value")).alias("value"))
    maps = seen.mapInArrow(_state_maps(d), MAPS)
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swap, fixed = F.col("out_to") & ~F.col("in_to"), F.col("out_to") == F.col("in_to")
    upto = maps.withColumn("swaps", F.sum(swap.cast("int")).over(order)).withColumn(
        "last", F.when(fixed, F.struct(F.col("out_to").cast("int").alias("to"), F.col("swaps").alias("at"))))
    said = F.last("last", True).over(before)
    swaps = F.coalesce(F.lag("swaps").over(order), F.lit(0))
    entered = upto.withColumn("inside", (F.coalesce(said["to"], F.lit(0)) + swaps - F.coalesce(said["at"], F.lit(0))) % 2 == 1)
    leaves = F.when(F.col("inside"), F.col("in_to")).otherwise(F.col("out_to"))
    began = F.when(leaves & (~F.col("inside") | F.col("closes")), F.col("start"))
    return entered.withColumn("leaves", leaves).withColumn("began", began).select(
        "file", "start", F.lag("start").over(order).isNull().alias("head"), "inside", F.when(F.col("inside"), F.last("began", True).over(before)).alias("of"), "leaves", "opens")


PARTS = "file long, of long, seq long, first boolean, value string"


def _assemble(d: Dialect, pieces: bool):
    """Whole records (``pieces`` false: of is NULL) or the pieces of those that cross split borders."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()))], ["file", "of", "seq", "first", "value"])

    def run(batches):
        key, inside, held, of, first = None, False, [], None, False

        def left():  # what a split ends with inside a record
            return [(key[0], key[1] if of is None else of, key[1], first, "\n".join(held))] if pieces and held else []

        for b in batches:
            value, out = b.column("value"), []
            quoted = pc.match_substring(value, d.quote).to_numpy(zero_copy_only=False)
            for file, start, s, e in _runs(b):
                if (file, start) != key:
                    out += left() if key else []
                    key, inside, held = (file, start), b.column("inside")[s].as_py(), []
                    of, first = b.column("of")[s].as_py(), b.column("head")[s].as_py()  # of: the open record began in an earlier split
                at = s
                for i in [*(np.flatnonzero(quoted[s:e]) + s).tolist(), e]:
                    if i > at and inside:  # no quote: the open record goes on
                        held += value.slice(at, i - at).to_pylist()
                    elif i > at:  # each line is a record
                        if not pieces:
                            plain = value.slice(at, i - at)
                            n = len(plain)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, file)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                                 pa.array([first, *[False] * (n - 1)]), plain], ["file", "of", "seq", "first", "value"])
                        first = False
                    at = i + 1
                    if i == e:
                        break
                    line = value[i].as_py()
                    held.append(line)
                    inside = ends_inside(line, inside, d)
                    if not inside:
                        if of is None and not pieces:
                            out.append((file, None, None, first, "\n".join(held)))
                        elif of is not None and pieces:
                            out.append((file, of, start, first, "\n".join(held)))
                        held, of, first = [], None, False
            if out:
                yield batch(out)
        if key and (rest := left()):
            yield batch(rest)

    return run


def records(raw: DataFrame, splits: DataFrame, d: Dialect) -> DataFrame:
    """(value, first): one row a record; first: it is its file's first one. ``splits``: a written table of ``split_states``."""
    n = splits.count()
    state = splits.select("file", "start", "head", "inside", "of", "leaves")

    def joined(of):
        if n <= SPLITS_SENT:
            return raw.join(F.broadcast(of), ["file", "start"])
        return raw.join(of, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "id")

    take = ["file", "start", "value", "head", "inside", "of"]
    whole = joined(state).select(*take).mapInArrow(_assemble(d, False), PARTS).select("value", "first")
    crossing = joined(state.where("inside OR leaves")).select(*take).mapInArrow(_assemble(d, True), PARTS)
    put = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "\n")
    across = crossing.groupBy("file", "of").agg(put.alias("value"), F.max("first").alias("first")).select("value", "first")
    both = whole.unionByName(across)
    return both.withColumn("value", F.regexp_replace("value", "\r$", "")).where("trim(value) <> ''")
