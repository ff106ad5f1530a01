"""N-gram Jaccard join by signature trees: groups of documents linked by shingle sets of high similarity.

Which sets must meet: under any fixed order of all shingles, two sets of Jaccard similarity t or more share one
of their first ``n - ceil(t * n) + 1`` shingles. The order used takes a third of all shingles (by hash) first, rarest first,
so their document counts are gathered: per chunk of texts, summed per shingle. A shingle that only one set has links nothing,
so most sets send nothing on. Sets that share a prefix shingle and whose sizes fit are chained into *blocks*.

What is similar: a block's sets lie in tiles, and a signature tree is built over each tile. Its leaves are sets with a token
bitmap; inner nodes hold the OR of their bitmaps (and the bits all have in common) and a size range. A dual
traversal descends into pairs of nodes and leaves out those whose maximum possible overlap is too small, or whose
sets are all known to be in one group; the pairs of leaves that stay are compared exactly. A block above a tile's size is split:
tiles are linked inside, then through one representative of each group found, and only sets outside their block's
largest group meet all tiles once more. No step lists the pairs of a group of copies.

Sets are named by a 64-bit hash, so that equal sets are one set throughout; shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featpipe.llm.common import as_long, buckets, components, give_back, mix, shingle_hashes, stored, word_hashes

SLICE = 2 << 20  # characters of a chunk
TILE = 2048  # sets of a tile
BITS = 512


def needed(size, percent: int):
    """Shingles a partner of a set must share with it, at least."""
    return -(-size * percent // 100)


def set_name(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles)) * np.uint64(0x9E3779B97F4A7C15)
    return int(as_long(mix(np.array([total], np.uint64)))[0])


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    return [np.unique(shingle_hashes(words[e - c : e], n)) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """Rows of a partition as lists per column, in parts of about SLICE characters of the last column."""
    held, size = [[] for _ in columns], 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            for h, v in zip(held, row, strict=True):
                h.append(v)
            size += len(row[-1] or "")
            if size >= SLICE:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held


CHUNK = ("chunk long, docs array<long>, marks array<long>, sizes array<int>, names array<long>, set_names binary, set_sizes binary, "
         "front_lengths binary, front binary, back_lengths binary, back binary")


def _chunk(n: int, percent: int, part: int):
    def run(batches):
        for ids, marks, texts in _pieces(batches, ["id", "mark", "text"]):
            sets = shingle_sets(texts, n)
            names = [set_name(s) if len(s) else 0 for s in sets]
            own = {name: s for name, s in zip(names, sets, strict=True) if len(s)}
            front, back = [], []
            for s in own.values():
                first = s % np.uint64(part) == 0
                front.append(s[first])
                missing = len(s) - needed(len(s), percent) + 1 - len(front[-1])
                back.append(s[~first][:missing] if missing > 0 else s[:0])
            lengths = lambda xs: np.array([len(x) for x in xs], np.int32).tobytes()
            joined = lambda xs: (np.concatenate(xs) if xs else np.empty(0, np.uint64)).tobytes()
            key = int(as_long(mix(as_long(np.array(names, np.int64)).view(np.uint64) + np.arange(len(ids), dtype=np.uint64))).sum())
            yield pa.RecordBatch.from_pylist([{
                "chunk": key, "docs": ids, "marks": marks, "sizes": [len(s) for s in sets], "names": names,
                "set_names": np.array(list(own), np.int64).tobytes(), "set_sizes": lengths(own.values()),
                "front_lengths": lengths(front), "front": joined(front), "back_lengths": lengths(back), "back": joined(back)}],
                schema=ARROW_CHUNK)
        give_back()

    return run


ARROW_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("docs", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("names", pa.list_(pa.int64())),
    ("set_names", pa.binary()), ("set_sizes", pa.binary()), ("front_lengths", pa.binary()), ("front", pa.binary()),
    ("back_lengths", pa.binary()), ("back", pa.binary())])


def _dealt(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of sorted keys, by bucket."""
    b = ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    for idx in np.split(order, cuts):
        if len(idx):
            yield int(b[idx[0]]), idx


def _ask(parts: int):
    def run(batches):
        for batch in batches:
            for chunk, front in zip(batch.column("chunk").to_pylist(), batch.column("front").to_pylist(), strict=True):
                tokens, counts = np.unique(np.frombuffer(front, np.uint64), return_counts=True)
                rows = [(b, chunk, tokens[i].tobytes(), counts[i].astype(np.uint32).tobytes()) for b, i in _dealt(tokens, parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.binary(), pa.binary()])],
                    ["bucket", "chunk", "tokens", "counts"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """To every chunk: its shingles that more than one set has, and how many."""
    tokens = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
    uniq, codes = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.zeros(len(uniq), np.int64)
    np.add.at(total, codes, np.concatenate([np.frombuffer(c, np.uint32) for c in pdf["counts"]]))
    out, at = [], 0
    for chunk, t in zip(pdf["chunk"], tokens, strict=True):
        n = total[codes[at : at + len(t)]]
        at += len(t)
        many = n > 1
        out.append((chunk, t[many].tobytes(), n[many].tobytes()))
    return pd.DataFrame(out, columns=["chunk", "tokens", "counts"])


def _spread(values: bytes, lengths: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(values, np.uint64), np.cumsum(np.frombuffer(lengths, np.int32))[:-1])


def _fits(small, large, percent: int):
    return small * 100 >= large * percent


def _chains(percent: int, parts: int):
    """Per chunk: edges between sets that meet, and each prefix shingle's ranges of fitting sizes, dealt by shingle."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names, sizes = np.frombuffer(row["set_names"], np.int64), np.frombuffer(row["set_sizes"], np.int32)
                if not len(names):
                    continue
                got = row["answers"] or []
                known = np.concatenate([np.frombuffer(a["tokens"], np.uint64) for a in got] or [np.empty(0, np.uint64)])
                count = np.concatenate([np.frombuffer(a["counts"], np.int64) for a in got] or [np.empty(0, np.int64)])
                order = np.argsort(known)
                known, count = known[order], count[order]
                tok, who = [], []
                fronts, backs = _spread(row["front"], row["front_lengths"]), _spread(row["back"], row["back_lengths"])
                for k, (f, b) in enumerate(zip(fronts, backs, strict=True)):
                    n = int(sizes[k])
                    room = n - int(needed(n, percent)) + 1
                    if len(known) and len(f):
                        i = np.minimum(np.searchsorted(known, f), len(known) - 1)
                        df = np.where(known[i] == f, count[i], 1)
                    else:
                        df = np.ones(len(f), np.int64)
                    room -= int((df == 1).sum())
                    if room > 0:
                        shared = f[df > 1][np.lexsort((f[df > 1], df[df > 1]))][:room]
                        for t in (shared, b[: max(0, room - len(shared))]):
                            if len(t):
                                tok.append(t)
                                who.append(np.full(len(t), k))
                if not tok:
                    continue
                tok, who = np.concatenate(tok), np.concatenate(who)
                size = sizes[who].astype(np.int64)
                order = np.lexsort((names[who], size, tok))
                tok, who, size = tok[order], who[order], size[order]
                meets = (tok[1:] == tok[:-1]) & _fits(size[:-1], size[1:], percent)
                name = names[who]
                starts = np.append(True, ~meets)
                ends = np.append(~meets, True)
                t, low, high, rep = tok[starts], size[starts], size[ends], name[starts]
                # a run of fitting sizes is one group: all its sets join the first one, so that paths stay short
                inner = ~starts
                rows = [(-1, name[inner].tobytes(), rep[np.cumsum(starts) - 1][inner].tobytes(), b"", b"")]
                rows += [(b, t[i].tobytes(), low[i].tobytes(), high[i].tobytes(), rep[i].tobytes()) for b, i in _dealt(t, parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], pa.int32() if k == 0 else pa.binary()) for k in range(5)],
                    ["bucket", "x", "y", "high", "rep"])
        give_back()

    return run


def _meet(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tok = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["x"]])
        low, high, rep = (np.concatenate([np.frombuffer(x, np.int64) for x in pdf[c]]) for c in ("y", "high", "rep"))
        order = np.lexsort((low, tok))
        tok, low, high, rep = tok[order], low[order], high[order], rep[order]
        same = tok[1:] == tok[:-1]
        # the farthest size so far within a shingle: ranks make the running maximum start afresh at each
        group = np.cumsum(np.append(0, ~same)).astype(np.int64)
        reach = np.maximum.accumulate(group * (1 << 40) + high) - group * (1 << 40)
        on = same & _fits(reach[:-1], low[1:], percent)
        starts = np.append(True, ~on)
        edges = np.stack([rep, rep[starts][np.cumsum(starts) - 1]], 1)
        edges = np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return run


class Tree:
    """A signature tree over sets (sorted arrays of shingle hashes), smallest first, four children a node."""

    def __init__(self, sets: list[np.ndarray], fan: int = 4):
        bits = np.zeros((len(sets), BITS // 64), np.uint64)
        for i, s in enumerate(sets):
            at = mix(s) % np.uint64(BITS)
            np.bitwise_or.at(bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        size = np.array([len(s) for s in sets], np.int64)
        self.levels = [(bits, bits, size, size)]
        self.fan = fan
        while len(self.levels[-1][2]) > 1:
            union, common, low, high = self.levels[-1]
            cuts = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(union, cuts), np.bitwise_and.reduceat(common, cuts),
                                np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets below nodes i and j (pairwise) may reach the similarity."""
        union, common, low, high = self.levels[level]
        lost = lambda x, y: np.bitwise_count(common[x] & ~union[y]).sum(1).astype(np.int64)
        most = np.minimum(high[i] - lost(i, j), high[j] - lost(j, i))
        least_total = low[i] + low[j]  # overlap >= t * union size, union size = total - overlap
        return (most * (100 + percent) >= percent * least_total) & _fits(high[i], low[j], percent) & _fits(high[j], low[i], percent)


class Groups:
    def __init__(self, labels: np.ndarray):
        _, self.up = np.unique(labels, return_inverse=True)
        first = {}
        self.up = np.array([first.setdefault(int(g), i) for i, g in enumerate(self.up)], np.int64)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def flat(self) -> np.ndarray:
        while not (self.up == self.up[self.up]).all():
            self.up = self.up[self.up]
        return self.up


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if not _fits(len(x), len(y), percent):
        return False
    i = np.searchsorted(y, x)
    i[i == len(y)] = 0
    both = int((y[i] == x).sum())
    return both * 100 >= percent * (len(x) + len(y) - both)


def link(sets: list[np.ndarray], labels: np.ndarray, percent: int) -> np.ndarray:
    """Group index (of the first member) of each set; ``sets`` sorted by size; equal ``labels`` are known links."""
    n = len(sets)
    groups = Groups(labels)
    for i in range(n - 1):  # neighbours first: large groups of near copies close early
        if groups.find(i) != groups.find(i + 1) and similar(sets[i], sets[i + 1], percent):
            groups.join(i, i + 1)
    tree = Tree(sets)
    top = len(tree.levels) - 1

    def uniform(level: int) -> np.ndarray:  # the group all sets below a node are in, else -1
        g = groups.flat()
        for _ in range(level):
            cuts = np.arange(0, len(g), tree.fan)
            low, high = np.minimum.reduceat(g, cuts), np.maximum.reduceat(g, cuts)
            g = np.where(low == high, low, -1)
        return g

    i = j = np.zeros(1, np.int64)
    for level in range(top, 0, -1):
        below = len(tree.levels[level - 1][2])
        a = (i[:, None] * tree.fan + np.arange(tree.fan)).repeat(tree.fan, 1).ravel()
        b = np.tile(j[:, None] * tree.fan + np.arange(tree.fan), (1, tree.fan)).ravel()
        ok = (a < below) & (b < below) & (a <= b)
        a, b = a[ok], b[ok]
        g = uniform(level - 1)
        ok = (g[a] < 0) | (g[a] != g[b])
        if level == 1:
            ok &= a != b
        a, b = a[ok], b[ok]
        ok = np.concatenate([tree.possible(level - 1, x, y, percent) for x, y in zip(
            np.array_split(a, -(-len(a) // 65536)), np.array_split(b, -(-len(b) // 65536)), strict=True)]) if len(a) else np.empty(0, bool)
        i, j = a[ok], b[ok]
    if top:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if groups.find(x) != groups.find(y) and similar(sets[x], sets[y], percent):
                groups.join(x, y)
    return groups.flat()


def _tile(percent: int):
    """Link one tile's sets; rows of known groups share a label. Gives (a, b) = (set, first set of its group)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("name").sort_values(["size", "name"])
        names = pdf["name"].to_numpy()
        found = names[link([np.frombuffer(s, np.uint64) for s in pdf["tokens"]], pdf["label"].to_numpy(), percent)]
        on = found != names
        return pd.DataFrame({"a": names[on], "b": found[on]})

    return run


def _fetch(n: int):
    def run(batches):
        for names, blocks, texts in _pieces(batches, ["name", "block", "text"]):
            rows = [(b, name, len(s), s.tobytes()) for name, b, s in zip(names, blocks, shingle_sets(texts, n), strict=True)
                    if len(s) and set_name(s) == name]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.binary()])],
                ["block", "name", "size", "tokens"])
        give_back()

    return run


def _link_blocks(sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Edges (a, b) that connect exactly the similar sets of each block. ``sets``: block, name, size, tokens."""
    edge = "a long, b long"
    many = sets.groupBy("block").agg(F.count("*").alias("in_block"))
    few = sets.join(many, "block").withColumn("label", F.col("name")).withColumn(
        # a large block is dealt by size (ranges within which sizes fit), and those by hash
        "range", F.when(F.col("in_block") <= tile, 0).otherwise(F.floor(F.log(F.col("size").cast("double")) * 10)))
    count = few.groupBy("block", "range").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = stored(few.join(count, ["block", "range"]).withColumn(
        "part", F.pmod(F.xxhash64("name"), F.col("parts"))).drop("parts"), "jaccard-tiles")
    inside = stored(tiles.groupBy("block", "range", "part").applyInPandas(_tile(percent), edge), "jaccard-links")
    large = tiles.where(F.col("in_block") > tile)
    if large.isEmpty():
        return inside

    def labelled(edges):
        found = components(edges)
        return large.drop("label").join(found, large["name"] == found["node"], "left").drop("node").withColumn(
            "label", F.coalesce("label", "name"))

    now = labelled(inside)
    # one set of each group of each tile stands for it
    reps = now.groupBy("block", "range", "part", "label").agg(F.min_by(F.struct("name", "size", "tokens"), "name").alias("r")).select(
        "block", "label", "r.*")
    parts = reps.groupBy("block").agg(F.ceil(F.count("*") / tile).alias("parts"))
    reps = reps.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")))
    inside = inside.unionByName(stored(reps.groupBy("block", "part").applyInPandas(_tile(percent), edge), "jaccard-links"))
    now = stored(labelled(inside), "jaccard-labels")
    # whoever is still outside its block's largest group meets every tile of the block that its size fits
    groups = now.groupBy("block", "label").count()
    main = groups.groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = now.join(main, "block").where("label <> main").drop("main")
    n = rest.groupBy("block", "range").agg(F.ceil(F.count("*") / tile).alias("rest_parts"))
    rest = rest.join(n, ["block", "range"]).withColumn(
        "rest_part", F.pmod(F.xxhash64("name", F.lit(1)), F.col("rest_parts"))).withColumnRenamed("range", "rest_range").drop("part")
    spans = now.groupBy("block", "range", "part").agg(F.min("size").alias("t_low"), F.max("size").alias("t_high"))
    mine = rest.groupBy("block", "rest_range", "rest_part").agg(F.min("size").alias("r_low"), F.max("size").alias("r_high"))
    pairs = stored(mine.join(spans, "block").where(
        (F.col("r_high") * 100 >= F.col("t_low") * percent) & (F.col("t_high") * 100 >= F.col("r_low") * percent)).select(
        "block", "rest_range", "rest_part", "range", "part"), "jaccard-pairs")
    key = ["block", "rest_range", "rest_part", "range", "part"]
    take = [*key, "name", "size", "tokens", "label"]
    met = rest.join(pairs, ["block", "rest_range", "rest_part"]).select(*take).unionByName(
        now.join(pairs, ["block", "range", "part"]).select(*take))
    return inside.unionByName(met.groupBy(*key).applyInPandas(_tile(percent), edge))


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", part: int = 3,
                   tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest key reachable by links of similarity percent / 100 or more).

    A text with fewer than ``n`` words has its whole word sequence as its one shingle; NULL, empty and wordless texts have
    none, link with nothing and are their own component. Rows with a NULL key take part; they get the smallest key of
    their group, if it has one. Repeated rows are rows. An empty table gives an empty table.
    """
    return _groups(docs, n, percent, key, text, part, tile).select(
        F.col("id").alias(key), F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def _mark(text: str):
    """Tells apart rows that share a key: a hash of the text."""
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def _groups(docs: DataFrame, n: int, percent: int, key: str, text: str, part: int, tile: int) -> DataFrame:
    """id, mark, size and label of every row, and the smallest key of its label."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), _mark(text).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    parts = buckets(spark)
    chunks = stored(own.mapInArrow(_chunk(n, percent, part), CHUNK), "jaccard-chunks")
    asked = chunks.select("chunk", "front").mapInArrow(_ask(parts), "bucket int, chunk long, tokens binary, counts binary")
    told = asked.groupBy("bucket").applyInPandas(_answer, "chunk long, tokens binary, counts binary")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("tokens", "counts")).alias("answers"))
    chains = stored(chunks.drop("docs", "marks", "sizes", "names").join(told, "chunk", "left").drop("chunk").mapInArrow(
        _chains(percent, parts), "bucket int, x binary, y binary, high binary, rep binary"), "jaccard-chains")

    def unpack(batches):
        for b in batches:
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], ["a", "b"])

    edges = chains.where("bucket < 0").select("x", "y").mapInArrow(unpack, "a long, b long").unionByName(
        chains.where("bucket >= 0").groupBy("bucket").applyInPandas(_meet(percent), "a long, b long"))
    blocks = stored(components(edges), "jaccard-blocks")
    rows = chunks.select(F.explode(F.arrays_zip("docs", "marks", "sizes", "names")).alias("r")).select(
        F.col("r.docs").alias("id"), F.col("r.marks").alias("mark"), F.col("r.sizes").alias("size"), F.col("r.names").alias("name"))
    # a key alone may be that of many rows (NULL above all)
    holders = rows.where("size > 0").groupBy("name").agg(F.min(F.struct("id", "mark")).alias("r")).join(
        blocks.select(F.col("node").alias("name"), F.col("label").alias("block")), "name").select("name", "block", "r.*")
    sets = own.withColumnsRenamed({"id": "own_id", "mark": "own_mark"}).join(
        holders, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark"))).select(
        "name", "block", "text").mapInArrow(_fetch(n), "block long, name long, size int, tokens binary")
    labels = stored(components(_link_blocks(stored(sets, "jaccard-sets"), percent, tile)), "jaccard-groups")
    tagged = rows.join(labels, rows["name"] == labels["node"], "left").withColumn("label", F.coalesce("label", "name"))
    least = tagged.where("size > 0").groupBy("label").agg(F.min("id").alias("least"))
    return tagged.join(least, "label", "left").select("id", "mark", "size", "label", "least")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, part: int = 3,
                      tile: int = TILE) -> DataFrame:
    """One document of each group, and all documents without shingles.

    It is the one with the smallest key; of several texts under that key, the one of the smallest hash. Rows of one key and one
    text are that document's repeated rows and stay or go together. Rows with a NULL key are documents of their own: they
    go where their group has a key, and a group without any keeps one row.
    """
    rows = stored(_groups(docs, n, percent, key, text, part, tile).where("size > 0"), "jaccard-rows")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("f"))
    gone = rows.join(first, "label").where(~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("mark") == F.col("f.mark")))).select(
        F.col("id").alias("__j_key"), F.col("mark").alias("__j_mark")).distinct()
    left = docs.join(gone, F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__j_key")) & (_mark(text) == F.col("__j_mark")), "left_anti")
    many = rows.where("id IS NULL").groupBy(F.col("mark").alias("__j_mark")).count().where("count > 1").select("__j_mark")
    if many.isEmpty():
        return left
    # equal texts without a key: one row of each
    null, again = F.col(f"`{key}`").isNull(), _mark(text) == F.col("__j_mark")
    copies = left.where(null).join(many, again).groupBy("__j_mark").agg(
        F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__j_row")).select("__j_row.*")
    return left.where(~null).unionByName(left.where(null).join(many, again, "left_anti")).unionByName(copies)
