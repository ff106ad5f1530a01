"""LM scoring by a hierarchical Pitman-Yor model (words, contexts of one word).

Every context word has a restaurant; all of them share one parent, the root restaurant, whose base is uniform over the
training vocabulary and one unknown word. Customers are the training tokens; a table opened in a context sends a customer to the
root. Gibbs sweeps reseat the customers of each (context, word) one by one, given all other restaurants as of the sweep
before, and then those of the root. A text's score sums log10 of its tokens' predictive probabilities, averaged over the sweeps
after the burn-in.

How it is spread out:

* Texts are read once, in chunks. A chunk's (context, word) pairs, with the texts they occur in, go packed to *cells* of a
  grid: the context's hash names the row, the word's hash the column, so even a word that makes up a third of all tokens is
  spread over a row and a column of cells.
* *Owners* (by word hash) add up what the cells know of a word: its count, its customers and tables. Cells tell owners their
  sums, owners answer with totals: messages with one entry per word and cell, however often the word occurs.
* Cells keep no state between jobs: they replay the sweeps from the packed pairs and the answers, with seeded draws, so a lost
  executor costs a recomputation and changes nothing.
* The driver sees a handful of sums per sweep.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featpipe.llm.common import Numbered, buckets, give_back, mix

CHUNK = 12 << 20  # characters of a chunk
CELL_CHARS = 9_000_000  # characters of text for every cell
END, START = np.uint64(0x1D0C5E4D), np.uint64(0x57A27)  # fixed values: the text end as a word, the text start as a context
STRENGTH = 1.0  # concentration of all restaurants
EXACT = 64  # customers of one word in one restaurant that are seated singly; beyond, sixteenths of them together


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: ascending hashes as differences, all in byte planes."""
    out = []
    for a in arrays:
        if a.dtype == np.uint64:
            a, kind = np.diff(a, prepend=a[:1] * 0), "sorted"
        elif a.dtype.kind in "iu":
            top = int(a.max()) if len(a) else 0
            a, kind = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64), "int"
        else:
            kind = "float"
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
        out.append((kind, a.dtype.str, len(a), planes.tobytes()))
    return zstandard.compress(pickle.dumps(out, 5), 1)


def expand(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, dtype, n, planes in pickle.loads(zstandard.decompress(data)):
        size = np.dtype(dtype).itemsize
        a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)
        out.append(np.cumsum(a, dtype=np.uint64) if kind == "sorted" else a.astype(np.int64) if kind == "int" else a)
    return out


class Words:
    """The words of one chunk, numbered as they come; each is hashed once."""

    def __init__(self):
        self.known = Numbered()
        self.codes: list[np.ndarray] = []
        self.counts: list[int] = []

    def add(self, text: str | None) -> None:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        self.codes.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.counts.append(len(words))

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending hashes of all words (START and END among them), and the tokens' places among these: every text's
        words, then its end."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.known), np.uint64, len(self.known))
        self.known = Numbered()
        names, place = np.unique(np.append(h, [START, END]), return_inverse=True)
        place = place.astype(np.int32)
        lengths = np.array(self.counts, np.int64) + 1
        token = np.full(int(lengths.sum()), place[-1], np.int32)
        at = 0
        for c in self.codes:
            token[at : at + len(c)] = place[c]
            at += len(c) + 1
        self.codes = []
        return names, token


def _chunks(grid: int):
    """Rows (id, held, text) of a partition -> (cell, packed pairs of one chunk)."""

    def pack(number, ids, held, words):
        n_docs = len(ids)
        lengths = np.array(words.counts, np.int64) + 1
        names, token = words.tokens()
        ends = np.cumsum(lengths) - 1
        start = int(np.searchsorted(names, START))
        context = np.empty_like(token)
        context[1:], context[0] = token[:-1], start
        context[ends[:-1] + 1] = start
        part = (mix(names) % np.uint64(grid)).astype(np.int64)
        # one sort puts the pairs in order of cell, word and context
        n = len(names)
        pair = ((part[context] * grid + part[token]) * n + token) * n + context
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        doc = np.repeat(np.arange(n_docs, dtype=np.int32), lengths)[order]
        del order, token, context
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        runs = np.diff(np.append(starts, len(pair)))
        pair = pair[starts]
        u, pair = pair % n, pair // n
        w, cell = pair % n, pair // n
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        ends = np.append(starts, len(doc))
        out = np.array(held, bool)
        taught = np.add.reduceat((~out[doc]).astype(np.int32), starts)  # training tokens of each pair
        meta = (ids, out, lengths)
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
            us, own = np.unique(u[i:j], return_inverse=True)
            fresh = np.flatnonzero(np.append(True, w[i + 1 : j] != w[i : j - 1]))
            # the pairs apart from the texts they occur in, which only the scoring needs
            yield int(cell[i]), (number, n_docs, meta if k == 0 else None, squeeze(
                names[us], names[w[i:j][fresh]], np.diff(np.append(fresh, j - i)), own, taught[i:j]), squeeze(runs[i:j], doc[ends[i] : ends[j]]))

    def run(rows):
        part = TaskContext.get().partitionId()
        number, ids, held, words, size = part << 24, [], [], Words(), 0
        for key, out, text in rows:
            ids.append(key)
            held.append(out)
            words.add(text)
            size += len(text or "")
            if size >= CHUNK:
                yield from pack(number, ids, held, words)
                give_back()
                number, ids, held, words, size = number + 1, [], [], Words(), 0
        if ids:
            yield from pack(number, ids, held, words)
        del ids, held, words
        give_back()

    return run


class Cell:
    """The pairs of one cell, merged over all chunks; with ``lists``, also the texts in which they occur."""

    def __init__(self, blobs: list, lists: bool = False):
        self.blobs = sorted(blobs, key=lambda b: b[0])
        parts = [expand(b[3]) for b in self.blobs]
        self.us, self.ws = (np.unique(np.concatenate([p[k] for p in parts])) for k in (0, 1))
        pairs = []
        for us, ws, per_word, u, _ in parts:
            w = np.repeat(np.searchsorted(self.ws, ws), per_word)
            pairs.append(w * len(self.us) + np.searchsorted(self.us, us)[u])
        counts = np.concatenate([p[4] for p in parts])
        del parts
        self.cuts = np.cumsum([len(p) for p in pairs])[:-1]
        whole = np.concatenate(pairs)
        del pairs
        order = np.argsort(whole, kind="stable")  # merges the chunks' runs, which are in order already
        whole = whole[order]
        fresh = np.append(True, whole[1:] != whole[:-1])
        every = whole[fresh]
        del whole
        self.c = np.add.reduceat(counts[order], np.flatnonzero(fresh)).astype(np.int64)
        if lists:
            self.code = np.empty(len(order), np.int32)
            self.code[order] = np.cumsum(fresh, dtype=np.int32) - 1
            self.runs = [[x.astype(np.int32) for x in expand(b[4])] for b in self.blobs]
        del order
        self.u, self.w = every % len(self.us), every // len(self.us)
        self.several = np.flatnonzero(self.c > 1)

    def sums(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each context, and customers that each word sends to the root."""
        return (np.bincount(self.u, t, len(self.us)).astype(np.int64), np.bincount(self.w, t, len(self.ws)).astype(np.int64))


def seat(customers: np.ndarray, mass: np.ndarray, slope: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables after seating customers one by one: a new table has weight mass + slope * tables, the others i - discount * tables."""
    order = np.argsort(-customers, kind="stable")
    c, mass, slope = customers[order], mass[order], slope[order]
    t = np.minimum(c, 1).astype(np.float64)
    i = 1
    while len(c) and c[0] > i:
        n = int(np.searchsorted(-c, -i, "left"))  # those with more than i customers
        step = np.minimum(1 if i < EXACT else i // 16, c[:n] - i)
        new = mass[:n] + slope[:n] * t[:n]
        p = new / (new + i - discount * t[:n])
        t[:n] += rng.random(n) < p if i < EXACT else rng.binomial(step, p)
        i += 1 if i < EXACT else i // 16
    out = np.empty(len(c), np.int64)
    out[order] = t
    return out


def _root(c, t, totals, model):
    """Probability of words with c customers at t tables of the root."""
    base = 1 / (model["V"] + 1)
    return (c - model["d0"] * t + (STRENGTH + model["d0"] * totals["tables"]) * base) / (STRENGTH + totals["customers"])


def _sweeps(cell: Cell, number: int, answers: list, models: list, model: dict) -> list[np.ndarray]:
    """Tables of all pairs after each sweep that has an answer (the first: one table each)."""
    t = np.minimum(cell.c, 1)
    out = [t]
    i = cell.several
    for s, (ans, totals) in enumerate(zip(answers, models, strict=True)):
        p = _root(ans["customers"], ans["tables"], totals, model)[cell.w[i]]
        others = ans["context_tables"][cell.u[i]] - t[i]
        rng = np.random.default_rng([number, s, 1])
        t = t.copy()
        t[i] = seat(cell.c[i], (STRENGTH + model["d1"] * others) * p, model["d1"] * p, model["d1"], rng)
        out.append(t)
    return out


def _by_owner(words: np.ndarray, owners: int):
    o = ((words >> np.uint64(7)) % np.uint64(owners)).astype(np.int64)
    order = np.argsort(o, kind="stable")
    return [(int(o[i[0]]), i) for i in np.split(order, np.flatnonzero(np.diff(o[order])) + 1) if len(i)]


def _first_report(owners: int):
    """A cell's words and sums, to their owners."""

    def run(number, blobs):
        cell = Cell(blobs)
        tables, customers = cell.sums(np.minimum(cell.c, 1))
        seen, uni = np.bincount(cell.u, cell.c, len(cell.us)).astype(np.int64), np.bincount(cell.w, cell.c, len(cell.ws)).astype(np.int64)
        out = {}
        for o, i in _by_owner(cell.us, owners):
            out.setdefault(o, [None, None])[0] = squeeze(cell.us[i], seen[i], tables[i])
        for o, i in _by_owner(cell.ws, owners):
            out.setdefault(o, [None, None])[1] = squeeze(cell.ws[i], uni[i], customers[i])
        ones, twos = int((cell.c == 1).sum()), int((cell.c == 2).sum())
        first = True
        for o, (us, ws) in sorted(out.items()):
            yield o, (number, us, ws, (ones, twos) if first else (0, 0))
            first = False

    return run


class Owner:
    """The words of one owner, and where each cell's words stand among them."""

    def __init__(self, reports: list):
        self.reports = sorted(reports, key=lambda r: r[0])
        sides = [[(r[0], expand(r[k])) for r in self.reports if r[k] is not None] for k in (1, 2)]
        empty = np.empty(0, np.uint64)
        self.us, self.ws = (np.unique(np.concatenate([x[1][0] for x in side])) if side else empty for side in sides)
        self.at = [{n: np.searchsorted(names, x[0]) for n, x in side} for names, side in zip((self.us, self.ws), sides, strict=True)]
        self.seen, self.tables = (self._add(sides[0], 0, k) for k in (1, 2))
        self.uni, self.customers = (self._add(sides[1], 1, k) for k in (1, 2))

    def _add(self, side, which, k):
        out = np.zeros(len((self.us, self.ws)[which]), np.int64)
        for n, x in side:
            np.add.at(out, self.at[which][n], x[k])
        return out

    def after(self, changes: list) -> tuple[np.ndarray, np.ndarray]:
        """Tables of contexts and customers of words after a sweep; changes: the cells' additions to the first report."""
        tables, customers = self.tables.copy(), self.customers.copy()
        for n, ui, ud, wi, wd in ((n, *expand(x)) for n, x in changes):
            if len(ui):
                np.add.at(tables, self.at[0][n][ui], ud)
            if len(wi):
                np.add.at(customers, self.at[1][n][wi], wd)
        return tables, customers

    def seated(self, number: int, sweep: int, customers: np.ndarray, model: dict, totals: dict | None) -> np.ndarray:
        """The root's tables of each word: one each at first, else reseated given the sweep before."""
        if totals is None:
            return np.minimum(customers, 1)
        rng = np.random.default_rng([number, sweep, 2])
        base = 1 / (model["V"] + 1)
        n = len(customers)
        return seat(customers, np.full(n, (STRENGTH + model["d0"] * totals["tables"]) * base), np.zeros(n), model["d0"], rng)


def _changes(owners: int, model: dict, totals: list):
    """All sweeps' additions to the first report, to the owners."""

    def run(number, blobs, answers):
        cell = Cell(blobs)
        first = np.minimum(cell.c, 1)
        for sweep, t in enumerate(_sweeps(cell, number, _read(cell, answers, owners), totals, model)[1:], 1):
            rows = {}
            for k, (names, add) in enumerate(zip((cell.us, cell.ws), cell.sums(t - first), strict=True)):
                for o, i in _by_owner(names, owners):
                    on = np.flatnonzero(add[i])
                    rows.setdefault(o, [np.empty(0, np.int64)] * 4)[2 * k : 2 * k + 2] = [on, add[i][on]]
            for o, x in rows.items():
                yield o, (number, sweep, squeeze(*x))

    return run


def _seatings(owner: Owner, number: int, changes: list, model: dict, totals: list):
    """(tables of contexts, customers of words, the root's tables) at first and after each sweep; ``totals`` are those
    known: of every sweep but possibly the last."""
    by: dict = {}
    for n, sweep, data in changes:
        by.setdefault(sweep, []).append((n, data))
    for sweep in range(max([0, *by]) + 1):
        tables, customers = owner.after(by.get(sweep, []))
        yield tables, customers, owner.seated(number, sweep, customers, model, totals[sweep - 1] if sweep else None)


def _answer(owner: Owner, number: int, changes: list, model: dict, totals: list):
    """Per cell: for every sweep so far the totals of its words (contexts: tables and, once, tokens seen; words: customers
    and tables at the root and, once, the count)."""
    for sweep, (tables, customers, root) in enumerate(_seatings(owner, number, changes, model, totals)):
        for r in owner.reports:
            n = r[0]
            u, w = owner.at[0].get(n, np.empty(0, np.int64)), owner.at[1].get(n, np.empty(0, np.int64))
            first = [owner.seen[u], owner.uni[w]] if sweep == 0 else []
            yield n, (sweep, number, squeeze(tables[u], customers[w], root[w], *first))


def _read(cell: Cell, answers: list, owners: int) -> list[dict]:
    """Answers of each sweep, put back into the cell's order of words."""
    u_at, w_at = dict(_by_owner(cell.us, owners)), dict(_by_owner(cell.ws, owners))
    out, by = [], {}
    for a in answers:
        by.setdefault(a[0], []).append(a)
    for sweep in sorted(by):
        one = by[sweep]
        a = {"context_tables": np.zeros(len(cell.us), np.int64), "customers": np.zeros(len(cell.ws), np.int64),
             "tables": np.zeros(len(cell.ws), np.int64), "seen": np.zeros(len(cell.us), np.int64), "uni": np.zeros(len(cell.ws), np.int64)}
        for _, o, data in one:
            x = expand(data)
            ui, wi = u_at.get(o, np.empty(0, np.int64)), w_at.get(o, np.empty(0, np.int64))
            a["context_tables"][ui], a["customers"][wi], a["tables"][wi] = x[0], x[1], x[2]
            if len(x) > 3:
                a["seen"][ui], a["uni"][wi] = x[3], x[4]
        out.append(a)
    return out


def _score(owners: int, model: dict, totals: list, burn_in: int):
    """Per chunk: each text's part of the score, of the base score and of the known tokens."""

    def run(number, blobs, answers):
        cell = Cell(blobs, lists=True)
        got = _read(cell, answers, owners)
        # the last answer's seating is the last sweep's own; sweep s drew from answer s - 1
        tables = _sweeps(cell, number, got[:-1], totals[:-1], model)
        seen, uni = got[0]["seen"][cell.u], got[0]["uni"][cell.w]
        p = np.zeros(len(cell.c))
        used = range(min(burn_in, len(got) - 1), len(got))
        for s in used:
            a, t, d = got[s], tables[s], model["d1"]
            parent = _root(a["customers"], a["tables"], totals[s], model)[cell.w]
            p += (cell.c - d * t + (STRENGTH + d * a["context_tables"][cell.u]) * parent) / (STRENGTH + seen)
        logs = np.log10(p / len(used))
        base = np.log10((uni + 0.1) / (model["N"] + 0.1 * (model["V"] + 1)))
        for blob, (run_, doc), code in zip(cell.blobs, cell.runs, np.split(cell.code, cell.cuts), strict=True):
            each = np.repeat(code, run_)
            n = blob[1]
            yield blob[0], (blob[2], squeeze(np.bincount(doc, logs[each], n).astype(np.float32), np.bincount(doc, base[each], n),
                                             np.bincount(doc, uni[each] > 0, n).astype(np.int64)))

    return run


def _total(rows):
    by: dict = {}
    for chunk, value in rows:
        by.setdefault(chunk, []).append(value)
    for parts in by.values():
        ids, held, n_tokens = next(m for m, _ in parts if m is not None)
        sums = [np.zeros(len(ids)) for _ in range(3)]
        for _, data in sorted(parts, key=lambda x: x[1]):
            for s, x in zip(sums, expand(data), strict=True):
                s += x
        yield from zip(ids, held.tolist(), n_tokens.tolist(), sums[2].astype(int).tolist(), sums[1].tolist(), sums[0].tolist(), strict=True)


def _one(rdd):
    """Each partition as one list, so that partitions of equally dealt data can be zipped."""
    return rdd.mapPartitions(lambda it: [list(it)])


def _keyed(rows: list) -> dict:
    out: dict = {}
    for k, v in rows:
        if v is not None:
            out.setdefault(k, []).append(v)
    return out


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out: str = "crc32(cast({key} as string)) % 10 = 0",
                sweeps: int = 4, burn_in: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text.

    Texts for which ``held_out`` is true are scored but teach nothing. NULL and empty texts consist of one end; a NULL key
    teaches. Repeated rows are rows. An empty table gives an empty table; other columns are not read. ``burn_in`` seatings are
    left out of the average: the artificial start (one table per pair) and the sampled sweeps after it, up to sweep burn_in - 1.
    """
    spark = docs.sparkSession
    parts = buckets(spark)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias("text")).select(
        key, F.coalesce(F.expr(held_out.format(key=f"`{key}`")), F.lit(False)).alias("held"), "text")
    # as many cells and owners as the corpus needs: what a task holds does not grow with it
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    grid = max(1, math.ceil((chars / CELL_CHARS) ** 0.5))
    cells = grid * grid
    owners = -(-cells // 4)  # an owner's words are a fraction of a cell's pairs
    dealt = _one(rows.rdd.map(tuple).mapPartitions(_chunks(grid)).partitionBy(cells))

    def at_cells(fn, answers=None):
        """``fn`` on every cell with its packed pairs and its answers so far."""
        alone = answers is None

        def run(item):
            blobs, got = (item, []) if alone else item
            got = _keyed(got)
            for number, own in sorted(_keyed(blobs).items()):
                yield from fn(number, own, *([] if alone else [got.get(number, [])]))
                give_back()

        return (dealt if alone else dealt.zip(answers)).flatMap(run)

    reports = _one(at_cells(_first_report(owners)).partitionBy(owners))

    def at_owners(fn, changes=None):
        alone = changes is None

        def run(item):
            first, more = (item, []) if alone else item
            more = _keyed(more)
            for number, rs in sorted(_keyed(first).items()):
                yield from fn(Owner(rs), number, more.get(number, []), rs)
                give_back()

        return (reports if alone else reports.zip(changes)).flatMap(run)

    def sums(owner, number, changes, rs):
        yield np.array([len(owner.ws[owner.uni > 0]), owner.uni.sum(), owner.customers.sum(), (owner.customers == 1).sum(),
                        (owner.customers == 2).sum(), sum(r[3][0] for r in rs), sum(r[3][1] for r in rs)], np.float64)

    v, n, customers, m1, m2, n1, n2 = at_owners(sums).fold(np.zeros(7), lambda a, b: a + b)
    # discounts from the numbers of pairs (words) seen once and twice
    model = {"V": v, "N": n, "d1": _discount(n1, n2), "d0": _discount(m1, m2)}
    totals = [{"customers": customers, "tables": v}]
    # messages are cumulative: a zip of two data sets is all that any job holds, however many sweeps there were
    answers = _one(at_owners(lambda o, k, c, _: _answer(o, k, c, model, [])).partitionBy(cells))
    for _ in range(sweeps):
        known = list(totals)
        changes = _one(at_cells(_changes(owners, model, known), answers).partitionBy(owners))

        def count(owner, number, more, _, known=known):
            *_, (tables, customers, root) = _seatings(owner, number, more, model, known)
            yield np.array([customers.sum(), root.sum()], np.float64)

        c, t = at_owners(count, changes).fold(np.zeros(2), lambda a, b: a + b)
        totals.append({"customers": c, "tables": t})
        answers = _one(at_owners(lambda o, k, m, _, known=known: _answer(o, k, m, model, known), changes).partitionBy(cells))
    scored = at_cells(_score(owners, model, totals, burn_in), answers).partitionBy(parts).mapPartitions(_total)
    out = spark.createDataFrame(scored, f"`{key}` long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(key, "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")


def _discount(once: float, twice: float) -> float:
    return float(min(0.95, max(0.05, once / (once + 2 * twice)))) if once else 0.5
