"""Quality rules as a learned decision list, in DataFrame expressions only.

Every text is measured by counts (words, symbols, repeated lines, words in repeated three-word windows, ...) inside its own
row; no text leaves its partition. Labelled rows then teach an ordered list of rules: sequential covering grows one
conjunction of thresholds at a time on two thirds of the labels, by information gain over counts per feature and bin that
Spark aggregates; drops its last conditions again where the other third does not bear them out; removes the rows it covers, and
starts the next rule. The list ends as one conditional expression over the columns.

A bounded sample of labelled rows teaches (``sample_rows``); what reaches the driver is one count per class, feature and
bin. Every document is measured and judged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featpipe.llm.common import LOWER, UPPER, WORD, bound, stored

SAMPLE_ROWS = 20_000  # labelled rows that teach
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "distinct_rate",
            "digit_rate", "n_flagged"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


SHORT = 1 << 20  # words of a text whose windows' places fit 20 bits
NEAR = 3


def vocabulary(text: Column) -> Column:
    """The text's words as runs of letters, A-Z folded."""
    return F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}]+")


def measure(docs: DataFrame, text: str = "text", flagged: list[str] | None = None) -> DataFrame:
    """``docs`` under the names __q_c0.., and BASE and FEATURES. NULL texts have no words."""
    kept = [F.col(f"`{c}`").alias(f"__q_c{k}") for k, c in enumerate(docs.columns)]
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    x = bound(docs.select(*kept, t.alias("__q_t")),
               __q_w=F.regexp_extract_all("__q_t", F.lit(WORD), F.lit(0)),
               __q_l=F.filter(F.split("__q_t", "\n", -1), lambda s: s.rlike(WORD)))
    n = F.size("__q_w")
    # Sorting by hash and place brings equal windows side by side; the words themselves decide. Up to SHORT words a window's 44 hash bits
    # and its place share one long, beyond they are a struct with all 64 bits. A window is compared with the NEAR next ones of its
    # hash on either side, so that one of another text with the same hash bits between two equal ones hides neither.
    window = lambda i: F.struct(*[F.get(F.col("__q_w"), i + k) for k in range(3)])
    hashed = lambda i: F.xxhash64(*[F.get(F.col("__q_w"), i + k) for k in range(3)])
    short, places = n <= SHORT, F.sequence(F.lit(0), n - 3)
    x = bound(x, __q_p=F.when((n >= 4) & short, F.sort_array(F.transform(
        places, lambda i: F.call_function("shiftleft", hashed(i), F.lit(20)) + i))).otherwise(F.array().cast("array<bigint>")),
        __q_s=F.when(~short, F.sort_array(F.transform(places, lambda i: F.struct(hashed(i).alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h: bigint, i: int>>")))

    def equal_ones(rows, key, place):
        def same(v, other):
            return F.coalesce((key(v) == key(other)) & (window(place(v)) == window(place(other))), F.lit(False))

        found = F.filter(rows, lambda v, j: reduce(lambda a, b: a | b, [
            same(v, F.get(F.col(rows), j + side * k)) for k in range(1, NEAR + 1) for side in (-1, 1)]))
        return F.transform(found, place)

    high = lambda v: F.call_function("shiftright", v, F.lit(20))
    packed = equal_ones("__q_p", high, lambda v: (v - F.call_function("shiftleft", high(v), F.lit(20))).cast("int"))
    long_ones = equal_ones("__q_s", lambda v: v["h"], lambda v: v["i"])
    x = bound(x, __q_d=F.array_sort(F.when(n <= SHORT, packed).otherwise(long_ones)))
    repeated = F.aggregate(
        "__q_d", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["reach"], i)).alias("n"), (i + 3).alias("reach")),
        lambda a: a["n"])
    marks = F.array(*[F.lit(w) for w in flagged]) if flagged else F.array().cast("array<string>")
    x = bound(
        x, n_words=n.cast("long"),
        word_chars=(F.length("__q_t") - F.regexp_count("__q_t", F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        n_symbols=F.regexp_count("__q_t", F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=(F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
        n_repeat_words=repeated.cast("long"),
        __q_lines=F.size("__q_l"), __q_upper=F.regexp_count("__q_t", F.lit(r"\p{Lu}")),
        __q_digit=F.regexp_count("__q_t", F.lit("[0-9]")), __q_kinds=F.size(F.array_distinct("__q_w")),
        n_flagged=(F.size(F.array_intersect(vocabulary(F.col("__q_t")), marks)) if flagged else F.lit(0)).cast("double"))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    x = bound(x, mean_word=F.col("word_chars") / words, symbol_rate=F.col("n_symbols") / words,
               dup_line_rate=F.col("n_dup_lines") / F.greatest("__q_lines", F.lit(1)),
               repeat_rate=F.col("n_repeat_words") / words, upper_rate=F.col("__q_upper") / chars,
               distinct_rate=F.col("__q_kinds") / words, digit_rate=F.col("__q_digit") / chars)
    return x.select(*[f"__q_c{k}" for k in range(len(docs.columns))], *BASE, *FEATURES[1:])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    rules: list[list[Literal]]
    flagged: list[str]

    def keeps(self) -> Column:
        """The list as an ordered conditional: the first rule that holds rejects."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), False).otherwise(out)
        return out


def _all(rule: list[Literal]) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.column()
    return out


def flagged_words(labelled: DataFrame, bad: str, text: str, share: float = 0.01, ratio: float = 20.0,
                  contexts: int = 8, size: int = 200) -> list[str]:
    """Words that mark the texts with ``bad``: in at least ``share`` of them, ``ratio`` times as often as in other
    texts, and after at least ``contexts`` different words (copies of one text lend a word only one). At most
    ``size`` words, the most frequent first."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = bound(labelled.select(F.col(bad).alias("bad"), t.alias("t")), w=vocabulary(F.col("t"))).drop("t")
    n = {r["bad"]: r["count"] for r in rows.groupBy("bad").count().collect()}
    if not n.get(True) or not n.get(False):
        return []
    found = rows.select("bad", F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(
        F.count_if("bad").alias("docs"), F.count_if(~F.col("bad")).alias("clean"))
    found = found.where((F.col("docs") >= max(3.0, share * n[True])) & (F.length("w") > 1)
                        & (F.col("docs") / n[True] > ratio * F.col("clean") / n[False]))
    after = F.array_distinct(F.transform("w", lambda w, i: F.struct(w.alias("w"), F.get(F.col("w"), i - 1).alias("before"))))
    varied = rows.where("bad").select(F.inline(after)).groupBy("w").agg(F.approx_count_distinct("before").alias("ctx"))
    kept = found.join(varied.where(F.col("ctx") >= contexts), "w")
    return [r["w"] for r in kept.orderBy(F.desc("docs"), "w").limit(size).select("w").collect()]


def fit(rows: DataFrame, flagged: list[str], bad: str = "bad", bins: int = 32, max_rules: int = 12, max_literals: int = 4,
        precision: float = 0.95, least: float = 0.002) -> DecisionList:
    """Learn the list from rows with FEATURES and the boolean ``bad`` (NULL: no label), and a ``part`` (2: prune)."""
    at = [i / bins for i in range(bins + 1)]
    cuts = {f: set() for f in FEATURES}
    for r in rows.groupBy(bad).agg(*[F.percentile_approx(F.col(f).cast("double"), at, 10_000).alias(f) for f in FEATURES]).collect():
        for f in FEATURES:
            cuts[f].update(r[f] or [])
    grid = {f: sorted(c) for f, c in cuts.items()}
    if not all(grid.values()):
        return DecisionList([], flagged)
    # bin b of a feature: the values above exactly b cuts
    def bin_of(f):
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in grid[f]]), lambda c: F.col(f).cast("double") > c))

    binned = rows.select(bad, "part", *FEATURES, *[bin_of(f).alias(f"__b{k}") for k, f in enumerate(FEATURES)])
    left = stored(binned, "quality-labels")
    total = left.where(bad).count()
    rules: list[list[Literal]] = []
    seen = F.lit(False)
    while len(rules) < max_rules:
        rule, fresh = [], left.where(~seen)
        while len(rule) < max_literals:
            cells = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"__b{k}").alias("b")) for k in range(len(FEATURES))]))
            counts = fresh.where(_all(rule) & (F.col("part") < 2)).select(bad, cells.alias("x")).groupBy("x.f", "x.b").agg(
                F.count_if(F.col(bad)).alias("p"), F.count_if(~F.col(bad)).alias("n")).collect()
            step = _best_literal(counts, grid)
            if step is None:
                break
            rule.append(step[0])
            if step[1] == 0:
                break
        if not rule:
            break
        held = fresh.where(F.col("part") == 2).agg(*[F.count_if(_all(rule[: k + 1]) & (F.col(bad) if v else ~F.col(bad))).alias(
            f"{'pn'[v == 0]}{k}") for k in range(len(rule)) for v in (1, 0)]).first()
        score = [((held[f"p{k}"] - held[f"n{k}"]) / max(1, held[f"p{k}"] + held[f"n{k}"]), -k) for k in range(len(rule))]
        k = -max(score)[1]
        p, n = held[f"p{k}"], held[f"n{k}"]
        if p < max(1.0, least * total / 3) or p < precision * (p + n):
            break
        rules.append(_strictest(rule[: k + 1]))
        seen = seen | _all(rules[-1])
    return DecisionList(rules, flagged)


def _strictest(rule: list[Literal]) -> list[Literal]:
    """Of several bounds on the same side of a feature only the strictest says anything."""
    out: dict[tuple[str, bool], Literal] = {}
    for x in rule:
        old = out.get((x.feature, x.above))
        if old is None or (x.threshold > old.threshold) == x.above:
            out[x.feature, x.above] = x
    return list(out.values())


def _best_literal(counts, grid) -> tuple[Literal, int] | None:
    """The condition of the highest information gain, and the clean rows it still covers."""
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
    best = None
    for k, f in enumerate(FEATURES):
        cells = by.get(k, {})
        p0, n0 = sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values())
        if not p0 or not n0:
            continue
        before = math.log2(p0 / (p0 + n0))
        p = n = 0
        for b, cut in enumerate(grid[f]):  # values <= cut b lie in bins 0..b
            p, n = p + cells.get(b, (0, 0))[0], n + cells.get(b, (0, 0))[1]
            for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                if q:
                    gain = q * (math.log2(q / (q + m)) - before)
                    if gain > 0 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, Literal(f, above, float(cut)), m)
    return best and best[1:]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
          sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """A list that rejects what the labels call toxic or of low quality, learned from at most ``sample_rows`` labelled
    keys (those of the smallest hash). Rows without either label teach nothing; of several labels for a key the worse
    counts. Without labels of both kinds the list is empty: it keeps all."""
    marks = labels.where(F.col(key).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull())).groupBy(
        F.col(key).alias("__q_key")).agg(F.max(F.coalesce("toxic", F.lit(0)) == 1).alias("__q_toxic"),
                                         F.min(F.coalesce("quality", F.lit(1)) != 1).alias("__q_low"))
    marks = marks.orderBy(F.xxhash64("__q_key"), "__q_key").limit(sample_rows)  # so a broadcast has a bound
    own = stored(docs.select(F.col(f"`{key}`").alias("__q_key"), F.col(f"`{text}`").alias("__q_text")).join(
        F.broadcast(marks), "__q_key"), "quality-sample")
    flagged = flagged_words(own, "__q_toxic", "__q_text")
    rows = measure(own, "__q_text", flagged).select(
        (F.col("__q_c2") | F.col("__q_c3")).alias("bad"), F.pmod(F.xxhash64("__q_c0"), F.lit(3)).alias("part"), *FEATURES)
    return fit(rows, flagged)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Columns of ``docs`` (those named like a result are replaced), BASE, base_failed and kept.

    A NULL, empty or wordless text has no words and fails the base rules. Repeated rows are judged alike; an empty table
    gives an empty table.
    """
    made = [*BASE, "base_failed", "kept"]
    rows = bound(measure(docs, text, rules.flagged), __q_failed=base_failed(), __q_keeps=rules.keeps())
    return rows.select(*[F.col(f"__q_c{k}").alias(c) for k, c in enumerate(docs.columns) if c not in made], *BASE,
                       F.col("__q_failed").alias("base_failed"), (~F.col("__q_failed") & F.col("__q_keeps")).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The documents the rules keep, with their own columns."""
    rows = bound(measure(docs, text, rules.flagged), __q_keeps=~base_failed() & rules.keeps())
    return rows.where("__q_keeps").select(*[F.col(f"__q_c{k}").alias(c) for k, c in enumerate(docs.columns)])
