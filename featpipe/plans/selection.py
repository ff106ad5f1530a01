"""Exact order statistics without moving the values.

A sketch pass gives every target rank an interval of values that holds it; counting passes then need two things only: how many values lie
below the interval, and the distinct values inside it with their counts. Both collapse before the shuffle, so what crosses the network are
sketches, counts and the few values inside the intervals, never the column. While an interval still holds many values, a sketch of
what lies inside narrows it further (each pass by some hundred times). The counts prove the answer: a rank that lies
outside its interval is sought again in a wider one. Sketches decide the cost, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featpipe.plans import ordered

MARGIN = 0.004  # of the rank, on either side: three times a sketch's usual error
GRID = 200  # quantiles that narrow an interval
INSIDE = 1_000_000  # values of an interval that are looked at themselves, about


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _sketched(rows: DataFrame, keys: list[str], fractions: Sequence[float]) -> DataFrame:
    """(keys, n, m, q): rows, rows that are numbers, and their sketch's quantiles at ``fractions``."""
    number = F.when(~F.isnan("v"), F.col("v"))
    part = rows.groupBy(*keys, (F.spark_partition_id() % ordered.SKETCH_GROUPS).alias("_fp_p")).agg(
        F.count("*").alias("n"), F.count(number).alias("m"), F.kll_sketch_agg_double(number, ordered.SKETCH_K).alias("s"))
    one = part.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.kll_merge_agg_double("s").alias("s"))
    return one.select(*keys, "n", "m", F.when(F.col("m") > 0, F.kll_sketch_get_quantile_double(
        "s", F.array(*[F.lit(float(f)) for f in fractions]))).alias("q"))


def _lit(v: float) -> Column:
    return F.lit(float(v)).cast("double")


def _targets(raw: DataFrame, groups: list[str], targets: list[dict]) -> DataFrame:
    """Every row at each target of its group that it matters to: (t, v) inside the target's interval, (t, NULL) below it."""
    def at(lo, hi, t):
        v = F.col("v")
        return _struct({"t": F.lit(t) if isinstance(t, int) else t, "seen": v <= hi, "v": F.when(v >= lo, v)})

    if not groups:
        rows = raw.select(F.inline(F.array(*[at(_lit(t["lo"]), _lit(t["hi"]), t["t"]) for t in targets])))
        return rows.where("seen").select("t", "v")
    by: dict = {}
    for t in targets:
        by.setdefault(t["group"], []).append(t)
    wide = max(len(x) for x in by.values())
    schema = T.StructType([T.StructField(f"_fp_g{i}", raw.schema[g].dataType) for i, g in enumerate(groups)])
    for k in range(wide):
        schema = schema.add(f"lo{k}", T.DoubleType()).add(f"hi{k}", T.DoubleType()).add(f"t{k}", T.IntegerType())
    none = {"lo": math.inf, "hi": -math.inf, "t": -1}  # no value is at or below it
    table = [(*g, *[x for t in [*own, *[none] * (wide - len(own))] for x in (t["lo"], t["hi"], t["t"])]) for g, own in by.items()]
    bounds = raw.sparkSession.createDataFrame(table, schema)  # as many rows as there are targets, at most
    same = [raw[g].eqNullSafe(F.col(f"_fp_g{i}")) for i, g in enumerate(groups)]
    met = raw.join(F.broadcast(bounds), same)
    rows = met.select(F.inline(F.array(*[at(F.col(f"lo{k}"), F.col(f"hi{k}"), F.col(f"t{k}")) for k in range(wide)])))
    return rows.where("seen AND t >= 0").select("t", "v")


def _interval(fractions: Sequence[float], q: Sequence[float], first: int, last: int, m: int, margin: float) -> tuple[float, float, float]:
    """The narrowest (low, high, values inside, about) of the quantiles ``q`` that has room for a sketch's error around the ranks."""
    low = max([k for k, f in enumerate(fractions) if f <= (first - 1) / m - margin], default=0)
    high = min([k for k, f in enumerate(fractions) if f >= (last + 2) / m + margin], default=len(fractions) - 1)
    return q[low], q[high], (fractions[high] - fractions[low]) * m


def _narrowed(raw: DataFrame, groups: list[str], targets: list[dict]) -> None:
    """Intervals of some targets narrowed by a sketch of what lies inside them."""
    seen = _targets(raw, groups, targets)
    below = {r.t: r.n for r in seen.where("v IS NULL").groupBy("t").agg(F.count("*").alias("n")).collect()}
    by = {t["t"]: t for t in targets}
    grid = [k / GRID for k in range(GRID + 1)]
    for r in _sketched(seen.where("v IS NOT NULL"), ["t"], grid).collect():
        if r.q:
            t, under = by[r.t], below.get(r.t, 0)
            t["lo"], t["hi"], t["size"] = _interval(grid, r.q, t["ranks"][0] - under, t["ranks"][-1] - under, r.m, MARGIN * t["wider"])


def order_statistics(raw: DataFrame, groups: Sequence[str], probs: Sequence[float], inside: int = INSIDE) -> list[tuple]:
    """[(group, n, {prob: (lower value, upper value)})]: for each probability p the values at ranks floor and ceil of p * (n - 1).

    ``raw``: the group columns and ``v``, a double that is not NULL; NaN counts as larger than all numbers. The groups must be few: one row of
    each reaches the driver (no groups: one row for the whole; no rows: none)."""
    groups, ps = list(groups), list(probs)
    # around every probability, near and (for groups of few rows) farther off
    cuts = sorted({0.0, 1.0, *[min(1.0, max(0.0, p + d)) for p in ps for off in (1.5 * MARGIN, 0.02, 0.2) for d in (-off, off)]})
    found, targets = [], []
    for r in _sketched(raw, groups, cuts).collect():
        if not r["n"]:
            continue
        found.append((tuple(r[g] for g in groups), r["n"], {}))
        for p in ps:
            both = sorted({math.floor(p * (r["n"] - 1)), math.ceil(p * (r["n"] - 1))})
            found[-1][2].update({(p, rank): math.nan for rank in both if rank >= r["m"]})
            if ranks := [x for x in both if x < r["m"]]:
                lo, hi, size = _interval(cuts, r["q"], ranks[0], ranks[-1], r["m"], MARGIN)
                targets.append({"group": found[-1][0], "p": p, "ranks": ranks, "lo": lo, "hi": hi, "n": r["m"], "size": size,
                                "into": found[-1][2], "wider": 1})
    while targets:
        for k, t in enumerate(targets):
            t["t"] = k
        while large := [t for t in targets if t["size"] > inside and t["lo"] < t["hi"]]:
            before = [(t["lo"], t["hi"]) for t in large]
            _narrowed(raw, groups, large)
            if before == [(t["lo"], t["hi"]) for t in large]:
                break  # few distinct values fill the intervals
        counts = _targets(raw, groups, targets).groupBy("t", "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("t").orderBy(F.col("v").asc_nulls_first()))
        ranks = raw.sparkSession.createDataFrame([(t["t"], rank) for t in targets for rank in t["ranks"]], "_fp_t int, rank long")
        cum = counts.withColumn("upto", upto).join(F.broadcast(ranks), F.col("t") == F.col("_fp_t"))
        got = {(r.t, r.rank): r.v for r in cum.where("rank < upto AND rank >= upto - c AND v IS NOT NULL").select("t", "rank", "v").collect()}
        for t in targets:
            t["into"].update({(t["p"], rank): got[t["t"], rank] for rank in t["ranks"] if (t["t"], rank) in got})
            t["ranks"] = [rank for rank in t["ranks"] if (t["t"], rank) not in got]
        targets = [t for t in targets if t["ranks"]]
        for t in targets:  # a sketch was off: over all values again, with more room
            t.update(lo=-math.inf, hi=math.inf, size=t["n"], wider=4 * t["wider"])
    return [(g, n, {p: (v[p, math.floor(p * (n - 1))], v[p, math.ceil(p * (n - 1))]) for p in ps}) for g, n, v in found]
