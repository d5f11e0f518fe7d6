"""Exact quantiles without sorting or collecting a column.

``percentile``/``median`` keep every distinct value of a group in one
aggregation buffer, which does not hold for a column of billions of values.
Here the value of rank k is bracketed: each round takes approximate quantiles
of the open range that still holds rank k (a sketch of fixed size per task),
picks the two that surround the rank, and counts exactly how many values lie
below, at and above them.  The rank is then one of the two bounds, or in the
open range between them, which holds about a hundredth of the rows.  The
bounds are ranks, not equal widths, so the number of rounds depends on the
number of rows only (four for 10^9), never on how the values are spread or
tied.  Interpolation follows the usual linear (type 7) definition: position
``q * (n - 1)``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.exprs import col, unpivot
from riskfold.session import cut_lineage

STEPS = 256          # approximate quantiles per round
ACCURACY = 10_000    # their rank error is at most 1 / ACCURACY of the range


def exact_quantiles(df: DataFrame, columns, qs=(0.5,)) -> dict:
    """Return ``{column: [value at q for q in qs]}`` (None for an all-null column)."""
    columns, qs = list(columns), list(qs)
    if not columns:
        return {}
    wide = cut_lineage(df.select(*[col(c).cast("double").alias(c) for c in columns]))
    long = unpivot(wide, [], columns, "feature", "v").filter(F.col("v").isNotNull())
    size = {r["feature"]: r["n"] for r in long.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranks = {(c, k) for c in columns if c in size for q in qs
             for k in (math.floor(q * (size[c] - 1)), math.ceil(q * (size[c] - 1)))}
    # rank -> open range (lo, hi) that holds it, values below the range, values in it
    state = {t: (-math.inf, math.inf, 0, size[t[0]]) for t in ranks}
    found: dict = {}
    while len(found) < len(state):
        _round(long, {t: s for t, s in state.items() if t not in found}, state, found)
    out = {}
    for c in columns:
        if c not in size:
            out[c] = [None] * len(qs)
            continue
        vals = []
        for q in qs:
            pos = q * (size[c] - 1)
            lo, hi, part = found[c, math.floor(pos)], found[c, math.ceil(pos)], pos - math.floor(pos)
            vals.append(lo + (hi - lo) * part if part else lo)
        out[c] = vals
    return out


def _inside(long: DataFrame, ranges: list) -> DataFrame:
    """Rows of the given (rid, feature, lo, hi) ranges; as many ranges as open ranks at most."""
    rdf = long.sparkSession.createDataFrame(ranges, "rid int, f string, lo double, hi double")
    return long.join(F.broadcast(rdf), (F.col("feature") == F.col("f")) & (
        (F.col("v") > F.col("lo")) | (F.col("lo") == -math.inf)) & ((F.col("v") < F.col("hi")) | (F.col("hi") == math.inf)))


def _round(long: DataFrame, open_t: dict, state: dict, found: dict) -> None:
    spots = sorted({(t[0], s[0], s[1]) for t, s in open_t.items()})
    rid = {s: i for i, s in enumerate(spots)}
    ranges = [(i, *s) for s, i in rid.items()]
    marks = [i / STEPS for i in range(STEPS + 1)]
    near = {r["rid"]: r["q"] for r in _inside(long, ranges).groupBy("rid").agg(
        F.percentile_approx("v", marks, ACCURACY).alias("q")).collect()}
    bounds = []
    names = list(open_t)
    for i, t in enumerate(names):
        lo, hi, below, n = open_t[t]
        at = (t[1] - below) / n * STEPS
        q = near[rid[t[0], lo, hi]]
        bounds.append((i, t[0], lo, hi, q[max(0, math.floor(at) - 1)], q[min(STEPS, math.ceil(at) + 1)]))
    table = long.sparkSession.createDataFrame(bounds, "rid int, f string, lo double, hi double, a double, b double")
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    counted = {r["rid"]: r for r in _inside(long, [x[:4] for x in bounds]).join(
        F.broadcast(table.select("rid", "a", "b")), "rid").groupBy("rid").agg(
            F.count(F.when(v < a, 1)).alias("lt_a"), F.count(F.when(v <= a, 1)).alias("le_a"),
            F.count(F.when(v < b, 1)).alias("lt_b"), F.count(F.when(v <= b, 1)).alias("le_b")).collect()}
    for i, t in enumerate(names):
        below, n = open_t[t][2], open_t[t][3]
        c, k, lo, hi = counted[i], t[1] - open_t[t][2], bounds[i][4], bounds[i][5]
        if c["lt_a"] <= k < c["le_a"]:
            found[t] = lo
        elif c["lt_b"] <= k < c["le_b"]:
            found[t] = hi
        elif c["le_a"] <= k < c["lt_b"]:
            state[t] = (lo, hi, below + c["le_a"], c["lt_b"] - c["le_a"])
        else:                       # outside the sketch's bounds: keep the side that holds the rank
            state[t] = (open_t[t][0], lo, below, c["lt_a"]) if k < c["lt_a"] else (
                hi, open_t[t][1], below + c["le_b"], n - c["le_b"])


def exact_median(df: DataFrame, column: str):
    return exact_quantiles(df, [column], (0.5,))[column][0]
