"""Exact k-nearest-neighbour search (J7 / K4) and kNN imputation.

Donors fall into cells: by the pattern of their present columns, and inside a pattern
by the nearest of some sampled pivots.  A cell knows its radius and its bounding box; the
triangle inequality and the gap to the box, on the columns that a query shares with the
pattern, bound the distance to every donor of the cell from below.  A query first visits
its nearest cells until they hold ``k`` donors; the k-th distance found there then rules
out all cells whose bound lies beyond it, and only the others are visited in a second
round.  Every (cell, query block, donor block) with visits is one group of a cogrouped
pandas function that keeps its top-k per query (and missing column).  Inside a group,
imputation compares small boxes of queries with small boxes of donors, nearest first, and
stops where the gap exceeds the k-th distance; complete vectors are screened by a matrix
product with an error bound, and only what it cannot exclude is measured exactly.  The
final top-k is a window ordered by ``(distance, donor key)``, so ties resolve the same way
everywhere.  Neither pairs nor queries nor donors reach the driver, only pivots, boxes and
sizes of cells (bounded numbers); the plan is the same at every size, and keys may be of
any ordered type.

Distance (missing-aware Euclidean): ``sqrt(d / m * sum over coordinates
present in both of (a - b)^2)`` with ``d`` columns and ``m`` shared ones;
``m = 0`` means "no distance" and the donor is not used.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.exprs import col
from riskfold.session import ship_package, stash

QUERY_BLOCK = 4096     # query rows of a group
DONOR_BLOCK = 65536    # donor rows of a group
STEP = 1024            # rows of one numpy step inside a group
CELL_ROWS = 8192       # donors that a cell holds on average, as long as there are
MAX_PIVOTS = 2048      # at most so many pivots (beyond, cells grow and are dealt in blocks)
LEAF = 128             # donors of a small box inside a group
QUERY_LEAF = 64        # queries of a small box inside a group
FIRST = 16             # cells of a query that are sorted first
BALLS_FROM = 16        # with more columns the radius of a cell bounds too; with fewer its box is tighter
SPREAD = 16384         # visits handed over at once
MAX_PATTERNS = 64      # patterns of present columns with cells of their own; donors of others are always visited

LOG = logging.getLogger(__name__)


def donor_table(df: DataFrame, columns, key="row_id") -> DataFrame:
    """Donor rows for imputation: key and numeric columns of the fit rows."""
    return df.select(col(key).alias("_id"), *[col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])


def _masked_dist(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(nq, nx) missing-aware Euclidean distances; inf where no coordinate is shared.

    Works in place on one (nq, nx) buffer: per column, zero-filled difference,
    squared, then the (few) rows / columns missing that column are zeroed.
    The shared-coordinate count is an exact 0/1 matrix product."""
    d = q.shape[1]
    mq, mx = ~np.isnan(q), ~np.isnan(x)
    q0, x0 = np.where(mq, q, 0.0), np.where(mx, x, 0.0)
    ss = np.zeros((q.shape[0], x.shape[0]))
    buf = np.empty_like(ss)
    for j in range(d):
        np.subtract(q0[:, j][:, None], x0[:, j][None, :], out=buf)
        np.multiply(buf, buf, out=buf)
        rq, rx = np.flatnonzero(~mq[:, j]), np.flatnonzero(~mx[:, j])
        if rq.size:
            buf[rq, :] = 0.0
        if rx.size:
            buf[:, rx] = 0.0
        ss += buf
    m = mq.astype("float64") @ mx.astype("float64").T
    with np.errstate(divide="ignore", invalid="ignore"):
        np.multiply(ss, d, out=ss)
        np.divide(ss, m, out=ss)
        np.sqrt(ss, out=ss)
    ss[m == 0] = np.inf
    return ss


def _merge_topk(best_d, best_i, r, d, i):
    """Merge candidates ``(query place, distance, donor place)`` into the running top-k, ordered by (distance, donor place)."""
    n, k = best_d.shape
    old_r, old_k = np.nonzero(np.isfinite(best_d))
    r, d, i = np.concatenate([old_r, r]), np.concatenate([best_d[old_r, old_k], d]), np.concatenate([best_i[old_r, old_k], i])
    order = np.lexsort((i, d, r))
    r = r[order]
    rank = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r]
    keep = rank < k
    nd, ni = np.full((n, k), np.inf), np.zeros((n, k), np.int64)
    nd[r[keep], rank[keep]], ni[r[keep], rank[keep]] = d[order][keep], i[order][keep]
    return nd, ni


def _close(q: np.ndarray, x: np.ndarray, k: int, limit: np.ndarray):
    """(row, distance, column) of the finite distances of :func:`_masked_dist` that a row's top-k can hold: up to its
    k-th smallest, ties included, and up to its ``limit``.  All queries miss the same columns; only such squares as may
    lie within the limit get a root."""
    present = np.flatnonzero(~np.isnan(q[0]))
    mx = ~np.isnan(x[:, present])
    m, every = mx.sum(axis=1).astype(float), mx.all()
    ss, buf = np.zeros((len(q), len(x))), np.empty((len(q), len(x)))
    for i, c in enumerate(present):
        np.subtract(q[:, c, None], x[None, :, c] if every else np.where(mx[:, i], x[:, c], 0.0)[None, :], out=buf)
        np.multiply(buf, buf, out=buf)
        if not every:
            buf[:, ~mx[:, i]] = 0.0
        ss += buf
    ss *= q.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        ss /= m
    ss[:, m == 0] = np.inf
    wide = 1.0 + 1e-9      # squares may round otherwise than distances; the merge compares distances
    most = limit * limit * wide
    if len(x) > k and not np.isfinite(limit).all():
        most = np.minimum(most, np.partition(ss, k - 1, axis=1)[:, k - 1] * wide)
    r, j = np.nonzero((ss <= most[:, None]) & np.isfinite(ss))
    dist = np.sqrt(ss[r, j])
    near = dist <= limit[r]
    return r[near], dist[near], j[near]


def _targets(missing: np.ndarray, reachable: np.ndarray, lo: np.ndarray) -> list:
    """(usable donor boxes, missing columns that all of these serve): such columns share their neighbours."""
    out: dict = {}
    for c in missing:
        usable = np.flatnonzero(~np.isnan(lo[:, c]) & reachable)
        out.setdefault(usable.tobytes(), (usable, []))[1].append(c)
    return list(out.values())


def _leaves(x: np.ndarray, size: int) -> list:
    """Row numbers in boxes of at most ``size`` rows that miss the same columns: halved along the widest column."""
    out, todo = [], list(pd.Series(range(len(x))).groupby([*np.isnan(x).T]).indices.values()) if len(x) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = x[rows]
        with np.errstate(invalid="ignore"):
            width = np.nan_to_num(own.max(axis=0) - own.min(axis=0), nan=-1.0)
        half = len(rows) // 2
        order = np.argpartition(own[:, int(np.argmax(width))], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def _gap(lo: np.ndarray, hi: np.ndarray, box_lo: np.ndarray, box_hi: np.ndarray) -> np.ndarray:
    """(queries, boxes) lower bounds of the distance between rows in ``lo..hi`` and in each box; inf where no column is shared."""
    d = lo.shape[1]
    has, box_has = ~np.isnan(lo), ~np.isnan(box_lo)
    ss = np.zeros((len(lo), len(box_lo)))
    for j in range(d):
        if has[:, j].any() and box_has[:, j].any():
            gap = np.maximum(box_lo[None, :, j] - hi[:, j, None], lo[:, j, None] - box_hi[None, :, j])
            np.fmax(gap, 0.0, out=gap)      # a column that either side lacks adds nothing
            gap *= gap
            ss += gap
    m = has.astype(float) @ box_has.astype(float).T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m > 0, np.sqrt(ss * d / m) * (1.0 - 1e-9), np.inf)


@dataclass
class Cells:
    """Donor cells: pivot coordinates (NaN where the pattern has no column), radius, box and size."""

    pivot: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    pattern: list          # per cell; the last cell is of no pattern and always visited

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, cells) lower bounds of the distance to any donor; inf where no column is shared."""
        if len(self.pivot) == 1:
            return np.full((len(q), 1), -np.inf)
        low = _gap(q, q, self.low[:-1], self.high[:-1])
        if q.shape[1] > BALLS_FROM:
            near = _masked_dist(q, self.pivot[:-1])
            shared = (~np.isnan(q)).astype(float) @ (~np.isnan(self.pivot[:-1])).astype(float).T
            with np.errstate(divide="ignore", invalid="ignore"):
                slack = self.radius[:-1] * np.sqrt(q.shape[1] / shared)
                low = np.maximum(low, np.where(shared > 0, (near - slack) - 1e-9 * (1.0 + near + slack), np.inf))
        return np.concatenate([low, np.full((len(q), 1), -np.inf)], axis=1)

    def first(self, low: np.ndarray, usable: np.ndarray, need: int) -> np.ndarray:
        """Cells that a query visits first: the nearest usable ones that hold ``need`` donors together."""
        low = np.where(usable, low, np.inf)
        out = np.zeros(low.shape, bool)
        some = min(FIRST, low.shape[1])      # the nearest few hold enough as a rule; else all are sorted
        order = np.argpartition(low, some - 1, axis=1)[:, :some]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(low, order, axis=1), axis=1, kind="stable"), axis=1)
        short = self._take(out, low, order, need, slice(None))
        if some < low.shape[1] and short.any():
            rows = np.flatnonzero(short)
            self._take(out, low[rows], np.argsort(low[rows], axis=1, kind="stable"), need, rows)
        out &= np.isfinite(low)
        out[:, -1] = True
        return out

    def _take(self, out, low, order, need, rows) -> np.ndarray:
        """Choose cells in ``order`` until they hold ``need`` donors; the rows that hold fewer."""
        held = np.cumsum(np.where(np.isfinite(np.take_along_axis(low, order, axis=1)), self.size[order], 0), axis=1)
        before = np.concatenate([np.zeros((len(low), 1), held.dtype), held[:, :-1]], axis=1)
        chosen = np.zeros(low.shape, bool)
        np.put_along_axis(chosen, order, before < need, axis=1)
        out[rows] = chosen
        return held[:, -1] < need


def _pattern(d: int) -> F.Column:
    return F.concat(*[F.when(F.col(f"_c{i}").isNull() | F.isnan(f"_c{i}"), "0").otherwise("1") for i in range(d)])


def donor_cells(donors: DataFrame, d: int) -> tuple[DataFrame, Cells]:
    """(donors with ``_cell``, written once; the cells)."""
    # written first: the passes below read numbers, not what they were made from
    donors = stash(donors.select("_id", *[f"_c{i}" for i in range(d)]).withColumn("_p", _pattern(d)), "donors")
    seed = F.xxhash64("_id")
    point = F.array(*[F.col(f"_c{i}") for i in range(d)])
    top = donors.groupBy("_p").agg(F.count("*").alias("n"), F.min_by(point, seed).alias("x")).orderBy(F.desc("n"), "_p").limit(MAX_PATTERNS).collect()
    top = [r for r in top if "1" in r["_p"]]
    total = max(1, sum(r["n"] for r in top))
    pivots = {r["_p"]: [r["x"]] for r in top}
    share, wanted = F.lit(0.0), False
    for r in top:     # as many pivots of a pattern as it holds of the donors
        want = min(-(-r["n"] // CELL_ROWS), MAX_PIVOTS * r["n"] // total)
        wanted |= want > 1
        share = F.when(F.col("_p") == r["_p"], F.lit(0.0 if want < 2 else want / r["n"])).otherwise(share)
    drawn = donors.filter(F.pmod(seed, F.lit(1 << 30)) < share * F.lit(float(1 << 30))).select("_p", point.alias("x"))
    for r in drawn.distinct().collect() if wanted else []:        # about MAX_PIVOTS at most
        pivots[r["_p"]].append(r["x"])
    names, at = [], {}
    for p, xs in pivots.items():
        at[p] = (len(names), np.array([[np.nan if v is None else v for v in x] for x in xs], float))
        names += [p] * len(xs)
    none = len(names)

    def assign(batches):
        for pdf in batches:
            cell, dist = np.full(len(pdf), none, np.int32), np.zeros(len(pdf))
            x = _numbers(pdf, d)
            for p, rows in pdf.groupby("_p").indices.items():
                if p in at:
                    base, own = at[p]
                    present = np.array([c == "1" for c in p])
                    own = own[:, present]
                    mid = own.mean(axis=0)
                    turned = (own - mid).T
                    weight = 0.5 * (turned * turned).sum(axis=0)
                    for s in range(0, len(rows), STEP):
                        r = rows[s:s + STEP]
                        here = x[r][:, present]
                        at_best = np.argmin(weight - (here - mid) @ turned, axis=1)      # any pivot would do; the radius is exact
                        cell[r] = base + at_best
                        dist[r] = np.sqrt(((here - own[at_best]) ** 2).sum(axis=1))
            yield pdf.drop(columns="_p").assign(_cell=cell, _r=dist)

    kinds = T.StructType([donors.schema["_id"], *[T.StructField(f"_c{i}", T.DoubleType()) for i in range(d)],
                          T.StructField("_cell", T.IntegerType()), T.StructField("_r", T.DoubleType())])
    ship_package(donors.sparkSession)
    placed = stash(donors.mapInPandas(assign, kinds), "placed")
    radius, size = np.zeros(none + 1), np.zeros(none + 1, np.int64)
    low, high = np.full((none + 1, d), np.nan), np.full((none + 1, d), np.nan)
    boxes = [f(f"_c{i}").alias(f"{n}{i}") for i in range(d) for n, f in (("lo", F.min), ("hi", F.max))]
    for r in placed.groupBy("_cell").agg(F.max("_r").alias("r"), F.count("*").alias("n"), *boxes).collect():     # a row per cell
        c = r["_cell"]
        radius[c], size[c] = r["r"], r["n"]
        for i in range(d):
            if c < none and names[c][i] == "1":
                low[c, i], high[c, i] = r[f"lo{i}"], r[f"hi{i}"]
    every = [x for _, own in at.values() for x in own] + [np.full(d, np.nan)]
    # a cell without donors keeps its pivot as its box: it is never visited
    for c in np.flatnonzero(size[:-1] == 0):
        low[c] = high[c] = every[c]
    return placed.drop("_r"), Cells(np.array(every), radius, low, high, size, [*names, None])


def _visit(visits: DataFrame, placed: DataFrame, cells: Cells, fn, schema: T.StructType) -> tuple[DataFrame, int]:
    """Run ``fn(query rows, donor rows)`` on every cell's visits; also the number of pairs that this compares."""
    spark, visits = visits.sparkSession, stash(visits, "visits")      # counted, then dealt: bounds are worked out once
    counts = {r["_cell"]: r["count"] for r in visits.groupBy("_cell").count().collect()}
    pairs = sum(n * int(cells.size[c]) for c, n in counts.items())
    deal = F.broadcast(spark.createDataFrame([(c, -(-n // QUERY_BLOCK), max(1, -(-int(cells.size[c]) // DONOR_BLOCK))) for c, n in counts.items()],
                                             "_cell int, _nq long, _nd long"))

    def dealt(df, own, n_own, other, n_other):
        return df.join(deal, "_cell").withColumn(own, F.pmod(F.xxhash64("_id"), F.col(n_own))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1))).drop("_nq", "_nd")

    q = dealt(visits, "_qb", "_nq", "_db", "_nd").groupBy("_cell", "_qb", "_db")
    return q.cogroup(dealt(placed, "_db", "_nd", "_qb", "_nq").groupBy("_cell", "_qb", "_db")).applyInPandas(fn, schema), pairs


def _search(queries: DataFrame, donors: DataFrame, d: int, k: int, need: int, fn, schema: T.StructType, per_column: bool) -> DataFrame:
    """Candidates that hold the exact top-k of every query (and, ``per_column``, of each of its missing columns)."""
    placed, cells = donor_cells(donors, d)
    columns = [f"_c{i}" for i in range(d)]
    if queries is None:       # the donors themselves, or those of them that miss a column
        queries = placed.filter(_pattern(d).contains("0")) if per_column else placed
    else:
        queries = stash(queries, "queries")
    has = np.array([[p is None or p[i] == "1" for i in range(d)] for p in cells.pattern])

    def goals(x):
        """(target columns, usable cells of each) per target."""
        return [(np.isnan(x[:, c]), has[:, c]) for c in range(d)] if per_column else [(np.ones(len(x), bool), np.ones(len(cells.size), bool))]

    def spread(pdf, chosen, far):
        row, cell = np.nonzero(chosen)
        for s in range(0, len(row), SPREAD):
            r = row[s:s + SPREAD]
            yield pdf[["_id", *columns]].iloc[r].assign(_cell=cell[s:s + SPREAD].astype(np.int32), _far=far[r])

    def nearest(x):
        low, out = cells.bounds(x), np.zeros((len(x), len(cells.size)), bool)
        for asked, usable in goals(x):
            rows = np.flatnonzero(asked)
            if rows.size:
                out[rows] |= cells.first(low[rows], usable[None, :], need)
        return low, out & (cells.size > 0)

    def pieces(batches):
        for pdf in batches:
            for s in range(0, len(pdf), STEP):
                yield pdf.iloc[s:s + STEP]

    def opening(batches):
        for pdf in pieces(batches):
            yield from spread(pdf, nearest(_numbers(pdf, d))[1], np.full(len(pdf), np.inf))

    kinds = T.StructType([queries.schema["_id"], *[T.StructField(c, T.DoubleType()) for c in columns]])
    visit = T.StructType([*kinds.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])
    queries = queries.select("_id", *columns)
    one, compared = _visit(queries.mapInPandas(opening, visit), placed, cells, fn, schema)
    one = stash(one, "first")
    goal = F.col("c") if per_column else F.lit(0)
    ranked = one.withColumn("_g", goal).withColumn("_rk", F.row_number().over(Window.partitionBy("qid", "_g").orderBy("dist")))
    reach = ranked.filter(F.col("_rk") == k).groupBy(F.col("qid").alias("_q")).agg(
        F.map_from_entries(F.collect_list(F.struct("_g", "dist"))).alias("_reach"))       # at most a distance per column

    def closing(batches):
        for pdf in pieces(batches):
            low, seen = nearest(_numbers(pdf, d))
            out, reach = np.zeros(seen.shape, bool), [dict(m) if m is not None else {} for m in pdf["_reach"]]
            most = np.zeros(len(pdf))        # no donor beyond it is needed for any column
            for c, (asked, usable) in enumerate(goals(_numbers(pdf, d))):
                rows = np.flatnonzero(asked)
                far = np.array([reach[i].get(c, np.inf) for i in rows], float)
                out[rows] |= (low[rows] <= far[:, None]) & np.isfinite(low[rows]) & usable[None, :]
                most[rows] = np.maximum(most[rows], far)
            yield from spread(pdf, out & ~seen & (cells.size > 0), most)

    asked = queries.join(reach, F.col("_id") == F.col("_q"), "left").drop("_q")
    two, more = _visit(asked.mapInPandas(closing, visit), placed, cells, fn, schema)
    two = two if more else one.limit(0)
    LOG.info("neighbours: %s pairs compared in %s cells", compared + more, len(cells.size))
    SEARCHED.update(pairs=compared + more, cells=len(cells.size))
    return one.unionByName(two)


#: Figures of the last search: compared pairs and cells.
SEARCHED: dict[str, int] = {}


def _schema(qtype, dtype, *names) -> T.StructType:
    kinds = {"qid": qtype, "did": dtype, "c": T.IntegerType(), "dist": T.DoubleType(), "v": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[n]) for n in names])


def _numbers(pdf: pd.DataFrame, d: int) -> np.ndarray:
    return pdf[[f"_c{i}" for i in range(d)]].to_numpy(dtype="float64")


def _impute_candidates(k: int, d: int):
    def fn(qpdf: pd.DataFrame, xpdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qpdf) and len(xpdf):
            xpdf = xpdf.sort_values("_id", kind="stable")   # positions order ties by key
            qx, x, ids = _numbers(qpdf, d), _numbers(xpdf, d), xpdf["_id"].to_numpy()
            qids, far = qpdf["_id"].to_numpy(), qpdf["_far"].to_numpy()
            leaves = _leaves(x, LEAF)
            lo, hi = np.array([x[r].min(axis=0) for r in leaves]), np.array([x[r].max(axis=0) for r in leaves])
            for rows in _leaves(qx, QUERY_LEAF):
                q = qx[rows]
                low = _gap(q.min(axis=0)[None], q.max(axis=0)[None], lo, hi)[0]
                for usable, targets in _targets(np.flatnonzero(np.isnan(q[0])), np.isfinite(low), lo):
                    usable = usable[np.argsort(low[usable], kind="stable")]
                    reach = far[rows]
                    bd, bi = np.full((len(rows), k), np.inf), np.zeros((len(rows), k), np.int64)
                    s, n = 0, 2
                    while s < len(usable) and low[usable[s]] <= reach.max():
                        at = np.concatenate([leaves[u] for u in usable[s:s + n] if low[u] <= reach.max()])
                        r, dist, j = _close(q, x[at], k, reach)
                        bd, bi = _merge_topk(bd, bi, r, dist, at[j])
                        reach = np.minimum(reach, bd[:, k - 1])
                        s, n = s + n, 8
                    rr, kk = np.nonzero(np.isfinite(bd))
                    for c in targets:
                        out.append((qids[rows[rr]], np.full(rr.size, c, np.int32), bd[rr, kk], ids[bi[rr, kk]], x[bi[rr, kk], c]))
        names = ["qid", "c", "dist", "did", "v"]
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out))))) if out else pd.DataFrame(columns=names)
    return fn


def knn_impute(df: DataFrame, columns, k: int = 5, key: str = "row_id", donors: DataFrame | None = None,
               means: dict | None = None) -> DataFrame:
    """Fill missing values of ``columns`` with the mean of the column over
    the ``k`` nearest donors having it (uniform weights); a query with no
    usable donor gets the donor column mean.  Complete rows pass through."""
    columns = list(columns)
    d = len(columns)
    if d == 0:
        return df
    own = donors is None
    donors = donor_table(df, columns, key) if own else donors
    if means is None:
        mrow = donors.agg(*[F.avg(f"_c{i}").alias(f"m{i}") for i in range(d)]).first()
        means = {c: mrow[f"m{i}"] for i, c in enumerate(columns)}
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | col(c).isNull()
    queries = df.filter(any_null).select(col(key).alias("_id"),
                                         *[col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    schema = _schema(queries.schema["_id"].dataType, donors.schema["_id"].dataType, "qid", "c", "dist", "did", "v")
    cand = _search(None if own else queries, donors, d, k, k, _impute_candidates(k, d), schema, per_column=True)
    w = Window.partitionBy("qid", "c").orderBy("dist", "did")
    found = (cand.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
             .groupBy("qid", "c").agg(F.avg("v").alias("v")))
    # written: the join below, and every later use, reads the distances' result, not the search
    wide = stash(found.groupBy(F.col("qid").alias("_qid")).agg(
        *[F.max(F.when(F.col("c") == i, F.col("v"))).alias(f"_k{i}") for i in range(d)]), "filled")
    joined = df.join(wide, col(key) == F.col("_qid"), "left")
    out = []
    for c in df.columns:
        if c in columns:
            i = columns.index(c)
            fill = F.lit(None).cast("double") if means.get(c) is None else F.lit(float(means[c]))
            out.append(F.coalesce(col(c).cast("double"), F.col(f"_k{i}"), fill).alias(c))
        else:
            out.append(col(c))
    return joined.select(*out)


# -- plain kNN over complete vectors (SMOTE / ADASYN) ---------------------------


def _neighbour_candidates(k: int, d: int):
    def exact(q, x, r, j):
        out = np.empty(len(r))
        for s in range(0, len(r), SPREAD):
            a, b = q[r[s:s + SPREAD]], x[j[s:s + SPREAD]]
            diff2 = np.zeros(len(a))
            for c in range(d):
                t = a[:, c] - b[:, c]
                diff2 += t * t
            out[s:s + SPREAD] = np.sqrt(diff2)
        return out

    def fn(qpdf: pd.DataFrame, xpdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qpdf) and len(xpdf):
            xpdf = xpdf.sort_values("_id", kind="stable")
            qx, x_all, ids, qids = _numbers(qpdf, d), _numbers(xpdf, d), xpdf["_id"].to_numpy(), qpdf["_id"].to_numpy()
            place = {key: i for i, key in enumerate(ids)}
            own_all, far = np.array([place.get(key, -1) for key in qids]), qpdf["_far"].to_numpy()
            whole = np.isfinite(x_all).all(axis=1)
            mid = x_all[whole].mean(axis=0) if whole.any() else np.zeros(d)
            xc, qc = x_all - mid, qx - mid
            xn, qn = (xc * xc).sum(axis=1), (qc * qc).sum(axis=1)
            # what rounding can do to the screened squares below, amply
            size = np.sqrt(xn[whole].max(initial=0.0)) + np.sqrt((mid * mid).sum())
            for p in range(0, len(qids), STEP):
                q, own, reach = qx[p:p + STEP], own_all[p:p + STEP], far[p:p + STEP]
                slack = 16 * (d + 8) * np.finfo(float).eps * (np.sqrt(qn[p:p + STEP]) + size) ** 2
                bd, bi = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
                for s in range(0, len(ids), 2 * STEP):
                    x, at = x_all[s:s + 2 * STEP], np.arange(s, min(s + 2 * STEP, len(ids)))
                    with np.errstate(all="ignore"):
                        near = qn[p:p + STEP, None] + xn[None, at] - 2.0 * (qc[p:p + STEP] @ xc[at].T)
                        here = np.flatnonzero((own >= s) & (own < s + len(at)))
                        near[here, own[here] - s] = np.inf              # a row is not its own neighbour
                        limit = reach * reach * (1.0 + 1e-12) + slack
                        if len(at) > k and not np.isfinite(bd[:, k - 1]).all():
                            limit = np.fmin(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2.0 * slack)
                        r, j = np.nonzero(((near <= limit[:, None]) & np.isfinite(near)) | (~np.isfinite(slack[:, None]) & (at[None, :] != own[:, None])))
                    dist = exact(q, x, r, j)
                    good = np.isfinite(dist)
                    bd, bi = _merge_topk(bd, bi, r[good], dist[good], at[j[good]])
                    reach = np.minimum(reach, bd[:, k - 1])
                rr, kk = np.nonzero(np.isfinite(bd))
                out.append(pd.DataFrame({"qid": qids[p:p + STEP][rr], "dist": bd[rr, kk], "did": ids[bi[rr, kk]]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["qid", "dist", "did"])
    return fn


def nearest_neighbours(queries: DataFrame, donors: DataFrame, columns, k: int, key: str = "row_id") -> DataFrame:
    """Exact k nearest donors of every query row (Euclidean, complete
    vectors), excluding the row itself: ``(qid, rank, did, dist)``."""
    columns = list(columns)

    def numbered(df):
        return df.select(col(key).alias("_id"), *[col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])

    q, x = numbered(queries), numbered(donors)
    schema = _schema(q.schema["_id"].dataType, x.schema["_id"].dataType, "qid", "dist", "did")
    # one donor more than k, since a row is not its own neighbour
    cand = _search(None if queries is donors else q, x, len(columns), k, k + 1, _neighbour_candidates(k, len(columns)), schema, per_column=False)
    w = Window.partitionBy("qid").orderBy("dist", "did")
    top = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return stash(top.select("qid", F.col("rank").cast("int").alias("rank"), "did", "dist"), "nearest")
