"""Boosting with the exponential loss (M4b), which Spark's GBT does not offer.

Discrete AdaBoost: each round fits a shallow weighted tree, computes its
weighted error, and updates the row weights as ``w * exp(-alpha * y * h(x))``.

Up to ``ML_ROWS`` rows a round is a Spark ML tree: the weighted error is one
aggregate, and the weighted rows are checkpointed after each round, since the
weight column's lineage grows by one model per round.

Above, the rows are packed once into blocks, and a round is one pass per tree
level: tasks add up class weights per (open node, feature, bin), the driver
chooses the cuts by the rules of Spark ML's classifier tree (weighted quantiles
of a fresh sample of ``SAMPLE`` rows a round, gini, first of equal gains).  The
weighted error follows from the leaves.  A pass recomputes weights from those
kept with the blocks, which are renewed every ``RENEW`` rounds.  Where the sample
is the whole table both ways fit the same trees.

The score is ``1 / (1 + exp(-2 F(x)))`` with ``F = sum(alpha_m h_m(x))``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.session import cut_lineage, ship_package, stash

ML_ROWS = 50_000        # training rows up to which a round is a fit of Spark ML
BINS = 32               # bins of a feature, the default of Spark ML
SAMPLE = 10_000         # rows (expected) that place a round's cuts, as in Spark ML
RENEW = 16              # rounds between renewals of the weights kept with the blocks
CELLS = 1 << 16         # (node, feature, bin) cells of a pass up to which blocks are used
WIDTH = 1024            # features up to which blocks are used
BLOCK = 1 << 23         # bytes of features in a block
TASK = 1 << 26          # bytes of features in a task, once every core has two tasks


@dataclass
class WeightedTree:
    """A weighted classifier tree as a node table (node 0 is the root, ``feat`` is -1 at a leaf)."""

    feat: list
    cut: list       # rows with a value of at most ``cut`` go left
    left: list
    right: list
    vote: list      # class of the larger weight
    gain: list
    cover: list     # weight
    width: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Node where each row ends (``x``: features x rows)."""
        out = np.zeros(x.shape[1], np.int64)
        todo = [(0, None)]
        while todo:
            k, at = todo.pop()
            if self.feat[k] < 0:
                out[slice(None) if at is None else at] = k
                continue
            v = x[self.feat[k]]
            low = (v if at is None else v[at]) <= self.cut[k]
            todo += [(self.left[k], np.flatnonzero(low) if at is None else at[low]), (self.right[k], np.flatnonzero(~low) if at is None else at[~low])]
        return out

    def votes(self, x: np.ndarray) -> np.ndarray:
        """-1 or 1 of each row."""
        return (2.0 * np.array(self.vote) - 1.0)[self.leaf(x)]

    @property
    def featureImportances(self) -> DenseVector:
        out = np.zeros(self.width)
        for f, g, c in zip(self.feat, self.gain, self.cover):
            if f >= 0:
                out[f] += g * c
        return DenseVector(out / out.sum() if out.sum() > 0 else out)

    SCHEMA = "id int, feature int, threshold double, leftChild int, rightChild int, prediction int, gain double, weight double"

    def rows(self) -> list:
        return [(i, int(f), float(c), int(a), int(b), int(v), float(g), float(w)) for i, (f, c, a, b, v, g, w) in enumerate(
            zip(self.feat, self.cut, self.left, self.right, self.vote, self.gain, self.cover))]


@dataclass
class ExpBoost:
    stages: list          # [(tree model, alpha)]

    def score(self, df: DataFrame, features="features") -> DataFrame:
        cols = df.columns
        if self.stages and isinstance(self.stages[0][0], WeightedTree):
            ship_package(df.sparkSession)
            stages, width = self.stages, self.stages[0][0].width

            @F.pandas_udf("double")
            def total(x: pd.Series) -> pd.Series:
                rows = np.ascontiguousarray(np.stack(x.to_numpy()).T) if len(x) else np.zeros((width, 0))
                out = np.zeros(rows.shape[1])
                for tree, alpha in stages:
                    out += alpha * tree.votes(rows)
                return pd.Series(out)

            cur = df.withColumn("_F", total(vector_to_array(F.col(features))))
        else:
            cur = df.withColumn("_F", F.lit(0.0))
            for i, (m, a) in enumerate(self.stages):
                m = m.copy()
                m.setPredictionCol(f"_h{i}").setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_p{i}")
                cur = m.transform(cur)
                cur = cur.withColumn("_F", F.col("_F") + F.lit(a) * (2 * F.col(f"_h{i}") - 1)).select(*cols, "_F")
        return cur.select(*cols, (F.lit(1.0) / (F.lit(1.0) + F.exp(-2 * F.col("_F")))).alias("score"))


def fit_exp_boost(train: DataFrame, n_rounds: int = 50, max_depth: int = 3, learning_rate: float = 1.0,
                  label: str = "y", features: str = "features", seed: int = 42) -> ExpBoost:
    """Fit ``n_rounds`` weighted trees on ``train`` (0/1 label, assembled features)."""
    first = train.select(features).first()
    width = first[0].size if first else 0
    if 0 < width <= WIDTH and (width << max(0, max_depth - 1)) * BINS <= CELLS:
        n = train.count()
        if n > ML_ROWS:
            return _fit_blocks(train, n, width, n_rounds, max_depth, learning_rate, label, features, seed)
    ys = 2 * F.col(label).cast("double") - 1
    cur = train.select(features, F.col(label).cast("double").alias(label), F.lit(1.0).alias("_w"))
    stages = []
    for r in range(n_rounds):
        tree = DecisionTreeClassifier(featuresCol=features, labelCol=label, weightCol="_w", maxDepth=max_depth,
                                      seed=seed + r, predictionCol="_h", rawPredictionCol="_raw",
                                      probabilityCol="_prob").fit(cur)
        pred = tree.transform(cur).select(features, label, "_w", "_h")
        h = 2 * F.col("_h") - 1
        agg = pred.agg(F.sum(F.when(h != ys, F.col("_w")).otherwise(0.0)).alias("e"), F.sum("_w").alias("t")).first()
        alpha = _alpha(agg["e"] or 0.0, agg["t"], learning_rate)
        if alpha is None:
            break
        stages.append((tree, alpha))
        cur = pred.select(features, label, (F.col("_w") * F.exp(-F.lit(alpha) * ys * h) / F.lit(agg["t"]))
                          .alias("_w"))
        cur = cut_lineage(cur)
    return ExpBoost(stages)


def _alpha(wrong: float, total: float, rate: float) -> float | None:
    """Weight of a tree, or None if it is no better than chance."""
    err = min(max(wrong / total, 1e-10), 1 - 1e-10)
    return None if err >= 0.5 else rate * 0.5 * math.log((1 - err) / err)


# -- rounds by passes over blocks -----------------------------------------------------------


def _pack(train: DataFrame, n: int, width: int, label: str, features: str) -> DataFrame:
    """(block, x, y, w): blocks of rows, features by column, every weight 1."""
    most = max(1, BLOCK // (8 * width))

    def run(batches):
        held, size, number = [], 0, 0
        part = TaskContext.get().partitionId()

        def block():
            x, y = (np.concatenate(v) for v in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), *[pa.array([v.tobytes()], pa.binary()) for v in (
                np.ascontiguousarray(x.T), y.astype(np.int8), np.ones(len(y)))]], ["block", "x", "y", "w"])

        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("labels are 0 or 1")
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width)
            for low in range(0, len(y), most):
                held.append((x[low:low + most], y[low:low + most]))
                size += len(held[-1][1])
                if size >= most:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    spark = train.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n * 8 * width // TASK))
    rows = train.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    rows = rows.coalesce(tasks) if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
    return _held(rows.mapInArrow(run, "block long, x binary, y binary, w binary"))


def _held(blocks: DataFrame) -> DataFrame:
    """Written blocks, kept by the executors too: every pass reads them."""
    return stash(blocks, "boost").persist(StorageLevel.MEMORY_AND_DISK)


def _blocks(batches, width: int, since):
    """(number, features x rows, classes, weights) of every block; ``since``: stages that the kept weights lack."""
    for batch in batches:
        for number, x, y, w in zip(*(batch.column(c).to_pylist() for c in ("block", "x", "y", "w"))):
            x, y, w = np.frombuffer(x).reshape(width, -1), np.frombuffer(y, np.int8), np.frombuffer(w)
            yield number, x, y, _reweighted(x, y, w, since)


def _reweighted(x, y, w, stages) -> np.ndarray:
    for tree, alpha, total in stages:
        w = w * np.where(tree.votes(x) == 2.0 * y - 1.0, math.exp(-alpha), math.exp(alpha)) / total
    return w


def _drawn(number: int, x, y, w, share: float, seed: int) -> pa.RecordBatch:
    """A block's rows of the sample that places a round's cuts, as (values, class, weight)."""
    some = np.flatnonzero(np.random.default_rng([seed, number]).random(len(y)) < share)
    return _record(1, np.concatenate([x[:, some], y[None, some], w[None, some]]))


def _record(kind: int, table: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([table.astype(float).tobytes()], pa.binary())], ["kind", "table"])


def _cuts(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Thresholds of a feature: between all values where there are few, else at weighted quantiles."""
    there = ~np.isnan(values)
    v, at = np.unique(values[there], return_inverse=True)
    if len(v) < 2:
        return np.zeros(0)
    mid = (v[:-1] + v[1:]) / 2.0
    if len(mid) < BINS:
        return mid
    c = np.cumsum(np.bincount(at, weights[there]))
    near, picked, last = c[:-1] + c[1:], [], -1      # a cut goes where the running weight is nearest to its share
    for k in range(1, BINS):
        last = max(last + 1, int(np.searchsorted(near, 2.0 * k * c[-1] / BINS, side="right")))
        if last >= len(near):
            break
        picked.append(last)
    return mid[picked]


def _gini(a, b):
    t = a + b
    return 1.0 - (a / t) ** 2 - (b / t) ** 2


def _sums(table: DataFrame, width: int, since, cuts, tree: WeightedTree, wave, share: float, seed: int | None):
    """One pass: (class 0, class 1, rows) of every (node of ``wave``, feature, bin), and with ``seed`` the next round's sample."""
    slot = np.full(len(tree.feat), -1, np.int64)
    slot[wave] = np.arange(len(wave))
    size = len(wave) * BINS

    def run(batches):
        total, some = np.zeros((3, width, size)), False
        for number, x, y, w in _blocks(batches, width, since):
            some = True
            own = slot[tree.leaf(x)]
            keep = np.flatnonzero(own >= 0)
            whole = len(keep) == len(y)
            base, wk, one = own[keep] * BINS, w[keep], y[keep] == 1
            first, second = np.where(one, 0.0, wk), np.where(one, wk, 0.0)
            for f in range(width):
                cell = base + np.searchsorted(cuts[f], x[f] if whole else x[f][keep])
                total[0, f] += np.bincount(cell, first, size)
                total[1, f] += np.bincount(cell, second, size)
                total[2, f] += np.bincount(cell, minlength=size)
            if seed is not None:
                yield _drawn(number, x, y, w, share, seed)
        if some:
            yield _record(0, total)

    got = table.mapInArrow(run, "kind int, table binary").collect()
    total = sum(np.frombuffer(r["table"]) for r in got if r["kind"] == 0).reshape(3, width, len(wave), BINS)
    return total, [np.frombuffer(r["table"]).reshape(width + 2, -1) for r in got if r["kind"] == 1]


def _tree(table: DataFrame, width: int, since, cuts, max_depth: int, share: float, seed: int):
    """A round's tree level by level; returns it, its class weights by node and the next round's sample."""
    tree = WeightedTree([-1], [0.0], [0], [0], [0], [0.0], [0.0], width)
    weights, depth, wave, sample = [None], 0, [0], []
    places = np.array([len(c) for c in cuts])
    usable = np.arange(BINS)[None, :] < places[:, None]
    while wave:
        last = depth + 1 >= max_depth
        total, drawn = _sums(table, width, since, cuts, tree, wave, share, None if depth else seed)
        sample += drawn
        run = np.cumsum(total, axis=3)
        following = []
        for at, k in enumerate(wave):
            a, b, n = run[:, :, at]
            if weights[k] is None:
                weights[k] = (a[0, -1], b[0, -1])
            ra, rb, rn = a[:, -1:] - a, b[:, -1:] - b, n[:, -1:] - n
            with np.errstate(divide="ignore", invalid="ignore"):
                lw, rw = a + b, ra + rb
                gain = _gini(*weights[k]) - lw / (lw + rw) * _gini(a, b) - rw / (lw + rw) * _gini(ra, rb)
            gain = np.where(usable & (n >= 1) & (rn >= 1) & (gain > 0), gain, -np.inf)
            f, s = np.unravel_index(np.argmax(gain), gain.shape)
            if max_depth < 1 or not np.isfinite(gain[f, s]):
                continue
            tree.feat[k], tree.cut[k], tree.gain[k] = int(f), float(cuts[f][s]), float(gain[f, s])
            tree.left[k], tree.right[k] = len(tree.feat), len(tree.feat) + 1
            for side in ((a[f, s], b[f, s]), (ra[f, s], rb[f, s])):
                for column, new in zip((tree.feat, tree.cut, tree.left, tree.right, tree.vote, tree.gain, tree.cover), (-1, 0.0, 0, 0, 0, 0.0, 0.0)):
                    column.append(new)
                weights.append(side)
                if not last and abs(_gini(*side)) >= np.finfo(float).eps:
                    following.append(len(tree.feat) - 1)
        wave, depth = following, depth + 1
    tree.vote = [int(b > a) for a, b in weights]
    tree.cover = [a + b for a, b in weights]
    for k in reversed(range(len(tree.feat))):      # leaves of one node that vote alike are one leaf
        l, r = tree.left[k], tree.right[k]
        if tree.feat[k] >= 0 and tree.feat[l] < 0 and tree.feat[r] < 0 and tree.vote[l] == tree.vote[r]:
            tree.feat[k], tree.vote[k] = -1, tree.vote[l]
    return tree, weights, sample


def _fit_blocks(train: DataFrame, n: int, width: int, n_rounds: int, max_depth: int, rate: float, label: str, features: str, seed: int) -> ExpBoost:
    ship_package(train.sparkSession)
    table, share = _pack(train, n, width, label, features), min(1.0, SAMPLE / n)
    since: list = []      # stages that the weights of the blocks lack
    stages: list = []

    def first(batches):
        for number, x, y, w in _blocks(batches, width, ()):
            yield _drawn(number, x, y, w, share, seed)

    drawn = [np.frombuffer(r["table"]).reshape(width + 2, -1) for r in table.mapInArrow(first, "kind int, table binary").collect()]
    for r in range(n_rounds):
        rows = np.concatenate(drawn, axis=1)
        cuts = [_cuts(rows[f], rows[-1]) for f in range(width)]
        tree, weights, drawn = _tree(table, width, since, cuts, max_depth, share, seed + r + 1)
        total = weights[0][0] + weights[0][1]
        alpha = _alpha(_wrong(tree, weights), total, rate)
        if alpha is None:
            break
        stages.append((tree, alpha))
        since = [*since, (tree, alpha, total)]
        drawn = [np.concatenate([d[:-1], _reweighted(d[:-2], d[-2], d[-1], since[-1:])[None, :]]) for d in drawn]
        if len(since) == RENEW and r + 1 < n_rounds:
            old, table, since = table, _renewed(table, width, since), []
            old.unpersist()
    table.unpersist()
    return ExpBoost(stages)


def _wrong(tree: WeightedTree, weights) -> float:
    """Weight of the rows that a tree gets wrong."""
    out, todo = 0.0, [0]
    while todo:
        k = todo.pop()
        if tree.feat[k] >= 0:
            todo += [tree.left[k], tree.right[k]]
        else:
            out += weights[k][1 - tree.vote[k]]
    return float(out)


def _renewed(table: DataFrame, width: int, since) -> DataFrame:
    """The blocks with their weights after ``since``."""
    def run(batches):
        for number, x, y, w in _blocks(batches, width, since):
            yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([v.tobytes()], pa.binary()) for v in (x, y, w)]], ["block", "x", "y", "w"])

    return _held(table.mapInArrow(run, "block long, x binary, y binary, w binary"))
