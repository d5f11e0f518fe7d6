"""Feature attributions.

* linear: ``phi_j = coef_j * (x_j - mean_j)`` as one projection + unpivot;
* tree ensembles: path-dependent tree Shapley values in time linear in the nodes
  (:func:`riskfold.operators.grove.tree_attributions`), one task per bundle of trees and
  block of rows; node tables stay in Spark; or against background rows, which are counted by
  leaf and pattern of satisfied path features;
* any other model: the kernel explainer (row x background draw x coalition → mixed
  rows, one ``transform``, a constrained weighted regression per draw), or
  sampled permutations (row x permutation x prefix length, successive differences).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.exprs import col
from riskfold.operators import grove as GR
from riskfold.operators.split import ranked
from riskfold.session import cut_lineage, ship_package


# -- X1 / X4 / A7 -----------------------------------------------------------------


def linear_attribution(df: DataFrame, coefs: dict, means: dict, key: str = "row_id", ids=()) -> DataFrame:
    """Long table ``(ids..., row_id, feature, value, phi)``."""
    ids = list(ids)
    recs = [F.struct(F.lit(f).alias("feature"), col(f).cast("double").alias("value"),
                     (F.lit(float(c)) * (col(f).cast("double") - F.lit(float(means[f])))).alias("phi"))
            for f, c in coefs.items()]
    return (df.select(*[col(i) for i in ids], col(key), F.explode(F.array(*recs)).alias("r"))
            .select(*ids, key, "r.feature", "r.value", "r.phi"))


def attribution_summary(phi: DataFrame, keys=(), top: int = 40) -> DataFrame:
    """Mean |phi| per feature, ranked descending; the top ``top`` kept."""
    keys = list(keys)
    g = phi.groupBy(*keys, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    w = Window.partitionBy(*keys).orderBy(F.col("mean_abs_phi").desc(), F.col("feature"))
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


ROW_BLOCK = 20_000      # rows that meet a bundle of trees in one task
BACKGROUND_BLOCK = 10_000       # rows that meet a bundle of trees in one task
BUNDLE_LEAVES = 4096

# -- X2 TreeSHAP ---------------------------------------------------------------------


def grove_of(nodes: pd.DataFrame, cuts: list) -> GR.Grove:
    """The trees of a Spark ML node table on bins between its own thresholds (``cuts`` per feature)."""
    nodes = nodes.sort_values(["treeID", "id"])
    tree = nodes["treeID"].to_numpy()
    names, first = np.unique(tree, return_index=True)
    size = np.diff(np.append(first, len(nodes)))
    # roots come first, children of a node are neighbours
    base = np.repeat(first, size)
    left, right = nodes["leftChild"].to_numpy() + base, nodes["rightChild"].to_numpy() + base
    inner = np.flatnonzero(nodes["leftChild"].to_numpy() >= 0)
    place = np.full(len(nodes), -1, np.int64)
    place[first], depth, level, made, order = np.arange(len(names)), np.zeros(len(nodes), np.int32), first, len(names), [first]
    is_inner = np.zeros(len(nodes), bool)
    is_inner[inner] = True
    while len(level):
        some = level[is_inner[level]]
        kids = np.stack([left[some], right[some]], axis=1).ravel()
        place[kids] = made + np.arange(len(kids))
        depth[kids] = np.repeat(depth[some], 2) + 1
        made += len(kids)
        order.append(kids)
        level = kids
    at = np.concatenate(order)
    feat = np.where(is_inner, nodes["feature_index"].fillna(-1).to_numpy(), -1).astype(np.int32)[at]
    edge = np.array([np.nan if t is None or not len(t) else t[0] for t in nodes["threshold"]], float)[at]
    cut = np.zeros(len(at), np.uint16)
    for f in range(len(cuts)):
        mine = feat == f
        cut[mine] = np.searchsorted(cuts[f], edge[mine])
    return GR.Grove(feat, cut, np.where(feat >= 0, place[left[at] * is_inner[at]], 0), nodes["prediction"].to_numpy(float)[at],
                    nodes["rawCount"].to_numpy(float)[at], np.zeros(len(at)), depth[at], np.searchsorted(names, tree[at]), len(names))


def tree_shap(df: DataFrame, features, nodes: DataFrame, key: str = "row_id") -> DataFrame:
    """``(row_id, feature, phi)`` of the mean of a Spark ML forest's trees, given its node table
    (:func:`riskfold.plans.models.tree_nodes`).

    A task holds one bundle of trees (as many as have ``BUNDLE_LEAVES`` leaves together, one at
    least) and one block of rows: the node table is grouped by bundle in Spark, so a row is copied
    once a bundle, and neither nodes nor rows pass the driver.  A task adds up its trees; sums of a
    row over bundles are keyed sums of whole vectors."""
    features = list(features)
    d = len(features)
    spark = df.sparkSession
    ship_package(spark)
    # two numbers per tree
    sizes = nodes.groupBy("treeID").agg(F.count(F.when(F.col("leftChild") < 0, 1)).alias("n")).orderBy("treeID").collect()
    n_trees, bundle = len(sizes), tree_bundles([r["n"] for r in sizes])
    of_tree = F.broadcast(spark.createDataFrame([(int(r["treeID"]), b) for r, b in zip(sizes, bundle)], "treeID int, _bundle int"))
    blocks = max(1, -(-df.count() // ROW_BLOCK))
    rows = df.select(col(key).alias("_k"), F.array(*[col(f).cast("double") for f in features]).alias("_x"),
                     F.pmod(F.xxhash64(col(key)), F.lit(blocks)).cast("int").alias("_block"))
    dealt = rows.withColumn("_bundle", F.explode(F.sequence(F.lit(0), F.lit(max(bundle, default=0)))))
    trees = nodes.join(of_tree, "treeID").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(part: pa.Table, held: pa.Table) -> pa.Table:
        some = part.num_rows if held.num_rows else 0
        phi = np.zeros((some, d))
        if some:
            x = part.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some, d)
            for _, tree in held.drop_columns(["_bundle", "_block"]).to_pandas().groupby("treeID"):
                inner = tree[tree["leftChild"] >= 0]
                edges = np.array([t[0] for t in inner["threshold"]], float)
                cuts = [np.unique(edges[inner["feature_index"].to_numpy() == f]) for f in range(d)]
                bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint16)
                phi += GR.tree_attributions(bins, grove_of(tree, cuts), d)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(some + 1, dtype=np.int32) * d), pa.array(phi.ravel()))
        return pa.table([part.column("_k").slice(0, some), flat], ["_k", "_phi"])

    kind = df.schema[key].dataType.simpleString()
    got = dealt.groupBy("_bundle", "_block").cogroup(trees.groupBy("_bundle", "_block")).applyInArrow(run, f"_k {kind}, _phi array<double>")
    total = got.groupBy("_k").agg(F.array(*[F.sum(F.col("_phi")[j]) for j in range(d)]).alias("_phi"))
    names = F.array(*[F.lit(f) for f in features])
    return total.select("_k", F.posexplode("_phi").alias("_j", "_v")).select(
        F.col("_k").alias(key), F.element_at(names, F.col("_j") + 1).alias("feature"), (F.col("_v") / F.lit(float(n_trees))).alias("phi"))


def expected_value(nodes: DataFrame) -> float:
    """Cover-weighted mean leaf value, averaged over trees: what the attributions start from."""
    root = nodes.filter("id = 0").select("treeID", F.col("rawCount").alias("_n"))
    leaves = nodes.filter("leftChild < 0").join(root, "treeID")
    return leaves.groupBy("treeID").agg(F.sum(F.col("prediction") * F.col("rawCount") / F.col("_n")).alias("v")).agg(F.avg("v")).first()[0]


# -- X2 with background rows ---------------------------------------------------------------


def leaf_boxes(tree: pd.DataFrame) -> list[tuple]:
    """(leaf, value, features, lows, highs) of a node table: a leaf holds the rows with
    ``low < x <= high`` in each feature that its path asks for."""
    at = {int(r.id): r for r in tree.itertuples()}
    out, todo = [], [(0, {})]
    while todo:
        i, box = todo.pop()
        r = at[i]
        if r.leftChild < 0:
            js = sorted(box)
            out.append((i, float(r.prediction), js, [box[j][0] for j in js], [box[j][1] for j in js]))
            continue
        j, cut = int(r.feature_index), float(r.threshold[0])
        lo, hi = box.get(j, (-math.inf, math.inf))
        todo.append((int(r.leftChild), {**box, j: (lo, min(hi, cut))}))
        todo.append((int(r.rightChild), {**box, j: (max(lo, cut), hi)}))
    return out


def box_patterns(x: np.ndarray, js, lows, highs) -> tuple[np.ndarray, np.ndarray]:
    """(distinct patterns of satisfied path features, pattern of each row); missing values go right."""
    held = np.where(np.isnan(x[:, js]), np.inf, x[:, js])
    fits = (held > lows) & (held <= highs)
    if not len(js):
        return np.zeros((1, 0), bool), np.zeros(len(x), np.int64)
    if len(js) <= 12:       # few patterns: numbered as they would sort
        number = fits @ (1 << np.arange(len(js) - 1, -1, -1))
        seen = np.flatnonzero(np.bincount(number, minlength=1 << len(js)))
        place = np.zeros(1 << len(js), np.int64)
        place[seen] = np.arange(len(seen))
        return (seen[:, None] >> np.arange(len(js) - 1, -1, -1)) & 1 == 1, place[number]
    packed = np.ascontiguousarray(np.packbits(fits, axis=1))
    _, first, place = np.unique(packed.view([("", packed.dtype)] * packed.shape[1]).ravel(), return_index=True, return_inverse=True)
    return fits[first], place


def pattern_shapley(rows: np.ndarray, background: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Attributions (row patterns x path features) of a leaf of value 1.

    Against one background pattern a leaf is reached by the coalitions that hold every
    feature which only the row satisfies (``a`` of them) and none that only the background
    satisfies (``b``); where neither satisfies a feature, by none.  Summed over
    orders this gives 1 / (a C(a+b, a)) to the first kind and -1 / (b C(a+b, b)) to the
    second; ``share`` weights the background patterns."""
    u, v = rows.astype(float), background.astype(float)
    m = u.shape[1]
    one, two = np.zeros((m + 1, m + 1)), np.zeros((m + 1, m + 1))
    for a in range(m + 1):
        for b in range(m + 1 - a):
            one[a, b] = 1 / (a * math.comb(a + b, a)) if a else 0
            two[a, b] = 1 / (b * math.comb(a + b, b)) if b else 0
    out = np.zeros_like(u)
    step = max(1, (1 << 22) // max(1, len(u)))
    for at in range(0, len(v), step):
        w, part = v[at:at + step], share[at:at + step]
        a, b = (u @ (1 - w).T).astype(int), ((1 - u) @ w.T).astype(int)
        met = ((1 - u) @ (1 - w).T < 0.5) * part
        out += u * ((one[a, b] * met) @ (1 - w)) - (1 - u) * ((two[a, b] * met) @ w)
    return out


def tree_bundles(leaves, most: int | None = None) -> list[int]:
    """Bundle of each tree: neighbours with at most ``most`` leaves together, or one tree."""
    most, out, held = most or BUNDLE_LEAVES, [], 0
    for n in leaves:
        fresh = bool(out) and held + n > most
        held = n if fresh else held + n
        out.append((out[-1] + fresh) if out else 0)
    return out


def background_shap(df: DataFrame, background: DataFrame, features, nodes: DataFrame, weights=None, key: str = "row_id") -> DataFrame:
    """X2 against background rows: ``(row_id, feature, phi)`` of a Spark ML ensemble's output.

    Interventional tree Shapley values, exact over all ``background`` rows: attributions of
    a row add up to its output minus the mean output of the background.  ``weights`` are
    the trees' weights by number (boosting margins); by default the trees' mean.

    Background rows are grouped by (tree, leaf, pattern of satisfied path features) and
    counted in Spark, so a task meets patterns with counts, never the rows; rows are dealt
    into blocks, and a task holds one block and one bundle of trees: as many as have
    ``BUNDLE_LEAVES`` leaves together, one at least, so rows are copied once a bundle.  The
    work of a leaf is its row patterns times its background patterns."""
    features = list(features)
    d = len(features)
    spark = df.sparkSession
    ship_package(spark)
    # two numbers per tree
    sizes = nodes.groupBy("treeID").agg(F.count(F.when(F.col("leftChild") < 0, 1)).alias("n")).orderBy("treeID").collect()
    weights = [1.0 / len(sizes)] * len(sizes) if weights is None else [float(w) for w in weights]
    scale = F.element_at(F.array(*map(F.lit, weights)), F.col("_tree") + 1)
    bundle = tree_bundles([r["n"] for r in sizes])
    of_tree = F.broadcast(spark.createDataFrame([(int(r["treeID"]), b) for r, b in zip(sizes, bundle)], "_tree int, _bundle int"))

    def boxes_of(tree: pd.DataFrame) -> pd.DataFrame:
        found = leaf_boxes(tree)
        return pd.DataFrame({"_tree": int(tree["treeID"].iloc[0]), "_leaf": [f[0] for f in found], "_value": [f[1] for f in found],
                             "_js": [f[2] for f in found], "_lo": [f[3] for f in found], "_hi": [f[4] for f in found]})

    boxes = cut_lineage(nodes.groupBy("treeID").applyInPandas(
        boxes_of, "_tree int, _leaf int, _value double, _js array<int>, _lo array<double>, _hi array<double>").join(of_tree, "_tree"))

    def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
        blocks = max(1, -(-rows.count() // BACKGROUND_BLOCK))
        cut = rows.select(col(key).alias("_k"), F.array(*[col(f).cast("double") for f in features]).alias("_x"),
                          F.pmod(F.xxhash64(col(key)), F.lit(blocks)).cast("int").alias("_block"))
        return cut.withColumn("_bundle", F.explode(F.sequence(F.lit(0), F.lit(max(bundle, default=0))))), blocks

    def by_block(table: DataFrame, blocks: int):
        return table.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("_bundle", "_block")

    def matrix(part: pa.Table) -> np.ndarray:
        return part.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)

    def count(part: pa.Table, leaves: pa.Table) -> pa.Table:
        out = {"_tree": [], "_leaf": [], "_pattern": [], "_n": []}
        if part.num_rows and leaves.num_rows:
            x = matrix(part)
            for leaf in leaves.to_pylist():
                seen, place = box_patterns(x, leaf["_js"], np.array(leaf["_lo"], float), np.array(leaf["_hi"], float))
                out["_tree"] += [leaf["_tree"]] * len(seen)
                out["_leaf"] += [leaf["_leaf"]] * len(seen)
                out["_pattern"] += [np.packbits(p).tobytes() for p in seen]
                out["_n"] += np.bincount(place, minlength=len(seen)).tolist()
        return pa.table([pa.array(out["_tree"], pa.int32()), pa.array(out["_leaf"], pa.int32()), pa.array(out["_pattern"], pa.binary()),
                         pa.array(out["_n"], pa.int64())], ["_tree", "_leaf", "_pattern", "_n"])

    cells, blocks = dealt(background)
    named = boxes.select("_bundle", "_tree", "_leaf", "_value", "_js", "_lo", "_hi")
    counted = cells.groupBy("_bundle", "_block").cogroup(by_block(named, blocks)).applyInArrow(
        count, "_tree int, _leaf int, _pattern binary, _n long")
    patterns = counted.groupBy("_tree", "_leaf", "_pattern").agg(F.sum("_n").alias("_n")) \
        .groupBy("_tree", "_leaf").agg(F.collect_list("_pattern").alias("_patterns"), F.collect_list("_n").alias("_counts"))
    model = cut_lineage(named.join(patterns, ["_tree", "_leaf"]).withColumn("_value", F.col("_value") * scale))

    kind = df.schema[key].dataType.simpleString()

    def attribute(part: pa.Table, leaves: pa.Table) -> pa.Table:
        x = matrix(part)
        phi = np.zeros((len(x), d))
        for leaf in leaves.to_pylist() if len(x) else []:
            js = leaf["_js"]
            if not js:
                continue
            seen, place = box_patterns(x, js, np.array(leaf["_lo"], float), np.array(leaf["_hi"], float))
            known = np.array([np.unpackbits(np.frombuffer(p, np.uint8), count=len(js)) for p in leaf["_patterns"]], bool)
            n = np.array(leaf["_counts"], float)
            phi[:, js] += (leaf["_value"] * pattern_shapley(seen, known, n / n.sum()))[place]
        some = len(x) if leaves.num_rows else 0
        flat = pa.ListArray.from_arrays(pa.array(np.arange(some + 1, dtype=np.int32) * d), pa.array(phi[:some].ravel()))
        return pa.table([part.column("_k").slice(0, some), flat], ["_k", "_phi"])

    rows, blocks = dealt(df)
    got = rows.groupBy("_bundle", "_block").cogroup(by_block(model, blocks)).applyInArrow(attribute, f"_k {kind}, _phi array<double>")
    names = F.array(*[F.lit(f) for f in features])
    return got.select("_k", F.posexplode("_phi").alias("_j", "_v")).groupBy("_k", "_j").agg(F.sum("_v").alias("phi")).select(
        F.col("_k").alias(key), F.element_at(names, F.col("_j") + 1).alias("feature"), "phi")


# -- X3 kernel explainer --------------------------------------------------------------------

EXACT_FEATURES = 10     # up to so many features every coalition is evaluated


def coalitions(n_features: int, n_samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(masks, weights) of coalitions, neither empty nor whole, with the Shapley kernel.

    All of them up to ``EXACT_FEATURES``; beyond, ``n_samples`` drawn in pairs of a
    coalition and its complement, sizes in proportion to the kernel's mass, equal draws merged."""
    d = n_features
    if d < 2:
        return np.zeros((0, d), bool), np.zeros(0)
    sizes = np.arange(1, d)
    if d <= EXACT_FEATURES:
        masks = (np.arange(1, (1 << d) - 1)[:, None] >> np.arange(d)) & 1 == 1
        k = masks.sum(axis=1)
        return masks, (d - 1) / (np.array([math.comb(d, int(x)) for x in k]) * k * (d - k))
    mass = (d - 1) / (sizes * (d - sizes))
    rng = np.random.default_rng(seed)
    half = np.zeros((max(1, n_samples // 2), d), bool)
    for row, k in zip(half, rng.choice(sizes, len(half), p=mass / mass.sum())):
        row[rng.choice(d, k, replace=False)] = True
    masks, counts = np.unique(np.concatenate([half, ~half]), axis=0, return_counts=True)
    return masks, counts.astype(float)


def kernel_solve(masks: np.ndarray, weights: np.ndarray, values: np.ndarray, none: float, whole: float) -> np.ndarray:
    """Attributions that fit the coalitions' values best (weighted least squares) and add up to ``whole - none``."""
    d = masks.shape[1]
    if d < 2:
        return np.full(d, whole - none)
    z = masks.astype(float)
    # the last attribution follows from the sum: regress on the others
    x = z[:, :-1] - z[:, -1:]
    y = values - none - z[:, -1] * (whole - none)
    root = np.sqrt(weights)
    head = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)[0]
    return np.append(head, whole - none - head.sum())


def kernel_shapley(df: DataFrame, background: DataFrame, features, score_fn, draws: int = 4, n_samples: int = 64, seed: int = 42,
                   key: str = "row_id", score: str = "score") -> DataFrame:
    """Kernel Shapley values of any model: ``(row_id, feature, phi, error)``.

    Each row meets ``draws`` background rows (md5 draw over all of them).  A coalition takes
    its features from the row and the others from the background row; a constrained
    weighted regression per draw gives attributions that add up to ``f(row) - f(background)``,
    and their mean over draws is ``phi``, with its standard error over draws in ``error``
    (null for one draw).  Coalitions are exact up to ``EXACT_FEATURES`` features, else
    ``n_samples`` in pairs, the same for every row.  ``score_fn(DataFrame)`` adds ``score``."""
    features = list(features)
    d = len(features)
    ship_package(df.sparkSession)
    masks, weights = coalitions(d, n_samples, seed)
    every = np.concatenate([np.zeros((1, d), bool), masks, np.ones((1, d), bool)])
    bg = cut_lineage(background.select(col(key).alias("_k"), *[col(f).cast("double").alias(f"_b_{f}") for f in features]))
    n_bg = bg.count()
    bgr = ranked(bg, [], F.md5(F.concat_ws("|", F.col("_k").cast("string"), F.lit(str(seed)))), "_bid").withColumn("_bid", F.col("_bid") - 1).drop("_k")
    x = df.select(col(key).alias(key), *[col(f).cast("double").alias(f) for f in features])
    x = x.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    x = x.withColumn("_bid", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.col(key).cast("string"), F.col("m").cast("string"), F.lit(str(seed)), F.lit("kernel"))), 1, 15), 16, 10).cast("long"), F.lit(n_bg)))
    x = x.join(bgr, "_bid")
    x = x.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1))))
    holds = ["".join("01"[int(v)] for v in every[:, j]) for j in range(d)]       # per feature: which coalitions hold it
    mixed = x.select(key, "m", "c", *[F.when(F.substring(F.lit(holds[j]), F.col("c") + 1, F.lit(1)) == "1", col(f)).otherwise(col(f"_b_{f}")).alias(f)
                                      for j, f in enumerate(features)])
    values = score_fn(mixed).groupBy(key, "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", col(score).alias("v")))), lambda s: s["v"]).alias("v"))

    def solve(batches):
        for pdf in batches:
            phi = [kernel_solve(masks, weights, np.asarray(v[1:-1], float), v[0], v[-1]) for v in pdf["v"]]
            yield pd.DataFrame({key: np.repeat(pdf[key].to_numpy(), d), "feature": np.tile(features, len(pdf)), "phi": np.concatenate(phi) if phi else []})

    kind = df.schema[key].dataType.simpleString()
    per_draw = values.select(key, "v").mapInPandas(solve, f"`{key}` {kind}, feature string, phi double")
    return per_draw.groupBy(key, "feature").agg(F.avg("phi").alias("phi"), (F.stddev_samp("phi") / F.sqrt(F.count("phi"))).alias("error"))


# -- X3 sampled permutations ------------------------------------------------------------


def permutation_shapley(df: DataFrame, background: DataFrame, features, score_fn, n_perm: int = 8,
                        seed: int = 42, key: str = "row_id") -> DataFrame:
    """Shapley values by sampled permutations: ``(row_id, feature, phi)``.

    For each row and permutation, prefix k takes the first k features of the
    permutation from the row and the rest from a background row (md5 draw);
    ``phi`` of the k-th feature is ``f(prefix k) - f(prefix k-1)``, averaged
    over permutations.  ``score_fn(DataFrame) -> DataFrame`` adds ``score``."""
    features = list(features)
    d = len(features)
    bg = cut_lineage(background.select(col(key).alias("_k"), *[col(f).cast("double").alias(f"_b_{f}") for f in features]))
    n_bg = bg.count()
    order = F.md5(F.concat_ws("|", F.col("_k").cast("string"), F.lit(str(seed))))
    bgr = ranked(bg, [], order, "_bid").withColumn("_bid", F.col("_bid") - 1).drop("_k")
    x = df.select(col(key).alias(key), *[col(f).cast("double").alias(f) for f in features])
    x = x.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    x = x.withColumn("_bid", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(
        "|", F.col(key).cast("string"), F.col("m").cast("string"), F.lit(str(seed)), F.lit("bg"))), 1, 15), 16, 10)
        .cast("long"), F.lit(n_bg)))
    x = x.join(bgr, "_bid")  # draws are spread evenly over the background rows
    keyed = F.array(*[F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("m").cast("string"),
                                                  F.lit(str(seed)), F.lit(j))).alias("h"), F.lit(j).alias("j"))
                      for j in range(d)])
    x = x.withColumn("perm", F.transform(F.array_sort(keyed), lambda s: s["j"]))
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(d))))
    mixed = x.select(key, "m", "k", "perm", *[
        F.when(F.array_position("perm", j) <= F.col("k"), F.col(f)).otherwise(F.col(f"_b_{f}")).alias(f)
        for j, f in enumerate(features)])
    scored = score_fn(mixed)
    w = Window.partitionBy(key, "m").orderBy("k")
    diffs = (scored.withColumn("diff", F.col("score") - F.lag("score").over(w))
             .filter(F.col("k") > 0)
             .withColumn("j", F.element_at("perm", F.col("k"))))
    names = F.array(*[F.lit(f) for f in features])
    return (diffs.groupBy(key, "j").agg(F.avg("diff").alias("phi"))
            .select(key, F.element_at(names, F.col("j") + 1).alias("feature"), "phi"))
