"""Keyed fitting: tree growth against plain recursion, boosting and elastic net against
numpy, attributions against enumeration, units against single fits, growth by passes
against growth in one task."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.operators import grove as GR
from riskfold.plans import evaluate as EV
from riskfold.plans import models as MO
from riskfold.plans import units as UN
from riskfold.plans.evaluate import EvalConfig, evaluate
from riskfold.sources.cohorts import order_cohort
from tests.conftest import SF001

FEATS = ["total", "acctbal", "lines", "qty", "half"]


def cohort(n=240, d=4, seed=0, levels=9):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, levels, (n, d)).astype(np.uint8)
    bins[:, -1] %= 2
    y = (rng.random(n) < 0.15 + 0.08 * bins[:, 0]).astype(np.int64)
    table = GR.Bins([np.arange(levels - 1.0)] * (d - 1) + [np.array([0.0])], [levels - 1.0] * (d - 1) + [1.0])
    return bins, y, table


# -- growth ---------------------------------------------------------------------------


def purity(a, b, criterion):
    t = a + b
    if criterion == "gini":
        return (a * a + b * b) / t
    return sum(c * np.log2(c / t) for c in (a, b) if c)


def plain_tree(bins, y, w, ids, weights, p, table, depth=0):
    """One tree by recursion, every cut tried by itself."""
    n0, n1 = int(w[y == 0].sum()), int(w[y == 1].sum())
    w0, w1 = weights
    value = n1 * w1 / (n0 * w0 + n1 * w1)
    if not n0 or not n1 or (p["max_depth"] is not None and depth >= p["max_depth"]):
        return value
    order = GR.candidate_order(np.array([ids]), bins.shape[1], GR.n_candidates(p["max_features"], bins.shape[1]))[0]
    tried, best, looked = GR.n_candidates(p["max_features"], bins.shape[1]), None, 0
    for f in order:
        if looked >= tried and best is not None:
            break
        looked += 1
        present = np.unique(bins[w > 0, f])
        if len(present) < 2:
            continue
        cuts = present[:-1]
        if p.get("splitter") == "random":
            u = GR.unit_interval(GR.mix(GR.mix(np.array([ids])) + np.array([f], np.uint64) * np.uint64(0xD1B54A32D192ED03)))[0]
            a, b = table.values[f, present[0]], table.values[f, present[-1]]
            t = a + u * (b - a)
            cuts = [max(k for k in range(present[0], present[-1]) if k == present[0] or table.values[f, k] <= t)]
        for c in cuts:
            left = bins[:, f] <= c
            l0, l1 = int(w[left & (y == 0)].sum()), int(w[left & (y == 1)].sum())
            s = purity(l0 * w0, l1 * w1, p["criterion"]) + purity((n0 - l0) * w0, (n1 - l1) * w1, p["criterion"])
            if best is None or s > best[0] + 1e-12:
                best = (s, f, c)
    if best is None:
        return value
    _, f, c = best
    up = GR.mix(np.array([ids]))
    some = bins[:, f] <= c
    return (f, c, *[plain_tree(bins[m], y[m], w[m], GR.mix(up + np.uint64(k))[0], weights, p, table, depth + 1) for k, m in ((1, some), (2, ~some))])


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2 + (row[tree[0]] > tree[1])]
    return tree


@pytest.mark.parametrize("splitter", ["best", "random"])
@pytest.mark.parametrize("criterion", ["gini", "entropy"])
@pytest.mark.parametrize(("max_depth", "max_features", "bootstrap"), [(None, None, False), (3, "sqrt", True), (None, "log2", True)])
def test_trees_equal_recursion(splitter, criterion, max_depth, max_features, bootstrap):
    bins, y, table = cohort()
    p = {"criterion": criterion, "max_depth": max_depth, "max_features": max_features, "splitter": splitter}
    ids, weights = np.arange(len(y)) * 7, (1.3, 0.8)
    trees = GR.fit_forest(bins, y, ids, 5, range(3), p, weights, table, bootstrap)
    roots = GR.root_ids(5, np.arange(3))
    for t in range(3):
        w = GR.bootstrap_weights(ids, roots[t:t + 1])[0] if bootstrap else np.ones(len(y), int)
        plain = plain_tree(bins[w > 0], y[w > 0], w[w > 0], roots[t], weights, p, table)
        np.testing.assert_allclose(trees.value[trees.walk(bins)[t]], [plain_value(plain, r) for r in bins], atol=1e-12)


def test_growth_ignores_order_and_company():
    bins, y, table = cohort(500)
    p = {"criterion": "gini", "max_depth": None, "max_features": "sqrt"}
    ids = np.arange(len(y))
    all_ = GR.fit_forest(bins, y, ids, 1, range(6), p, (1, 1), table, True)
    one = GR.fit_forest(bins[::-1], y[::-1], ids[::-1], 1, range(4, 5), p, (1, 1), table, True)
    assert (all_.value[all_.walk(bins)[4]] == one.value[one.walk(bins)[0]]).all()
    cut = GR.fit_forest(bins, y, ids, 1, range(6), {**p, "max_depth": 3}, (1, 1), table, True)
    assert (cut.value[cut.walk(bins)] == all_.value[all_.walk(bins, depth=3)]).all()
    assert abs(all_.importances(4).sum() - 1) < 1e-9


def test_bootstrap_weights_are_poisson():
    w = GR.bootstrap_weights(np.arange(200_000), GR.root_ids(0, np.array([0, 1])))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w)[0, 1]) < 0.01


@pytest.mark.parametrize("loss", ["log_loss", "exponential"])
def test_boosting_equals_numpy_and_lowers_the_loss(loss):
    bins, y, table = cohort(300)
    p = {"loss": loss, "learning_rate": 0.3, "n_estimators": 12, "max_depth": 2, "max_features": None}
    start, trees = GR.fit_boost(bins, y, 0, p, table)
    margin, yf = np.full(len(y), start), y.astype(float)

    def residual(m):
        sign = 2 * yf - 1
        return (sign * np.exp(-sign * m), np.exp(-sign * m)) if loss == "exponential" else (
            yf - 1 / (1 + np.exp(-m)), np.exp(-m) / (1 + np.exp(-m)) ** 2)

    def leaves(rows, g, depth):
        if depth == 2 or len(rows) < 2:
            return [rows]
        best = None
        for f in range(bins.shape[1]):
            for c in np.unique(bins[rows, f])[:-1]:
                m = bins[rows, f] <= c
                s = g[rows][m].sum() ** 2 / m.sum() + g[rows][~m].sum() ** 2 / (~m).sum()
                if best is None or s > best[0] + 1e-9:
                    best = (s, m)
        return [rows] if best is None else leaves(rows[best[1]], g, depth + 1) + leaves(rows[~best[1]], g, depth + 1)

    losses = [GR.boost_loss(yf, margin, loss)]
    for t in trees:
        g, h = residual(margin)
        step = np.zeros(len(y))
        for rows in leaves(np.arange(len(y)), g, 0):
            step[rows] = g[rows].sum() / h[rows].sum()
        np.testing.assert_allclose(t.value[t.walk(bins)[0]], step, atol=1e-4)
        margin = margin + 0.3 * t.value[t.walk(bins)[0]]
        losses.append(GR.boost_loss(yf, margin, loss))
    assert all(b < a for a, b in zip(losses, losses[1:]))
    got = GR.boost_margins(start, trees, 0.3, bins, (5, 12))
    np.testing.assert_allclose(got[12], margin)


def test_attributions_equal_enumeration():
    bins, y, table = cohort(400, 5)
    g = GR.fit_forest(bins, y, np.arange(400), 3, range(3), {"criterion": "gini", "max_depth": None, "max_features": "sqrt"}, (1.2, 0.8), table, True)
    phi = GR.tree_attributions(bins[:6], g, 5, cells=4000)

    def game(node, row, known):
        if g.feat[node] < 0:
            return g.value[node]
        left = g.left[node]
        if g.feat[node] in known:
            return game(left + (row[g.feat[node]] > g.cut[node]), row, known)
        return (g.cover[left] * game(left, row, known) + g.cover[left + 1] * game(left + 1, row, known)) / g.cover[node]

    for r, i in itertools.product(range(3), range(5)):
        others = [j for j in range(5) if j != i]
        want = sum(math.factorial(k) * math.factorial(4 - k) / math.factorial(5)
                   * sum(game(t, bins[r], {*s, i}) - game(t, bins[r], set(s)) for t in range(3))
                   for k in range(5) for s in itertools.combinations(others, k))
        assert abs(want - phi[r, i]) < 1e-10


# -- elastic net ------------------------------------------------------------------------


@pytest.mark.parametrize("ratio", [0.0, 0.5, 1.0])
def test_newton_steps_reach_the_optimum(ratio):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.ones((200, 1)), rng.normal(size=(200, 5))], axis=1)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [0.3, 1, -1, 0.5, 0, 0])))).astype(float)
    lam, beta = 0.02, np.zeros(6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = UN.newton_step(beta, x.T @ (p - y) / 200, (x.T * (p * (1 - p))) @ x / 200, lam, ratio)
    grad = x.T @ (1 / (1 + np.exp(-x @ beta)) - y) / 200
    assert abs(grad[0]) < 1e-8
    for j in range(1, 6):      # optimality of the penalised loss
        g = grad[j] + lam * (1 - ratio) * beta[j]
        assert abs(g + lam * ratio * np.sign(beta[j])) < 1e-7 if beta[j] else abs(g) <= lam * ratio + 1e-9


# -- units ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def orders(spark):
    df = order_cohort(spark, SF001).na.fill(0.0).withColumn("half", (F.col("half") == "H1").cast("double"))
    scaled = [((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c in FEATS for m, s in [df.agg(F.avg(c), F.stddev_pop(c)).first()]]
    return df.select("row_id", *scaled, "returned", "pending").persist()


SMALL = {"forest": {"n_estimators": 5}, "gbt": {"n_estimators": 6}}


@pytest.fixture(scope="module")
def result(orders):
    return evaluate(orders, FEATS, ["returned", "pending"], EvalConfig(seeds=(0, 7), n_outer=2, n_inner=3, attribution=True, overrides=SMALL))


def collected(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_units_equal_single_fits(spark, orders, result):
    plan = EV.nested_fold_plan(orders, ["returned", "pending"], (0, 7), 2, 3, 0.2)
    part = plan.filter("endpoint = 'pending' AND seed = 7 AND outer_fold = 1 AND role = 'train'").join(orders, "row_id").toPandas()
    table = UN.fit_bins(orders, FEATS)
    fit, held = part[part.inner_fold != 2], part[part.inner_fold == 2]
    y = fit.y.astype(int).to_numpy()
    bins, ids = table.of(fit[FEATS].to_numpy()), fit.row_id.to_numpy()
    weights = GR.class_weights((y == 0).sum(), (y == 1).sum(), True)
    spec = MO.ModelSpec.of("forest", n_estimators=5)
    trees = GR.fit_forest(bins, y, ids, 7, range(5), spec.p, weights, table, True)
    xs = table.of(held[FEATS].to_numpy())
    own = dict(zip(held.row_id, trees.value[trees.walk(xs)].mean(axis=0)))
    start, boost = GR.fit_boost(bins, y, 7, MO.ModelSpec.of("gbt", n_estimators=6).p, table)
    boosted = dict(zip(held.row_id, GR.boost_score(GR.boost_margins(start, boost, 0.1, xs, (6,))[6], "log_loss")))
    got = result.validation.filter("endpoint = 'pending' AND seed = 7 AND outer_fold = 1 AND inner_fold = 2").toPandas()
    for model, want in (("forest", own), ("gbt", boosted)):
        rows = got[got.model == model]
        assert dict(zip(rows.row_id, rows.score)) == pytest.approx(want, abs=1e-12) and len(rows) == len(held)
    # elastic net: the optimum of the same loss
    x = np.concatenate([np.ones((len(fit), 1)), fit[FEATS].to_numpy()], axis=1)
    w, beta = np.where(y == 1, weights[1], weights[0]), np.zeros(6)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = UN.newton_step(beta, x.T @ (w * (p - y)) / w.sum(), (x.T * (w * p * (1 - p))) @ x / w.sum(), 1 / len(fit), 0.0)
    linear = dict(zip(held.row_id, 1 / (1 + np.exp(-(held[FEATS].to_numpy() @ beta[1:] + beta[0])))))
    rows = got[got.model == "logistic"]
    assert dict(zip(rows.row_id, rows.score)) == pytest.approx(linear, abs=1e-7)


def test_every_model_is_attributed_and_adds_up(result):
    rows = result.attributions.groupBy("model", "endpoint", "seed", "outer_fold", "row_id").agg(F.sum("phi").alias("s")).join(
        result.test, ["model", "endpoint", "seed", "outer_fold", "row_id"])
    margin = F.when(F.col("model").isin("gbt", "logistic"), F.log(F.col("raw_score") / (1 - F.col("raw_score")))).otherwise(F.col("raw_score"))
    spread = rows.withColumn("base", margin - F.col("s")).groupBy("model", "endpoint", "seed", "outer_fold").agg(F.stddev_pop("base").alias("sd")).collect()
    assert {r.model for r in spread} == {"tree", "forest", "gbt", "logistic"} and max(r.sd for r in spread) < 1e-9


def test_calibration_of_all_units_equals_single_calibration(orders, result):
    rows = result.test.filter("model = 'logistic'").select("endpoint", "seed", "outer_fold", "y", F.col("raw_score").alias("margin"))
    got = UN.platt_keyed(rows, ["endpoint", "seed", "outer_fold"])
    assert len(got) == 8
    for key in list(got)[:2]:
        one = rows.filter((F.col("endpoint") == key[0]) & (F.col("seed") == key[1]) & (F.col("outer_fold") == key[2]))
        np.testing.assert_allclose(got[key], MO.platt_fit(one), rtol=1e-5)


def test_growth_by_passes_equals_growth_in_a_task(orders, monkeypatch):
    over = {"tree": {"splitter": "random"}, "forest": {"n_estimators": 3, "criterion": "entropy"}, "gbt": {"n_estimators": 3, "loss": "exponential"}}
    cfg = EvalConfig(models=("tree", "forest", "gbt"), n_outer=1, n_inner=2, overrides=over)
    want = evaluate(orders, FEATS, ["returned"], cfg)
    monkeypatch.setattr(UN, "LOCAL_ROWS", 150)
    got = evaluate(orders, FEATS, ["returned"], cfg)
    for name in ("validation", "test"):
        a, b = (getattr(x, name).orderBy("model", *[c for c in ("inner_fold",) if name == "validation"], "row_id").toPandas() for x in (got, want))
        np.testing.assert_allclose(a.score, b.score, rtol=1e-7)     # exp of a vector may differ in its last bit
        assert a.drop(columns=["score", "raw_score"], errors="ignore").equals(b.drop(columns=["score", "raw_score"], errors="ignore"))
    a, b = (sorted((r.model, r.feature, r.importance) for r in x.importances.collect()) for x in (got, want))
    assert [r[:2] for r in a] == [r[:2] for r in b]
    np.testing.assert_allclose([r[2] for r in a], [r[2] for r in b], atol=1e-9)
    with pytest.raises(ValueError):
        evaluate(orders, FEATS, ["returned"], EvalConfig(models=("tree",), n_outer=1, n_inner=2, attribution=True)).attributions.count()


def test_attributions_of_large_groups_equal_those_of_a_task(orders, monkeypatch):
    from riskfold.plans import canopy
    over = {"tree": {"max_depth": 6}, "forest": {"n_estimators": 3}, "gbt": {"n_estimators": 3}}
    cfg = EvalConfig(models=("tree", "forest", "gbt", "logistic"), n_outer=2, n_inner=2, attribution=True, attribute_large=True, overrides=over)
    want = evaluate(orders, FEATS, ["returned"], cfg)
    for name, value in ((UN, "LOCAL_ROWS"), 150), ((canopy, "ROW_BLOCK"), 90), ((canopy, "BUNDLE_NODES"), 400):
        monkeypatch.setattr(*name, value)
    got = evaluate(orders, FEATS, ["returned"], cfg)
    keys = ["model", "outer_fold", "row_id", "feature"]
    a, b = (x.attributions.toPandas().sort_values(keys) for x in (got, want))
    assert len(a) == len(b) > 0 and (a[keys].to_numpy() == b[keys].to_numpy()).all()
    np.testing.assert_allclose(a.phi, b.phi, atol=1e-7)
    for k in ("test", "importances"):
        assert getattr(got, k).count() == getattr(want, k).count()


def test_units_get_partitions_of_their_own(spark):
    for n in (1, 6, 50):
        keys = UN.even_keys(n)
        rows = spark.createDataFrame([(k,) for k in keys * 3], "u int").repartition(n, "u")
        assert rows.select(F.spark_partition_id().alias("p"), "u").distinct().groupBy("p").count().collect() and len(set(keys)) == n
        assert {r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()} == {3}


def test_histograms_of_parts_add_up(monkeypatch):
    bins, y, table = cohort(500)
    p = {"criterion": "gini", "max_depth": None, "max_features": "sqrt", "splitter": "random"}
    boost = {"loss": "log_loss", "learning_rate": 0.3, "n_estimators": 4, "max_depth": 3, "max_features": None}

    def grown():
        trees = GR.fit_forest(bins, y, np.arange(500), 5, range(3), p, (1.3, 0.8), table, True)
        return trees.value[trees.walk(bins)], GR.boost_margins(*GR.fit_boost(bins, y, 0, boost, table), 0.3, bins, (4,))[4]

    want = grown()
    monkeypatch.setattr(GR, "PAIRS", 7)
    assert all((a == b).all() for a, b in zip(want, grown()))


def test_only_the_smaller_child_is_counted(monkeypatch):
    bins, y, table = cohort(3000)
    p = {"loss": "log_loss", "learning_rate": 0.3, "n_estimators": 3, "max_depth": 3, "max_features": None}
    counted, direct = [], GR.histograms
    monkeypatch.setattr(GR, "histograms", lambda *a: counted.append(len(a[1])) or direct(*a))
    _, trees = GR.fit_boost(bins, y, 0, p, table)
    assert len(counted) == 9 and all(k <= 1500 for i, k in enumerate(counted) if i % 3)
    monkeypatch.setattr(GR, "_siblings", lambda *a: None)       # every node by itself
    _, plain = GR.fit_boost(bins, y, 0, p, table)
    for a, b in zip(trees, plain):
        assert (a.feat == b.feat).all() and (a.cut == b.cut).all() and (a.value == b.value).all() and (a.gain == b.gain).all()


def test_search_shares_fits_of_prefixes(orders, monkeypatch):
    grids = {**MO.GRIDS, "forest": {"n_estimators": [2, 4], "max_depth": [2, None]}, "gbt": {"n_estimators": [2, 5], "max_depth": [2, 3]},
             "tree": {"max_depth": [2, 4], "splitter": ["best", "random"]}, "logistic": {"l1_ratio": [0.0, 1.0], "C": [0.01, 1.0]}}
    monkeypatch.setattr(MO, "GRIDS", grids)
    res = evaluate(orders, FEATS, ["returned"], EvalConfig(n_outer=1, n_inner=2, search="grid"))
    for r in res.params.filter("model <> 'dummy'").collect():
        p = {k: v for k, v in __import__("json").loads(r.params).items() if k != "family"}
        alone = evaluate(orders, FEATS, ["returned"], EvalConfig(models=(r.model,), n_outer=1, n_inner=2, overrides={r.model: p}))
        best = res.validation.filter(F.col("model") == r.model)
        a, b = collected(alone.validation), collected(best)
        assert [x[:5] for x in a] == [x[:5] for x in b] and r.search_score > 0
        np.testing.assert_allclose([x[list(sorted(best.columns)).index("score")] for x in a], [x[list(sorted(best.columns)).index("score")] for x in b], atol=1e-7)


def test_bins_hold_missing_and_few_values(spark):
    df = spark.createDataFrame([(i, float(i % 3), None if i % 5 == 0 else float(i), 1.0) for i in range(300)], "row_id long, few double, many double, one double")
    table = UN.fit_bins(df, ["few", "many", "one"])
    assert table.cuts[0].tolist() == [0.0, 1.0] and table.cuts[2].tolist() == [] and 30 < len(table.cuts[1]) < GR.MAX_BINS
    assert table.of(np.array([[np.nan, np.nan, np.nan], [9.0, 1e9, 9.0]])).tolist() == [[0, 0, 0], [2, len(table.cuts[1]), 0]]


def test_a_restarted_run_fits_only_what_is_missing(orders, tmp_path, monkeypatch):
    cfg = EvalConfig(models=("dummy", "tree", "logistic"), seeds=(0, 1), n_outer=1, n_inner=2, overrides={"tree": {"max_depth": 2}})
    want = evaluate(orders, FEATS, ["returned"], cfg)
    kept, fitted, fit = EV.replace(cfg, run_path=str(tmp_path / "run")), [], UN.fit_trees

    def dying(cells, units, job):
        if len(fitted) == 1:
            raise RuntimeError("the driver is lost")
        fitted.append(sorted({cells.groups[g][1] for g, _ in units}))
        return fit(cells, units, job)

    monkeypatch.setattr(UN, "fit_trees", dying)
    with pytest.raises(RuntimeError):
        evaluate(orders, FEATS, ["returned"], kept)
    half = tmp_path / "run" / "units" / "returned" / "1"
    half.mkdir(parents=True)
    (half / "part-00000.parquet").write_bytes(b"half")        # no end mark: ignored and replaced

    def counting(cells, units, job):
        fitted.append(sorted({cells.groups[g][1] for g, _ in units}))
        return fit(cells, units, job)

    monkeypatch.setattr(UN, "fit_trees", counting)
    for _ in range(2):
        got = evaluate(orders, FEATS, ["returned"], kept)
    assert fitted == [[0], [1]]
    for name in ("validation", "test", "importances"):
        a, b = collected(getattr(got, name)), collected(getattr(want, name))
        assert len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b))
    with pytest.raises(ValueError):
        evaluate(orders, FEATS, ["returned"], EV.replace(kept, calibrate=False))


# -- kernel explainer -------------------------------------------------------------------------


def test_kernel_regression_is_exact_over_all_coalitions():
    from riskfold.plans import explain as EX
    rng = np.random.default_rng(5)
    for d in (1, 2, 5):
        game = rng.normal(size=1 << d)
        masks, weights = EX.coalitions(d, 0, 0)
        code = masks @ (1 << np.arange(d)) if len(masks) else np.zeros(0, int)
        got = EX.kernel_solve(masks, weights, game[code], game[0], game[-1])
        for i in range(d):
            want = sum(math.factorial(bin(s).count("1")) * math.factorial(d - bin(s).count("1") - 1) / math.factorial(d) * (game[s | 1 << i] - game[s])
                       for s in range(1 << d) if not s >> i & 1)
            assert abs(want - got[i]) < 1e-9


def test_kernel_attributions_of_a_linear_model(orders):
    from riskfold.plans import explain as EX
    test, train = orders.filter("row_id % 50 = 0"), orders
    score = sum((k + 1) * F.col(c) for k, c in enumerate(FEATS))
    got = EX.kernel_shapley(test, train, FEATS, lambda d: d.withColumn("score", score), draws=3)
    rows = got.groupBy("row_id").agg(F.sum("phi").alias("s"), F.count("*").alias("n"), F.min("error").alias("e")).collect()
    assert len(rows) == test.count() and all(r.n == len(FEATS) and r.e >= 0 for r in rows)
    masks, weights = EX.coalitions(14, 200, 1)
    assert set(map(bytes, masks)) == set(map(bytes, ~masks)) and abs(weights.sum() - 200) < 1e-9
    beta, x = np.arange(14.0), np.random.default_rng(0).normal(size=14)
    phi = EX.kernel_solve(masks, weights, masks @ (beta * x) + 0.5, 0.5, float(beta @ x) + 0.5)
    np.testing.assert_allclose(phi, beta * x, atol=1e-8)
