"""Property tests on the fixture tables: splits, kNN imputation against a numpy
brute force, TreeSHAP additivity, calibration monotonicity, plan shapes."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskfold.operators import split as SP
from riskfold.operators.knn import knn_impute
from riskfold.plans import explain as EX
from riskfold.plans import models as MO
from riskfold.sources.cohorts import order_cohort, text_cohort
from riskfold.session import scratch_path
from tests.conftest import SF001


def test_kfold_disjoint_and_stratified(spark):
    oc = order_cohort(spark, SF001)
    f = SP.stratified_kfold(oc, "returned", 5, 42).toPandas()
    assert f["row_id"].is_unique and len(f) == oc.count()
    sizes = f.groupby(["y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1


def test_ranks_independent_of_partitioning(spark):
    oc = order_cohort(spark, SF001)
    a = SP.stratified_kfold(oc, "returned", 5, 42).toPandas().sort_values("row_id").reset_index(drop=True)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = SP.stratified_kfold(oc, "returned", 5, 42).toPandas().sort_values("row_id").reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    pd.testing.assert_frame_equal(a, b)


def test_nested_plan_roles(spark):
    plan = SP.nested_fold_plan(order_cohort(spark, SF001), ["returned"], (42,), 2, 3).toPandas()
    g = plan.groupby(["outer_fold", "row_id"]).size()
    assert (g == 1).all()
    assert plan[plan.role == "test"]["inner_fold"].isna().all()
    assert set(plan[plan.role == "train"]["inner_fold"]) == {0, 1, 2}


def _np_knn(x, k):
    d = x.shape[1]
    out = x.copy()
    means = np.nanmean(x, axis=0)
    for r in np.flatnonzero(np.isnan(x).any(axis=1)):
        diff = x[r][None, :] - x
        ok = ~np.isnan(diff)
        m = ok.sum(axis=1)
        ss = np.where(ok, diff * diff, 0.0).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.sqrt(ss * d / m)
        dist[m == 0] = np.inf
        for c in np.flatnonzero(np.isnan(x[r])):
            cand = np.flatnonzero(~np.isnan(x[:, c]) & np.isfinite(dist))
            if cand.size == 0:
                out[r, c] = means[c]
                continue
            order = np.lexsort((cand, dist[cand]))[:k]
            out[r, c] = x[cand[order], c].mean()
    return out


def test_knn_impute_matches_numpy(spark):
    cols = ["total", "acctbal", "lines", "qty", "price"]
    oc = order_cohort(spark, SF001).select("row_id", *cols).orderBy("row_id")
    pdf = oc.toPandas()
    got = knn_impute(oc, cols, k=5).toPandas().sort_values("row_id")
    # row ids are sorted, so donor id order equals positional order in numpy
    want = _np_knn(pdf[cols].to_numpy(dtype="float64"), 5)
    np.testing.assert_allclose(got[cols].to_numpy(), want, rtol=1e-9)


def test_knn_no_shared_coordinate_gets_mean(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, None), (3, None, 5.0)], "row_id long, a double, b double")
    out = {r["row_id"]: (r["a"], r["b"]) for r in knn_impute(df, ["a", "b"], k=2).collect()}
    assert out[3][0] == pytest.approx(2.0)
    assert out[1][1] == pytest.approx(5.0)


@pytest.mark.parametrize("family", ["forest", "gbt"])
def test_background_shap_equals_enumeration(spark, family):
    """All coalitions of four features over all background rows, and the sum against the margin."""
    import itertools
    import math
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 4)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(int)
    feats = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "row_id long, a double, b double, c double, d double, y int")
    params = {"forest": {"n_estimators": 4, "max_depth": 4}, "gbt": {"n_estimators": 6, "max_depth": 3}}[family]
    fitted = MO.fit(MO.ModelSpec.of(family, **params), MO.assemble(df, feats), 4)
    nodes = MO.tree_nodes(spark, fitted, scratch_path(spark, "t"))
    weights = fitted.model.treeWeights if family == "gbt" else None
    test, back = df.filter("row_id < 5"), df.filter("row_id >= 40")
    phi = EX.background_shap(test, back, feats, nodes, weights).toPandas().pivot(index="row_id", columns="feature", values="phi")

    sets = [s for n in range(5) for s in itertools.combinations(range(4), n)]
    mixed = [(r * 10000 + z * 100 + k, *(float(x[r, j] if j in s else x[z, j]) for j in range(4)))
             for r in range(5) for z in range(40, 60) for k, s in enumerate(sets)]
    # margins of a forest are its unclipped mean
    out = fitted.margin(MO.assemble(spark.createDataFrame(mixed, "row_id long, a double, b double, c double, d double"), feats))
    margin = {r.row_id: r.margin for r in out.select("row_id", "margin").collect()}
    for r in range(5):
        value = {frozenset(s): np.mean([margin[r * 10000 + z * 100 + k] for z in range(40, 60)]) for k, s in enumerate(sets)}
        for j in range(4):
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value[frozenset(s) | {j}] - value[frozenset(s)])
                       for s in sets if j not in s)
            assert phi.loc[r, feats[j]] == pytest.approx(want, abs=1e-9)
        assert phi.loc[r].sum() == pytest.approx(value[frozenset(range(4))] - value[frozenset()], abs=1e-9)


def test_tree_shap_additivity(spark):
    oc = order_cohort(spark, SF001).na.drop(subset=["lines", "qty", "price", "acctbal"])
    feats = ["total", "acctbal", "lines", "qty", "price"]
    d = oc.select("row_id", *feats, F.col("returned").alias("y"))
    fitted = MO.fit(MO.ModelSpec.of("forest", n_estimators=3, max_depth=3), MO.assemble(d, feats), len(feats))
    import tempfile
    nodes = MO.tree_nodes(spark, fitted, tempfile.mkdtemp(prefix="rf-") + "/m")
    phi = EX.tree_shap(d, feats, nodes).groupBy("row_id").agg(F.sum("phi").alias("s")).toPandas()
    pred = fitted.score(MO.assemble(d, feats)).select("row_id", "score").toPandas()
    m = phi.merge(pred, on="row_id")
    np.testing.assert_allclose(m["s"] + EX.expected_value(nodes), m["score"], atol=1e-9)


def test_tree_shap_copies_rows_once_a_bundle(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *[float(v) for v in rng.normal(size=3)], int(rng.random() < 0.4)) for i in range(300)],
                               "row_id long, a double, b double, c double, y int")
    fitted = MO.fit(MO.ModelSpec.of("forest", n_estimators=8, max_depth=4), MO.assemble(df, ["a", "b", "c"]), 3)
    import tempfile
    nodes = MO.tree_nodes(spark, fitted, tempfile.mkdtemp(prefix="rf-") + "/m")
    twice = df.unionByName(df.filter("row_id < 5"))       # a key that comes twice adds up

    whole = EX.tree_shap(twice, ["a", "b", "c"], nodes)
    assert "[0,1" not in whole._jdf.queryExecution().optimizedPlan().toString()        # no copy per tree
    monkeypatch.setattr(EX, "BUNDLE_LEAVES", 1)
    monkeypatch.setattr(EX, "ROW_BLOCK", 40)
    single = EX.tree_shap(twice, ["a", "b", "c"], nodes)
    a, b = ({(r.row_id, r.feature): r.phi for r in x.collect()} for x in (whole, single))
    assert a == pytest.approx(b, abs=1e-12) and len(a) == 900


def test_platt_is_monotone(spark):
    tc = text_cohort(spark, SF001).filter(F.col("toxic").isNotNull())
    df = tc.select("row_id", F.col("toxic").alias("y"), (F.col("n_chars") / 1000.0).alias("margin"))
    a, b = MO.platt_fit(df)
    cal = MO.platt_apply(df, a, b).orderBy("margin").select("score").toPandas()["score"].to_numpy()
    assert np.all(np.diff(cal) >= -1e-12) or np.all(np.diff(cal) <= 1e-12)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["stratified_kfold", "roc_auc", "roc_grid", "impute_knn", "smote",
                                  "classification_metrics", "threshold_sweep"])
def test_no_cartesian_products(spark, name):
    import __spark_entry__ as E
    plan = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_prunes_columns(spark):
    df = order_cohort(spark, SF001).select("row_id", "total")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "o_orderdate" not in plan


def test_background_shap_copies_rows_once_a_bundle(spark, monkeypatch):
    """Rows meet bundles of trees, not single trees, and bundles of any size give the same attributions."""
    assert EX.tree_bundles([3, 3, 3, 9, 1], 6) == [0, 0, 1, 2, 3] and EX.tree_bundles([8] * 100) == [0] * 100 and EX.tree_bundles([]) == []
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(50, 3)), 1)
    df = spark.createDataFrame([(i % 40, *(None if rng.random() < 0.1 else float(v) for v in r), int(r[0] + r[1] > 0)) for i, r in enumerate(x)],
                               "row_id long, a double, b double, c double, y int")       # ids repeat
    fitted = MO.fit(MO.ModelSpec.of("gbt", n_estimators=7, max_depth=2), MO.assemble(df.na.fill(0.0), ["a", "b", "c"]), 3)
    nodes = MO.tree_nodes(spark, fitted, scratch_path(spark, "t"))
    whole = EX.background_shap(df, df, ["a", "b", "c"], nodes, fitted.model.treeWeights)
    assert "[0,1" not in whole._jdf.queryExecution().optimizedPlan().toString()        # no copy per tree
    monkeypatch.setattr(EX, "BUNDLE_LEAVES", 1)
    monkeypatch.setattr(EX, "BACKGROUND_BLOCK", 7)
    single = EX.background_shap(df, df, ["a", "b", "c"], nodes, fitted.model.treeWeights)
    a, b = (t.toPandas().sort_values(["row_id", "feature"]).reset_index(drop=True) for t in (whole, single))
    assert len(a) == 120 and a[["row_id", "feature"]].equals(b[["row_id", "feature"]])
    np.testing.assert_allclose(a.phi, b.phi, atol=1e-12)


def test_box_patterns_number_as_they_sort():
    x = np.array([[0.0, 5.0], [2.0, 5.0], [0.0, np.nan], [0.0, 5.0]])
    seen, place = EX.box_patterns(x, [0, 1], np.array([-np.inf, 1.0]), np.array([1.0, np.inf]))
    assert seen.tolist() == [[False, True], [True, True]] and place.tolist() == [1, 0, 1, 1]
    wide = np.random.default_rng(1).normal(size=(40, 13))
    for d in (12, 13):      # numbered, and sorted
        seen, place = EX.box_patterns(wide, list(range(d)), np.full(d, -1.0), np.full(d, 1.0))
        want = (wide[:, :d] > -1.0) & (wide[:, :d] <= 1.0)
        assert (seen[place] == want).all() and seen.tolist() == sorted(map(list, set(map(tuple, want.tolist()))))


def test_exp_boost_scores_are_probabilities(spark):
    from riskfold.plans.boost import fit_exp_boost
    from riskfold.functions import curves as CV
    oc = order_cohort(spark, SF001).na.drop(subset=["lines", "qty", "price"])
    feats = ["total", "lines", "qty", "price"]
    d = MO.assemble(oc.select("row_id", *feats, F.col("returned").alias("y")), feats)
    m = fit_exp_boost(d, n_rounds=4, max_depth=2)
    sc = m.score(d).select("y", "score")
    lo, hi = sc.agg(F.min("score"), F.max("score")).first()
    assert 0.0 < lo <= hi < 1.0
    assert CV.roc_auc(sc, []).first()["roc_auc"] > 0.6


@pytest.mark.parametrize(("depth", "rate"), [(3, 1.0), (1, 0.5)])
def test_exp_boost_by_passes_fits_the_trees_of_single_rounds(spark, monkeypatch, tmp_path, depth, rate):
    from riskfold.plans import boost as BO
    d = spark.range(0, 3000, 1, 3).select("id", F.round(F.randn(1), 2).alias("a"), F.when(F.rand(5) < 0.6, 0.0).otherwise(F.rand(6)).alias("b"),
                                          F.floor(F.rand(2) * 3).cast("double").alias("c"))
    d = MO.assemble(d.withColumn("y", (F.rand(9) < 0.2 + 0.4 * F.col("b") + 0.1 * F.col("c") * (F.col("a") > 0).cast("int")).cast("int")),
                    ["a", "b", "c"]).persist()
    want = BO.fit_exp_boost(d, 5, depth, rate)
    monkeypatch.setattr(BO, "ML_ROWS", 100)
    monkeypatch.setattr(BO, "BLOCK", 8 * 3 * 700)      # several blocks a task
    monkeypatch.setattr(BO, "RENEW", 2)
    spark.sparkContext.setJobGroup(f"passes-{depth}", "passes")
    got = BO.fit_exp_boost(d, 5, depth, rate)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"passes-{depth}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 5 * depth + 10      # a pass a level; a fit of Spark ML takes more
    assert isinstance(got.stages[0][0], BO.WeightedTree) and len(got.stages) == len(want.stages) == 5
    for (t, a), (u, b) in zip(got.stages, want.stages):
        assert a == pytest.approx(b, rel=1e-9) and np.allclose(t.featureImportances.toArray(), u.featureImportances.toArray(), atol=1e-9)
    rows = got.score(d).select("id", F.col("score").alias("s")).join(want.score(d).select("id", "score"), "id")
    assert rows.count() == 3000 and rows.agg(F.max(F.abs(F.col("s") - F.col("score")))).first()[0] < 1e-9
    MO.Fitted(MO.ModelSpec.of("gbt", loss="exponential"), got).save(str(tmp_path))
    kept = [spark.read.parquet(str(p)).count() for p in sorted(tmp_path.iterdir())]
    assert kept == [len(t.feat) for t, _ in got.stages]


def test_cuts_of_many_values_are_weighted_quantiles():
    from riskfold.plans import boost as BO
    rng = np.random.default_rng(0)
    v, w = rng.normal(size=4000), rng.random(4000)
    cuts = BO._cuts(np.append(v, np.nan), np.append(w, 5.0))
    below = [w[v <= c].sum() / w.sum() for c in cuts]
    assert len(cuts) == BO.BINS - 1 and np.allclose(below, np.arange(1, BO.BINS) / BO.BINS, atol=1e-3)
    assert BO._cuts(np.array([2.0, 1.0, 2.0, 5.0]), np.ones(4)).tolist() == [1.5, 3.5] and not len(BO._cuts(np.ones(3), np.ones(3)))



def test_iterative_imputation_fills_everything(spark):
    from riskfold.operators.iterative import apply_iterative, fit_iterative
    from riskfold.operators.transforms import fit_impute
    cols = ["total", "acctbal", "lines", "qty"]
    oc = order_cohort(spark, SF001).select("row_id", *cols)
    means = fit_impute(oc, cols, "mean")
    out = apply_iterative(oc, cols, fit_iterative(oc, cols, means, rounds=2), means)
    assert out.count() == oc.count()
    assert out.filter(" OR ".join(f"{c} IS NULL" for c in cols)).count() == 0
    # observed values are kept as they are
    j = oc.join(out.select("row_id", F.col("acctbal").alias("a2")), "row_id").filter("acctbal IS NOT NULL")
    assert j.filter("acctbal <> a2").count() == 0


@pytest.mark.parametrize("shape", ["spread", "lumps"])
def test_neighbours_by_cells_equal_all_pairs(spark, monkeypatch, shape):
    from riskfold.operators import knn
    rng = np.random.default_rng(8)
    n, d, k = 900, 4, 5
    x = rng.normal(size=(n, d)) + (rng.integers(0, 12, (n, 1)) * 9.0 if shape == "lumps" else 0.0)
    x[:60] = x[60:120]                                  # ties
    holes = x.copy()
    holes[rng.random((n, d)) < 0.15] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(holes)]
    columns = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double")
    monkeypatch.setattr(knn, "CELL_ROWS", 30)
    monkeypatch.setattr(knn, "MAX_PATTERNS", 9)         # rarer patterns have no bound
    got = np.array([r[1:] for r in sorted(knn_impute(df, columns, k=k).collect())])
    dist = knn._masked_dist(holes, holes)
    for i, c in zip(*np.nonzero(np.isnan(holes))):
        usable = np.flatnonzero(~np.isnan(holes[:, c]) & np.isfinite(dist[i]))
        best = usable[np.lexsort((usable, dist[i, usable]))][:k]
        assert got[i, c] == pytest.approx(holes[best, c].mean() if len(best) else np.nanmean(holes[:, c]))
    full = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double, d double")
    near = {}
    for r in knn.nearest_neighbours(full, full, columns, k).collect():
        near.setdefault(r.qid, {})[r.rank] = r.dist
    plain = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(plain, np.inf)
    want = np.sort(plain, axis=1)[:, :k]
    for i in range(n):
        np.testing.assert_allclose([near[i][j] for j in range(1, k + 1)], want[i], atol=1e-9)
    assert knn.SEARCHED["cells"] > 10 and knn.SEARCHED["pairs"] < n * n * (0.25 if shape == "lumps" else 0.8)


def test_group_measures_only_near_boxes(monkeypatch):
    from riskfold.operators import knn
    rng = np.random.default_rng(5)
    x = rng.random((8192, 3))
    donors = pd.DataFrame(x, columns=["_c0", "_c1", "_c2"]).assign(_id=np.arange(len(x)))
    q = donors[(x[:, 0] < 0.1) & (x[:, 1] < 0.1)].assign(_c2=np.nan, _id=lambda t: t["_id"] + 10**6, _far=np.inf)
    measured, whole = [], knn._masked_dist
    monkeypatch.setattr(knn, "_masked_dist", lambda a, b: measured.append(len(a) * len(b)) or whole(a, b))
    got = knn._impute_candidates(3, 3)(q, donors).sort_values(["qid", "dist", "did"])
    plain = whole(q[["_c0", "_c1", "_c2"]].to_numpy(), x)
    np.testing.assert_array_equal(got["did"].to_numpy().reshape(-1, 3), np.argsort(plain, axis=1, kind="stable")[:, :3])
    assert sum(measured) < 0.5 * plain.size          # all of it before


def test_columns_that_miss_together_share_their_pairs(monkeypatch):
    from riskfold.operators import knn
    rng = np.random.default_rng(9)
    n, k = 4000, 3
    x = rng.random((n, 4))
    x[:300] = x[300:600]                                              # ties
    x[rng.random(n) < 0.1, 0] = np.nan
    x[rng.random(n) < 0.1, 1] = np.nan
    donors = pd.DataFrame(x, columns=["_c0", "_c1", "_c2", "_c3"]).assign(_id=np.arange(n))
    q = donors[x[:, 0] < 0.1].assign(_c2=np.nan, _c3=np.nan, _id=lambda t: t["_id"] + 10**6, _far=np.inf)
    q = q[q["_c1"].notna()]
    measured, close = [], knn._close
    monkeypatch.setattr(knn, "_close", lambda a, b, *rest: measured.append(len(a) * len(b)) or close(a, b, *rest))
    got = knn._impute_candidates(k, 4)(q, donors)
    qx = q[["_c0", "_c1", "_c2", "_c3"]].to_numpy()
    plain = knn._masked_dist(qx, x)
    for c in (2, 3):
        own = got[got["c"] == c].sort_values(["qid", "dist", "did"])
        best = np.lexsort((np.broadcast_to(np.arange(n), plain.shape), plain), axis=1)[:, :k]
        np.testing.assert_array_equal(own["did"].to_numpy().reshape(-1, k), best)
        np.testing.assert_array_equal(own["dist"].to_numpy().reshape(-1, k), np.take_along_axis(plain, best, axis=1))
        np.testing.assert_array_equal(own["v"].to_numpy().reshape(-1, k), x[best, c])
    assert 0 < sum(measured) < 0.5 * plain.size                       # both columns in one search of near boxes


def test_tables_of_the_search_are_written(spark, monkeypatch):
    from riskfold.operators import knn
    assert not hasattr(knn, "cut_lineage")                            # boxed rows of a checkpoint are slow to read
    written, stash = [], knn.stash
    monkeypatch.setattr(knn, "stash", lambda df, name: written.append(name) or stash(df, name))
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i % 3)) for i in range(60)], "row_id long, a double, b double")
    assert knn_impute(df, ["a", "b"], k=2).filter("b IS NULL").count() == 0
    assert written == ["donors", "placed", "visits", "first", "visits", "filled"]


def test_train_and_test_rows_are_ranked_once(spark, monkeypatch):
    from riskfold.plans import q_models as QM
    seen, split, calls = spark.sparkContext.accumulator(0), QM.train_test_split, []

    def counted(*args):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b
        calls.append(1)
        roles = split(*args).select("row_id", "role")
        return roles.mapInPandas(run, roles.schema)

    df = spark.createDataFrame([(i, i % 4 // 3, float(i)) for i in range(400)], "row_id long, returned int, f double")
    monkeypatch.setattr(QM, "_prepared", lambda spark, sf: (df, ["f"]))
    monkeypatch.setattr(QM, "train_test_split", counted)
    monkeypatch.setattr(QM, "_HELD", QM._Cache())
    for _ in range(2):
        train, test, _f = QM._split(spark, "own rows")
        assert (train.count(), test.count()) == (320, 80) and train.intersect(test).count() == 0
    assert calls == [1] and seen.value == 400


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_screened_neighbours_equal_all_pairs(shift):
    from riskfold.operators import knn
    rng = np.random.default_rng(6)
    n, d, k = 5000, 24, 4
    x = rng.integers(0, 3, (n, d)) + rng.normal(size=(n, d)) * 1e-3 + shift
    x[100:140] = x[100]                                # copies
    x[200], x[201, 3] = np.nan, np.inf
    donors = pd.DataFrame(x, columns=[f"_c{i}" for i in range(d)]).assign(_id=np.arange(n))
    q = donors.iloc[:300].assign(_far=np.inf)
    got = knn._neighbour_candidates(k, d)(q, donors)
    near = {i: g.sort_values(["dist", "did"]) for i, g in got.groupby("qid")}
    for i in range(300):
        t = np.zeros(n)
        with np.errstate(invalid="ignore"):
            for j in range(d):
                t += (x[i, j] - x[:, j]) ** 2
        t = np.sqrt(t)
        t[i] = np.inf
        best = [b for b in np.lexsort((np.arange(n), t))[:k] if np.isfinite(t[b])]
        assert best == ([] if i not in near else near[i]["did"].tolist()), i


def test_nested_plan_ranks_only_edge_rows(spark, monkeypatch):
    import hashlib
    written, cut = [], SP.cut_lineage
    monkeypatch.setattr(SP, "cut_lineage", lambda df: written.append(1) or cut(df))
    rows = [(i // 2, int(i % 7 == 0)) for i in range(1200)]           # every key twice
    df = spark.createDataFrame(rows, "row_id long, e int")
    plan = SP.nested_fold_plan(df, ["e"], seeds=(3,), n_outer=2, n_inner=3).toPandas()
    assert len(written) == 1                                          # the labels; before, all rows of all splits too
    for o in (0, 1):
        for y in ("0", "1"):
            mine = [k for k, v in rows if str(v) == y]
            order = sorted(mine, key=lambda k: hashlib.md5(f"{k}|3|{o}".encode()).hexdigest())
            got = plan[(plan.outer_fold == o) & (plan.y == y)]
            assert len(got) == len(mine)
            assert sorted(got[got.role == "test"].row_id) == sorted(order[:round(0.2 * len(mine))])


def test_fold_table_shuffles_numbers_once(spark):
    """Ranks of classes with equal, missing and repeated keys as by sorting; a split's rows pass one shuffle of key and numbers."""
    keys = [*range(150), *range(20), None]
    rows = [(k, (k or 0) % 3, "a" if (k or 1) % 2 else None) for k in keys]
    df = spark.createDataFrame(rows, "row_id long, e int, f string")
    plan = SP.nested_fold_plan(df, ["e", "f"], seeds=(3, 5), n_outer=2, n_inner=4, test_fraction=0.3)
    got = plan.toPandas()
    assert set(got.endpoint) == {"e", "f"} and len(got) == 4 * sum((e is not None) + (f is not None) for _, e, f in rows)

    def digest(k, *salt):
        return hashlib.md5("|".join(str(v) for v in (k, *salt) if v is not None).encode()).hexdigest()

    for seed, o, (j, name) in itertools.product((3, 5), (0, 1), ((1, "e"), (2, "f"))):
        for y in {r[j] for r in rows} - {None}:
            order = sorted((r[0] for r in rows if r[j] == y), key=lambda k: digest(k, seed, o))
            test = math.floor(0.3 * len(order) + 0.5)
            inner = [(k, i % 4) for i, k in enumerate(sorted(order[test:], key=lambda k: digest(k, seed, o, "inner")))]
            want = sorted(map(str, [*((k, None) for k in order[:test]), *inner]))
            mine = got[(got.endpoint == name) & (got.seed == seed) & (got.outer_fold == o) & (got.y == str(y))]
            have = sorted(str((None if k != k else int(k), None if f != f else int(f))) for k, f in zip(mine.row_id, mine.inner_fold))
            assert have == want
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [x for x in final.splitlines() if "Exchange hashpartitioning(_g" in x and "REPARTITION_BY_NUM" in x]
    assert len(dealt) == 1 and "endpoint" not in dealt[0]
