"""Evaluation options, model families, selection and preparation at their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskfold.functions import curves as CV
from riskfold.operators import filters as FL
from riskfold.operators import split as SP
from riskfold.operators import transforms as TR
from riskfold.operators.balance import smote
from riskfold.operators.knn import knn_impute, nearest_neighbours
from riskfold.operators.quantiles import exact_quantiles
from riskfold.operators.ranges import value_bucket
from riskfold.plans import models as MO
from riskfold.plans import selection as SE
from riskfold.plans.evaluate import EvalConfig, evaluate
from riskfold.sources.cohorts import ORDER_CATALOG, order_cohort
from tests.conftest import SF001

FEATS = ["total", "lines", "qty", "price"]


@pytest.fixture(scope="module")
def orders(spark):
    df = order_cohort(spark, SF001).na.drop(subset=["lines", "qty", "price"])
    scaled = [((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c in FEATS
              for m, s in [df.agg(F.avg(c), F.stddev_pop(c)).first()]]
    return df.select("row_id", *scaled, "returned", F.col("returned").alias("y")).persist()


def test_fitted_row_filter_applies_to_every_cohort(spark):
    oc = order_cohort(spark, SF001)
    cfg = TR.PrepConfig(imputer="mean", drop_missing_value=10.0)
    prep = TR.prepare(oc, ORDER_CATALOG, cfg)
    kept = FL.drop_sparse_rows(oc.select("row_id", *prep.row_columns), 10.0).count()
    assert 0 < kept < oc.count()
    assert prep.transform(oc).count() == kept == prep.fitted_rows().count()


def test_knn_imputation_runs_once_and_matches(spark):
    oc = order_cohort(spark, SF001)
    prep = TR.prepare(oc, ORDER_CATALOG, TR.PrepConfig(imputer="knn", missing_threshold=0.5))
    a = prep.transform(oc).orderBy("row_id").toPandas()
    b = prep.fitted_rows().orderBy("row_id").toPandas()
    np.testing.assert_allclose(a[prep.features], b[prep.features])


def test_wide_vocabulary_equals_dummies(spark):
    rows = [(i, None if i % 41 == 3 else f"v{i * 7 % 40}", "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, wide string, narrow string")
    few, many = (TR.fit_vocabulary(df, ["wide", "narrow"], dense_levels=n) for n in (10, 1000))
    assert few["narrow"] == many["narrow"] == ["a", "b"]
    levels = {r.level: r.slot for r in few["wide"].levels.collect()}
    assert levels == {v: i for i, v in enumerate(many["wide"])} and few["wide"].size == len(levels) == 41
    new = df.unionByName(spark.createDataFrame([(1000, "unseen", "a"), (1001, None, None)], df.schema))
    kinds = {}
    for name, vocab in (("few", few), ("many", many)):
        prep = TR.Prepared(key="row_id", binary={}, vocab=vocab, numeric=[], impute={}, scale={}, endpoints=[])
        x = MO.assemble(prep.transform(new), prep.features).select("row_id", "features").collect()
        kinds[name] = {r.row_id: r.features.toArray().tolist() for r in x}, sorted(prep.feature_slots(spark).collect())
    assert kinds["few"] == kinds["many"] and len(kinds["few"][0]) == 402
    assert sum(kinds["few"][0][1000]) == 1 and kinds["few"][0][1001][levels[TR.CATEGORY_FILL]] == 1
    assert set(TR.one_hot(df, few).columns) == {"row_id", "narrow_a", "narrow_b", "wide_levels"}


def test_quantiles_of_any_spread(spark):
    values = {"wide": [10.0 ** i for i in range(0, 300, 3)] * 30, "tied": [1.0, 2.0] * 1500, "flat": [5.0] * 3000}
    rows = list(zip(*values.values()))
    got = exact_quantiles(spark.createDataFrame(rows, "wide double, tied double, flat double"), list(values), (0.0, 0.3, 0.5, 1.0))
    for c, v in values.items():
        np.testing.assert_allclose(got[c], np.quantile(v, (0.0, 0.3, 0.5, 1.0)), rtol=1e-12)


def test_leave_one_out_uses_many_buckets(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    assert value_bucket(df, "row_id", "b", 64).select("b").distinct().count() > 50
    tiny = df.select((F.col("row_id") * 1e-8).alias("score"))
    assert value_bucket(tiny, "score", "b", 64).groupBy("b").count().agg(F.max("count")).first()[0] < 500
    folds = SP.loo_folds(df).toPandas().sort_values("row_id")
    assert folds.fold.tolist() == list(range(5000))


def test_string_keys_in_neighbour_search(spark):
    rows = [(f"r{i:02d}", float(i), float(i % 3) if i % 4 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id string, a double, b double")
    assert knn_impute(df, ["a", "b"], k=2).filter("b IS NULL").count() == 0
    nb = nearest_neighbours(df, df, ["a"], 2).filter("rank = 1").collect()
    assert all(abs(int(r.qid[1:]) - int(r.did[1:])) == 1 for r in nb) and len(nb) == 20


def test_smote_of_long_keys(spark, orders):
    rare = orders.withColumn("z", (F.col("row_id") % 11 == 0).cast("int"))
    made = smote(rare, "z", FEATS)
    sizes = dict(rare.groupBy("z").count().collect())
    assert made.count() == sizes[0] - sizes[1]


def test_removal_by_all_methods(spark):
    oc = order_cohort(spark, SF001)
    cols = ["total", "acctbal", "disc", "constant", "total_x2"]
    imp = FL.cumulative_importance(spark.createDataFrame([(c, 0.0 if c == "acctbal" else 1.0) for c in cols], "feature string, importance double"))
    table = FL.identify_all(oc, cols, imp, 0.5, 0.95, 0.99)
    by = {(r.method, r.feature) for r in table.collect()}
    assert {("missing", "disc"), ("single_unique", "constant"), ("collinear", "total_x2"), ("zero_importance", "acctbal")} <= by
    with pytest.raises(ValueError):
        FL.features_to_remove(table.filter("method <> 'collinear'"), ["collinear"])


def test_importance_of_a_regression_target(orders):
    d = orders.withColumn("role", F.when(F.col("row_id") % 5 == 0, "valid").otherwise("train")).withColumn("y", F.col("qty"))
    imp = SE.gbm_importance(d, FEATS, n_iterations=1, max_iter=5, task="regression").collect()
    assert max(imp, key=lambda r: r.importance).feature == "qty"
    with pytest.raises(ValueError):
        SE.gbm_importance(d, FEATS, task="ranking")


def test_decision_values_keep_their_cut(orders):
    assert MO.ModelSpec.of("svm").cut == 0.0 and MO.ModelSpec.of("logistic").cut == 0.5
    res = evaluate(orders, FEATS, ["returned"], EvalConfig(models=("svm",), n_outer=1, n_inner=2, calibrate=False))
    assert res.params.first()["threshold"] == 0.0
    wrong = res.validation.filter("pred <> cast(score >= 0 as int)").count()
    assert wrong == 0


def test_learning_rate_and_weights_of_the_perceptron(orders):
    d = MO.assemble(orders, FEATS)
    scores = [MO.fit(MO.ModelSpec.of("mlp", hidden=(4,), learning_rate_init=r), d, 4).score(d).agg(F.stddev("score")).first()[0]
              for r in (0.1, 0.001)]
    assert scores[0] != scores[1]
    with pytest.raises(ValueError):
        MO.fit(MO.ModelSpec.of("mlp"), d.withColumn("w", F.lit(1.0)), 4, weight="w")


def test_exponential_boosting_is_a_candidate(orders):
    assert any(s.p["loss"] == "exponential" for s in MO.grid("gbt"))
    d = MO.assemble(orders, FEATS)
    fitted = MO.fit(MO.ModelSpec.of("gbt", loss="exponential", n_estimators=3), d, 4)
    out = fitted.score_margin(d)
    assert CV.roc_auc(out, []).first()["roc_auc"] > 0.6 and len(MO.importances(fitted, FEATS)) == 4
    assert out.filter("(margin > 0) <> (score > 0.5)").count() == 0


@pytest.mark.parametrize(("family", "balancing", "search", "selection"), [
    ("logistic", "SMOTE", "random", "importance"), ("tree", "random_oversampling", "none", None), ("mlp", "class_weight", "none", None),
    ("logistic", "ADASYN", "none", None), ("forest", "class_weight", "none", "rfecv")])
def test_evaluation_options(orders, monkeypatch, family, balancing, search, selection):
    monkeypatch.setattr(SE, "gbm_importance", lambda d, f, **k: orders.sparkSession.createDataFrame(
        [(c, 1.0 if c != "total" else 0.0) for c in f], "feature string, importance double"))
    monkeypatch.setattr(SE, "rfecv", lambda d, f, **k: orders.sparkSession.createDataFrame(
        [("lines,qty", True)], "features string, selected boolean"))
    cfg = EvalConfig(models=(family,), n_outer=1, n_inner=2, balancing=balancing, search=search, n_iter=2, selection=selection,
                     scorer="roc_auc", attribution=True,
                     overrides={"tree": {"max_depth": 3}, "forest": {"n_estimators": 3, "max_depth": 3}, "mlp": {"hidden": (4,)}})
    res = evaluate(orders, FEATS, ["returned"], cfg)
    assert res.test.count() > 0 and res.summary().count() == 1
    phi = res.attributions.select("feature").distinct().collect()
    expected = {"importance": FEATS[1:], "rfecv": ["lines", "qty"], None: FEATS}[selection]
    assert {r.feature for r in phi} == set(expected)
    assert {r.stage for r in res.calibration_curves().collect()} == {"raw", "calibrated"}


def test_pretuning_models_and_scratch(spark, orders, tmp_path):
    from riskfold.session import release_scratch
    cfg = EvalConfig(models=("logistic",), n_outer=1, n_inner=2, pretune=True, pretune_draws=2, model_path=str(tmp_path))
    res = evaluate(orders, FEATS, ["returned"], cfg)
    assert res.params.count() == 1 and (tmp_path / "returned" / "42" / "logistic" / "0" / "metadata").exists()
    assert release_scratch(spark) > 0 and release_scratch(spark) == 0


def test_unknown_options_are_errors(orders):
    for cfg in (EvalConfig(models=("logistic",), selection="x"), EvalConfig(models=("logistic",), search="random", scorer="x")):
        with pytest.raises(ValueError):
            evaluate(orders, FEATS, ["returned"], cfg)


def test_registered_evaluations_are_whole(monkeypatch):
    """All families, the five reference seeds, all folds, both endpoints and the default (kNN) preparation."""
    import inspect

    from riskfold.operators.transforms import PrepConfig
    from riskfold.plans import flagship as FS
    from riskfold.plans import q_models as QM
    seen, prepared = [], []

    class Stop(Exception):
        pass

    def record(df, features, endpoints, cfg=None, external=None):
        seen.append((list(endpoints), cfg))
        raise Stop

    def prep(spark, sf, imputer="knn", normaliser="standard"):
        prepared.append(imputer)
        raise Stop

    monkeypatch.setattr(QM, "evaluate", record)
    monkeypatch.setattr(FS, "evaluate", record)
    monkeypatch.setattr(QM, "prepared_orders", prep)
    monkeypatch.setattr(QM._Cache, "of", lambda self, spark: {})
    with pytest.raises(Stop):
        QM._prepared(None, "x")
    monkeypatch.setattr(QM, "_prepared", lambda spark, sf: (None, []))
    monkeypatch.setattr(FS, "prepared_orders", lambda spark, sf: (None, []))
    monkeypatch.setattr(FS, "ensure_checkpoint_dir", lambda spark: None)
    for run in (QM._evaluation, QM.q_random_search, FS.flagship):
        with pytest.raises(Stop):
            run(None, "x")
    assert prepared == ["knn"] and len(seen) == 3
    for endpoints, cfg in seen:
        assert endpoints == ["returned", "pending"] and cfg.seeds == (0, 111, 222, 333, 444)
        assert cfg.models == EvalConfig().models and (cfg.n_outer, cfg.n_inner) == (5, 5) and not cfg.overrides
    assert PrepConfig().imputer == "knn"
    for run in (QM.q_evaluate_external, QM.q_rfecv):
        text = inspect.getsource(run)
        assert "mean" not in text and "models=" not in text and "n_estimators" not in text
