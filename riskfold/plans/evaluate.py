"""Nested evaluation of model families over endpoints, seeds and folds.

Plan once: the fold table (R6) is checkpointed and the cohort packed.  The default
families are fitted keyed (:mod:`riskfold.plans.units`): every (endpoint, seed, outer
split, inner fold) of every family in the same few jobs, whose number does not grow
with the units.  Families and options that only Spark ML offers (linear SVM,
perceptron, synthetic rows, feature selection, kept models) run as one task per
(endpoint, seed, outer split, family) from a driver thread pool.  Predictions are
written under the checkpoint folder (lineage cut, survives executor loss); all
metrics and curves are then computed by key in single queries.
"""

from __future__ import annotations

import json
import logging
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions import curves as CV
from riskfold.functions.exprs import col
from riskfold.operators import balance as BA
from riskfold.operators.split import holdout_split, nested_fold_plan
from riskfold.plans import explain as EX
from riskfold.plans import models as MO
from riskfold.plans import report as RP
from riskfold.plans import selection as SE
from riskfold.plans import units as UN
from riskfold.session import cut_lineage, finished, scratch_path

LOG = logging.getLogger(__name__)


@dataclass
class EvalConfig:
    models: tuple = ("dummy", "tree", "forest", "gbt", "logistic")
    seeds: tuple = (42,)
    n_outer: int = 5
    n_inner: int = 5
    test_fraction: float = 0.2
    search: str = "none"            # none | grid | random
    n_iter: int = 10
    scorer: str = "average_precision"   # average_precision | roc_auc
    selection: str | None = None    # None | importance (boosted importance >= its mean) | rfecv
    pretune: bool = False           # random search per seed first; its best parameters hold everywhere
    pretune_draws: int = 30
    model_path: str | None = None   # folder that keeps the fitted model of each (endpoint, seed, model, outer split)
    attribution: bool = False       # attributions of the test rows, for every family but the constant
    attribute_large: bool = False   # of trees of groups above units.LOCAL_ROWS rows too: without it they raise, for the work is rows x nodes
    run_path: str | None = None     # folder of finished waves: a restarted run reads them and fits the others
    balancing: str | None = "class_weight"   # None | class_weight | random_oversampling | SMOTE | ADASYN
    calibrate: bool = True
    threshold_on: str = "train"     # train (calibration rows) | test (as the original workflow)
    parallelism: int = 4            # concurrent tasks
    concurrent_fits: int = 6        # concurrent fits over all tasks
    overrides: dict = field(default_factory=dict)   # family -> default params when search is none


@dataclass
class Results:
    validation: DataFrame    # (endpoint, seed, model, outer_fold, inner_fold, row_id, y, score, pred)
    test: DataFrame          # (endpoint, seed, model, outer_fold, row_id, y, score, raw_score, pred)
    params: DataFrame        # (endpoint, seed, model, outer_fold, params, threshold, search_score)
    importances: DataFrame   # (endpoint, seed, model, outer_fold, feature, importance)
    attributions: DataFrame | None = None   # (endpoint, seed, model, outer_fold, row_id, feature, phi)

    def validation_metrics(self) -> DataFrame:
        return RP.fold_metrics(self.validation, ["endpoint", "seed", "model", "outer_fold", "inner_fold"])

    def test_metrics(self) -> DataFrame:
        return RP.fold_metrics(self.test, ["endpoint", "seed", "model", "outer_fold"])

    def summary(self) -> DataFrame:
        """A3 over outer splits of the test metrics, per (endpoint, seed, model)."""
        return RP.metric_summary(self.test_metrics(), ["endpoint", "seed", "model"])

    def test_curves(self) -> DataFrame:
        return CV.roc_grid(self.test, ["endpoint", "seed", "model", "outer_fold"])

    def pooled_pr(self) -> DataFrame:
        """C7 over the test rows of all outer splits."""
        return CV.pr_summary(self.test, ["endpoint", "seed", "model"])

    def calibration_curves(self) -> DataFrame:
        """C9 of the test rows before (``raw``) and after (``calibrated``) calibration."""
        keys = ["endpoint", "seed", "model", "outer_fold"]
        probability = self.test.filter("raw_score BETWEEN 0 AND 1")
        return CV.calibration_curve(probability, keys, score="raw_score").withColumn("stage", F.lit("raw")).unionByName(
            CV.calibration_curve(self.test, keys).withColumn("stage", F.lit("calibrated")))

    def attribution_summary(self, top: int = 40) -> DataFrame:
        """A7 over the attributions pooled over folds."""
        return EX.attribution_summary(self.attributions, ["endpoint", "seed", "model"], top)


def _write(df: DataFrame, root: str, name: str) -> str:
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _candidates(family: str, cfg: EvalConfig, seed: int):
    if cfg.search == "grid":
        return MO.grid(family)
    if cfg.search == "random":
        return MO.random_candidates(family, cfg.n_iter, seed)
    return [MO.ModelSpec.of(family, **cfg.overrides.get(family, {}))]


def _balance(train: DataFrame, features, cfg: EvalConfig, seed: int):
    """Returns (rows for fitting, weight column or None)."""
    b = cfg.balancing
    if b in (None, "none"):
        return train, None
    if b == "class_weight":
        return BA.with_weights(train, "y", "w"), "w"
    if b == "random_oversampling":
        return BA.random_oversample(train, "y", seed).drop("draw"), None
    if b in ("SMOTE", "ADASYN"):
        minority = train.groupBy("y").count().orderBy("count", "y").first()["y"]
        synth = (BA.smote(train, "y", features, 5, seed) if b == "SMOTE"
                 else BA.adasyn(train, "y", features, 5, seed))
        synth = synth.select(F.lit(-1).cast("long").alias("row_id"), *[col(c) for c in features],
                             F.lit(minority).cast(train.schema["y"].dataType).alias("y"))
        return train.select("row_id", *[col(c) for c in features], "y").unionByName(synth), None
    raise ValueError(f"Unknown balancing option {b}")


def _scores(parts: list, scorer: str) -> dict:
    """Mean score over inner folds of each candidate, from one keyed pass over all scored folds."""
    if not parts:
        return {}
    keys = ["candidate", "inner_fold"]
    pred = reduce(DataFrame.unionByName, parts)
    table = CV.roc_auc(pred, keys) if scorer == "roc_auc" else CV.pr_summary(pred, keys)
    name = "roc_auc" if scorer == "roc_auc" else "avg_precision"
    rows = table.groupBy("candidate").agg(F.avg(F.coalesce(name, F.lit(0.0))).alias("s")).collect()
    return {r["candidate"]: r["s"] for r in rows}


def _select(train: DataFrame, features, cfg: EvalConfig, seed: int) -> list:
    """P12 / P13 on the training rows of an outer split."""
    if cfg.selection is None:
        return list(features)
    if cfg.selection == "importance":
        marked = train.join(holdout_split(train, 0.15, seed).select("row_id", F.col("role").alias("_r")), "row_id")
        imp = SE.gbm_importance(marked.drop("role").withColumnRenamed("_r", "role"), features, n_iterations=1)
        kept = {r["feature"] for r in SE.select_from_model(imp).collect()}
    else:
        best = SE.rfecv(train, features, cv=cfg.n_inner).filter("selected").first()["features"]
        kept = set(best.split(","))
    return [f for f in features if f in kept]


def _attributions(fitted, train: DataFrame, test: DataFrame, features, root: str):
    """Attributions of the test rows: linear models in closed form (X1), Spark ML's gini trees and forests by
    their nodes (X2), every other family by the kernel explainer on its score (X3); None for the constant."""
    family = fitted.spec.family
    if family == "dummy":
        return None
    if family in ("logistic", "svm"):
        means = train.agg(*[F.avg(col(f)).alias(f) for f in features]).first().asDict()
        return EX.linear_attribution(test, dict(MO.importances(fitted, features)), means).select("row_id", "feature", "phi")
    if family in ("tree", "forest") and fitted.spec.p["criterion"] == "gini":
        return EX.tree_shap(test, features, MO.tree_nodes(train.sparkSession, fitted, f"{root}/trees/{uuid.uuid4().hex}"))
    return EX.kernel_shapley(test, train, features, lambda rows: fitted.score(MO.assemble(rows, features))).drop("error")


def _task(spark: SparkSession, data: DataFrame, plan: DataFrame, features, key, cfg: EvalConfig, root: str):
    endpoint, seed, outer, family = key
    rows = plan.filter((F.col("endpoint") == endpoint) & (F.col("seed") == seed) & (F.col("outer_fold") == outer))
    rows = (rows.select("row_id", F.col("y").cast("int").alias("y"), "role", "inner_fold").join(data, "row_id")
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        return _task_body(rows, features, key, cfg, root)
    finally:
        rows.unpersist()


def _task_body(rows, features, key, cfg: EvalConfig, root: str):
    endpoint, seed, outer, family = key
    train = rows.filter(F.col("role") == "train")
    test = rows.filter(F.col("role") == "test")
    features = _select(train, features, cfg, seed)
    d = len(features)
    # the perceptron takes no weights: its minority rows are repeated instead
    balance = replace(cfg, balancing="random_oversampling") if family == "mlp" and cfg.balancing == "class_weight" else cfg

    def fit_on(part, spec):
        fit_rows, w = _balance(part, features, balance, seed)
        fit_rows = MO.assemble(fit_rows, features)
        return MO.fit(spec, fit_rows, d, weight=w, seed=seed)

    def score(fitted, part):
        return fitted.score(MO.assemble(part, features))

    # M8: search over candidates on the inner folds.
    cands = _candidates(family, cfg, seed)
    best, best_score = cands[0], None
    # Inner folds fit concurrently while the total number of concurrent fits
    # (tasks x inner folds) stays near the core budget of the driver pool.
    inner_pool = ThreadPoolExecutor(max_workers=max(1, min(cfg.n_inner, cfg.concurrent_fits // max(1, cfg.parallelism))))
    try:
        if len(cands) > 1:
            def fit_one(job):
                i, f = job
                try:
                    fitted = fit_on(train.filter(F.col("inner_fold") != f), cands[i])
                except (IllegalArgumentException, ValueError, ArithmeticError) as e:
                    # a candidate that cannot be fitted scores 0; failures of the cluster are raised
                    LOG.warning("candidate %s scores 0: %s", cands[i].describe(), e)
                    return i, None
                part = score(fitted, train.filter(F.col("inner_fold") == f))
                return i, part.select(F.lit(i).alias("candidate"), F.lit(f).alias("inner_fold"), "y", "score")

            parts = list(inner_pool.map(fit_one, [(i, f) for i in range(len(cands)) for f in range(cfg.n_inner)]))
            failed = {i for i, part in parts if part is None}
            scores = _scores([part for i, part in parts if i not in failed], cfg.scorer)
            for i, spec in enumerate(cands):
                s = scores.get(i, 0.0)
                if best_score is None or s > best_score:
                    best, best_score = spec, s

        # M9: validation predictions of the chosen candidate, per inner fold, at the family's own cut.
        def val_fold(f):
            fitted = fit_on(train.filter(F.col("inner_fold") != f), best)
            v = score(fitted, train.filter(F.col("inner_fold") == f))
            return v.select(F.lit(f).alias("inner_fold"), "row_id", "y", "score")

        vals = list(inner_pool.map(val_fold, range(cfg.n_inner)))
    finally:
        inner_pool.shutdown()
    val = vals[0]
    for v in vals[1:]:
        val = val.unionByName(v)
    val = val.select(F.lit(endpoint).alias("endpoint"), F.lit(seed).alias("seed"), F.lit(family).alias("model"),
                     F.lit(outer).alias("outer_fold"), "inner_fold", "row_id", "y", "score",
                     (F.col("score") >= best.cut).cast("int").alias("pred"))
    val_path = _write(val, root, "validation")
    # Refit on all training rows, calibrate, choose the threshold, test.
    fitted = fit_on(train, best)
    tr_v, te_v = MO.assemble(train, features), MO.assemble(test, features)
    te = fitted.score_margin(te_v).withColumnRenamed("score", "raw_score")
    if cfg.calibrate and family != "dummy":
        tr_m = fitted.margin(tr_v)
        a, b = MO.platt_fit(tr_m)
        te, tr_cal = MO.platt_apply(te, a, b), MO.platt_apply(tr_m, a, b)
    else:
        te, tr_cal = te.withColumn("score", F.col("raw_score")), fitted.score(tr_v)
    thr = best.cut
    if cfg.calibrate or family != "svm":  # the sweep covers probabilities; decision values keep their cut
        basis = te if cfg.threshold_on == "test" else tr_cal
        thr_row = CV.best_threshold(CV.threshold_sweep(basis.select("y", "score"), []), []).first()
        thr = float(thr_row["threshold"]) if thr_row else thr
    test_out = te.select(F.lit(endpoint).alias("endpoint"), F.lit(seed).alias("seed"), F.lit(family).alias("model"),
                         F.lit(outer).alias("outer_fold"), "row_id", "y", "score", "raw_score",
                         (F.col("score") >= F.lit(thr)).cast("int").alias("pred"))
    test_path = _write(test_out, root, "test")
    if cfg.model_path and fitted.model is not None:
        fitted.save(f"{cfg.model_path}/{endpoint}/{seed}/{family}/{outer}")
    imps = MO.importances(fitted, features)
    phi = _attributions(fitted, train, test, features, root) if cfg.attribution else None
    if phi is not None:
        phi = _write(phi.select(F.lit(endpoint).alias("endpoint"), F.lit(seed).alias("seed"), F.lit(family).alias("model"),
                                F.lit(outer).alias("outer_fold"), "row_id", "feature", "phi"), root, "attributions")
    return {"key": key, "phi": phi, "val": val_path, "test": test_path, "params": best.describe(), "threshold": thr,
            "search_score": best_score, "importances": imps}


#: Families that are fitted keyed, under balancing by weights or none and without selection.
KEYED = ("dummy", "tree", "forest", "gbt", "logistic")


def keyed_models(cfg: EvalConfig) -> list[str]:
    plain = cfg.balancing in (None, "none", "class_weight") and cfg.selection is None and cfg.model_path is None
    return [m for m in cfg.models if m in KEYED] if plain else []


def _names(cells: UN.Cells) -> DataFrame:
    return F.broadcast(cells.table.sparkSession.createDataFrame(
        [(i, *k) for i, k in enumerate(cells.groups)], "g int, endpoint string, seed int, outer_fold int"))


def _constant(cells: UN.Cells) -> DataFrame:
    """Predictions of the constant baseline in the shape of :data:`UN.OUT`."""
    m = cells.table.select("row_id", F.explode("member").alias("m")).select("row_id", "m.*")
    full = m.withColumn("f", F.lit(UN.FULL)).withColumn("role", F.when(F.col("code") < 0, UN.SCORED).otherwise(UN.BOTH))
    inner = m.filter(F.col("code") >= 0).withColumn("f", F.col("code")).withColumn("role", F.lit(UN.SCORED))
    given = {"kind": F.lit(UN.PREDICTION), "model": F.lit("dummy"), "cand": F.lit(0), "feature": F.lit(None), "score": F.lit(1.0), "margin": F.lit(1.0)}
    types = [p.split(" ") for p in UN.OUT.split(", ")]
    return full.unionByName(inner).select(*[given.get(c, F.col(c) if c not in given else None).cast(t).alias(c) for c, t in types])


def _same_run(spark: SparkSession, cfg: EvalConfig, features, models) -> None:
    """A folder of finished waves belongs to one configuration."""
    own = json.dumps([{k: v for k, v in vars(cfg).items() if k not in ("run_path", "parallelism", "concurrent_fits", "attribute_large")}, list(features), list(models)],
                     default=str, sort_keys=True)
    path = f"{cfg.run_path.rstrip('/')}/signature"
    if not finished(spark, path):
        spark.createDataFrame([(own,)], "signature string").write.mode("overwrite").parquet(path)
    elif spark.read.parquet(path).first()[0] != own:
        raise ValueError(f"{cfg.run_path} holds a run of another configuration")


def _keyed(df: DataFrame, plan: DataFrame, features, models, cfg: EvalConfig, fit_on: DataFrame) -> Results:
    """All units of ``models`` in a number of jobs that does not depend on how many units there are."""
    spark = df.sparkSession
    if cfg.run_path is not None:
        _same_run(spark, cfg, features, models)
    cells = UN.pack(df, plan, features, fit_on)
    groups = range(len(cells.groups))
    cands = {(g, m): list(enumerate(_candidates(m, cfg, cells.groups[g][1]))) for g in groups for m in models}
    balanced = cfg.balancing == "class_weight"
    inner, full = [(g, f) for g in groups for f in range(cfg.n_inner)], [(g, UN.FULL) for g in groups]
    means = UN.training_means(cells) if cfg.attribution and "logistic" in models else None

    def fits(units, chosen) -> DataFrame:
        parts = [_constant(cells).filter(F.col("f").isin(sorted({f for _, f in units})) & F.col("g").isin(sorted({g for g, _ in units})))] \
            if "dummy" in models else []
        if "logistic" in models:
            betas, passes = UN.fit_logistic(cells, {u: chosen[u[0], "logistic"] for u in units}, balanced)
            LOG.info("elastic net: %s coefficient vectors in %s passes", len(betas), passes)
            parts.append(UN.score_logistic(cells, betas, means))
            parts.append(UN.coefficient_rows(cells, betas))
        trees = {k: v for k, v in chosen.items() if k[1] in ("tree", "forest", "gbt")}
        if trees:
            parts.append(UN.fit_trees(cells, units, UN.Job(trees, balanced, cfg.attribution, cfg.attribute_large)))
        return reduce(DataFrame.unionByName, parts)

    def fitted(units, chosen, name) -> DataFrame:
        """Written results of the units: as one table, or with ``run_path`` as one table per
        (endpoint, seed), of which a restarted run fits only those that were not finished."""
        if cfg.run_path is None:
            return UN.stash(fits(units, chosen), name)
        waves: dict = {}
        for u in units:
            waves.setdefault(cells.groups[u[0]][:2], []).append(u)
        paths = [f"{cfg.run_path.rstrip('/')}/{name}/{e}/{s}" for e, s in waves]
        for path, part in zip(paths, waves.values()):
            if not finished(spark, path):
                fits(part, chosen).write.mode("overwrite").parquet(path)      # replaces what a lost run left half-written
        return spark.read.schema(UN.OUT).parquet(*paths)

    best = {k: 0 for k in cands}
    found: dict = {}
    if any(len(v) > 1 for v in cands.values()):
        tried = fitted(inner, cands, "tried")
        scored = tried.filter(F.col("kind") == UN.PREDICTION)
        keys = ["g", "model", "cand", "f"]
        table = CV.roc_auc(scored, keys) if cfg.scorer == "roc_auc" else CV.pr_summary(scored, keys)
        column = "roc_auc" if cfg.scorer == "roc_auc" else "avg_precision"
        rows = table.groupBy("g", "model", "cand").agg(F.avg(F.coalesce(column, F.lit(0.0))).alias("s")).collect()   # a row per candidate
        for r in sorted(rows, key=lambda r: (r["g"], r["model"], -r["s"], r["cand"])):
            if (r["g"], r["model"]) not in found:
                found[r["g"], r["model"]], best[r["g"], r["model"]] = r["s"], r["cand"]
        last = fitted(full, {k: [v[best[k]]] for k, v in cands.items()}, "chosen")
        choice = spark.createDataFrame([(g, m, c) for (g, m), c in best.items()], "g int, model string, cand int")
        out = tried.join(F.broadcast(choice), ["g", "model", "cand"]).select(*last.columns).unionByName(last)
    else:
        out = fitted(inner + full, cands, "units")

    names = _names(cells)
    label = ["endpoint", "seed", "model", "outer_fold"]
    pred = out.filter(F.col("kind") == UN.PREDICTION)
    cut = F.lit(0.5)
    validation = pred.filter(F.col("f") >= 0).join(names, "g").select(
        *label, F.col("f").alias("inner_fold"), "row_id", F.col("y").cast("int").alias("y"), "score", (F.col("score") >= cut).cast("int").alias("pred"))
    whole = pred.filter(F.col("f") == UN.FULL).select("g", "model", "row_id", F.col("y").cast("int").alias("y"), "role", F.col("score").alias("raw_score"), "margin")
    if cfg.calibrate:
        sigmoid = UN.platt_keyed(whole.filter((F.col("role") == UN.BOTH) & (F.col("model") != "dummy")).select("g", "model", "y", "margin"), ["g", "model"])
        ab = spark.createDataFrame([(g, m, a, b) for (g, m), (a, b) in sigmoid.items()], "g int, model string, _a double, _b double")
        whole = whole.join(F.broadcast(ab), ["g", "model"], "left").withColumn("score", F.when(
            F.col("_a").isNull(), F.col("raw_score")).otherwise(F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_a") * F.col("margin") + F.col("_b")))))
    else:
        whole = whole.withColumn("score", F.col("raw_score"))
    whole = UN.stash(whole.select("g", "model", "row_id", "y", "role", "score", "raw_score"), "calibrated")
    basis = whole.filter(F.col("role") == (UN.SCORED if cfg.threshold_on == "test" else UN.BOTH))
    cuts = {(r["g"], r["model"]): float(r["threshold"]) for r in
            CV.best_threshold(CV.threshold_sweep(basis, ["g", "model"]), ["g", "model"]).collect()}                        # a row per unit
    thresholds = spark.createDataFrame([(g, m, cuts.get((g, m), 0.5)) for g, m in cands], "g int, model string, threshold double")
    test = whole.filter(F.col("role") == UN.SCORED).join(F.broadcast(thresholds), ["g", "model"]).join(names, "g").select(
        *label, "row_id", "y", "score", "raw_score", (F.col("score") >= F.col("threshold")).cast("int").alias("pred"))
    params = spark.createDataFrame(
        [(e, s, m, o, cands[g, m][best[g, m]][1].describe(limit=None), cuts.get((g, m), 0.5), found.get((g, m)))
         for g, (e, s, o) in enumerate(cells.groups) for m in models],
        "endpoint string, seed int, model string, outer_fold int, params string, threshold double, search_score double")
    array = F.array(*[F.lit(f) for f in cells.features])
    name = F.element_at(array, F.col("feature") + 1).alias("feature")
    imps = out.filter(F.col("kind") == UN.IMPORTANCE).join(names, "g").select(*label, name, F.col("score").alias("importance"))
    phi = out.filter(F.col("kind") == UN.ATTRIBUTION).join(names, "g").select(*label, "row_id", name, F.col("score").alias("phi"))
    return Results(validation, test, params, imps, phi)


def external_fold_plan(df: DataFrame, external: DataFrame, endpoints, seeds=(42,), n_inner: int = 5,
                       key: str = "row_id") -> DataFrame:
    """Fold table for an external test cohort: every training row is ``train``
    (stratified inner folds per endpoint and seed), every external row ``test``;
    one outer split (``outer_fold = 0``)."""
    from riskfold.functions.exprs import unpivot
    from riskfold.operators.split import ranked

    grid = F.array(*[F.lit(int(s)) for s in seeds])
    lab = (unpivot(df, [key], list(endpoints), "endpoint", "y", cast="string").filter(F.col("y").isNotNull())
           .withColumn("seed", F.explode(grid)))
    tr = ranked(lab, ["endpoint", "seed", "y"],
                F.md5(F.concat_ws("|", col(key).cast("string"), F.col("seed").cast("string"), F.lit("inner"))), "irn")
    tr = tr.select(key, "endpoint", "seed", F.lit(0).alias("outer_fold"), "y", F.lit("train").alias("role"),
                   ((F.col("irn") - 1) % n_inner).cast("int").alias("inner_fold"))
    ex = (unpivot(external, [key], list(endpoints), "endpoint", "y", cast="string").filter(F.col("y").isNotNull())
          .withColumn("seed", F.explode(grid))
          .select(key, "endpoint", "seed", F.lit(0).alias("outer_fold"), "y", F.lit("test").alias("role"),
                  F.lit(None).cast("int").alias("inner_fold")))
    return tr.unionByName(ex)


def pretune(df: DataFrame, features, endpoint: str, family: str, cfg: EvalConfig) -> dict:
    """Parameters of the best of ``pretune_draws`` candidates over all seeds, by score."""
    own = replace(cfg, models=(family,), n_outer=1, search="random", n_iter=cfg.pretune_draws, pretune=False, attribution=False,
                  model_path=None)
    best = evaluate(df, features, [endpoint], own).params.orderBy(F.desc_nulls_last("search_score"), "seed").first()
    return {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(best["params"]).items() if k != "family"}


def evaluate(df: DataFrame, features, endpoints, cfg: EvalConfig | None = None,
             external: DataFrame | None = None) -> Results:
    """Nested evaluation of every family over endpoints x seeds x outer splits.

    With ``external`` (already transformed by the preparation fitted on
    ``df``), models are validated on inner folds of all of ``df`` and tested on
    the external cohort (one outer split)."""
    cfg = cfg or EvalConfig()
    for name, value, known in (("search", cfg.search, ("none", "grid", "random")), ("scorer", cfg.scorer, ("average_precision", "roc_auc")),
                               ("selection", cfg.selection, (None, "importance", "rfecv"))):
        if value not in known:
            raise ValueError(f"no {name} named {value!r}; there are {known}")
    spark = df.sparkSession
    root = scratch_path(spark, "eval")
    if cfg.pretune:
        cfg = replace(cfg, pretune=False, search="none", overrides={**cfg.overrides, **{
            m: pretune(df, features, endpoints[0], m, cfg) for m in cfg.models if m != "dummy"}})
    features = list(features)
    if external is None:
        plan = cut_lineage(nested_fold_plan(df, endpoints, cfg.seeds, cfg.n_outer, cfg.n_inner, cfg.test_fraction))
        both, n_outer = df, cfg.n_outer
    else:
        plan = cut_lineage(external_fold_plan(df, external, endpoints, cfg.seeds, cfg.n_inner))
        both, n_outer = df.select("row_id", *features).unionByName(external.select("row_id", *features)), 1
    keyed = keyed_models(cfg)
    results = [_keyed(both, plan, features, keyed, cfg, df)] if keyed else []
    rest = [m for m in cfg.models if m not in keyed]
    if rest:
        results.append(_pooled(both, plan, features, endpoints, n_outer, rest, cfg, root))

    def joined(name):
        return reduce(DataFrame.unionByName, [getattr(r, name) for r in results])

    return Results(*[joined(n) for n in ("validation", "test", "params", "importances", "attributions")])


def _pooled(both: DataFrame, plan: DataFrame, features, endpoints, n_outer: int, models, cfg: EvalConfig, root: str) -> Results:
    """One task per (endpoint, seed, outer split, family) on a driver thread pool."""
    spark = both.sparkSession
    data = both.select("row_id", *[col(c).cast("double").alias(c) for c in features]).persist(
        StorageLevel.MEMORY_AND_DISK)
    keys = [(e, int(s), o, m) for e in endpoints for s in cfg.seeds for o in range(n_outer) for m in models]
    try:
        with ThreadPoolExecutor(max_workers=max(1, cfg.parallelism)) as pool:
            outs = list(pool.map(lambda k: _task(spark, data, plan, features, k, cfg, root), keys))
    finally:
        data.unpersist()
    val = spark.read.parquet(*[o["val"] for o in outs])
    test = spark.read.parquet(*[o["test"] for o in outs])
    params = spark.createDataFrame(
        [(o["key"][0], o["key"][1], o["key"][3], o["key"][2], o["params"], o["threshold"], o["search_score"])
         for o in outs],
        "endpoint string, seed int, model string, outer_fold int, params string, threshold double, "
        "search_score double")
    imp_rows = [(o["key"][0], o["key"][1], o["key"][3], o["key"][2], f, v) for o in outs for f, v in o["importances"]]
    imps = spark.createDataFrame(imp_rows, "endpoint string, seed int, model string, outer_fold int, "
                                           "feature string, importance double")
    phis = [o["phi"] for o in outs if o["phi"]]
    phi = spark.read.parquet(*phis) if phis else spark.createDataFrame(
        [], "endpoint string, seed int, model string, outer_fold int, row_id long, feature string, phi double")
    return Results(val, test, params, imps, phi)
