"""Model families, candidate grids and scoring on Spark ML.

Every family scores rows with a positive-class column ``score`` (a
probability, or a decision value for the linear SVM) computed JVM-side
(``vector_to_array``), so predictions stay a plain DataFrame that the
metric and curve operators aggregate by key.

Trees and forests with the gini criterion are fitted as regressors on the
0/1 label: variance reduction equals gini reduction / 2 and a leaf mean is
the leaf's positive share, and Spark's classifier trees would merge sibling
leaves with equal predicted labels (losing distinct probabilities).
"""

from __future__ import annotations

import itertools
import json
import math
import random
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions.exprs import col
from riskfold.plans.boost import ExpBoost, WeightedTree, fit_exp_boost

MAX_DEPTH = 30      # Spark's own tree depth limit; "no limit" is reported as this depth
MAX_BINS = 64       # split candidates per feature of trees, forests and boosting
MLP_ITERATIONS = 200
MLP_STEP = 30.0     # plain gradient steps per unit of learning rate (rates are given for normalised steps)

# Candidate grids per family (the random tree splitter is fitted
# keyed only, Spark ML has none).
GRIDS = {
    "dummy": {},
    "tree": {"max_depth": [5, 10, None], "max_features": ["sqrt", "log2", None], "criterion": ["gini", "entropy"],
             "splitter": ["best", "random"]},
    "forest": {"n_estimators": [10, 100], "criterion": ["gini", "entropy"], "max_depth": [5, 10, None],
               "max_features": ["sqrt", "log2", None]},
    "gbt": {"learning_rate": [0.01, 0.1, 0.3], "n_estimators": [100, 1000], "max_depth": [3, 5, 10],
            "max_features": ["sqrt", "log2", None], "loss": ["log_loss", "exponential"]},
    "logistic": {"l1_ratio": [0.0, 0.25, 0.5, 0.75, 1.0], "C": [0.1, 0.5, 1.0, 5.0]},
    "svm": {"C": [0.1, 0.5, 1.0, 10.0, 100.0]},
    "mlp": {"hidden": [(128, 64), (64, 32), (32, 16), (32, 32), (64,), (32,), (16,)],
            "learning_rate_init": [0.1, 0.05, 0.01, 0.005, 0.001]},
}

# Library defaults of each family.
DEFAULTS = {
    "dummy": {},
    "tree": {"max_depth": None, "max_features": None, "criterion": "gini", "splitter": "best"},
    "forest": {"n_estimators": 100, "criterion": "gini", "max_depth": None, "max_features": "sqrt"},
    "gbt": {"learning_rate": 0.1, "n_estimators": 100, "max_depth": 3, "max_features": None, "loss": "log_loss"},
    "logistic": {"l1_ratio": 0.0, "C": 1.0},
    "svm": {"C": 1.0},
    "mlp": {"hidden": (100,), "learning_rate_init": 0.001},
}

# Display names of the families in result tables.
DISPLAY = {"dummy": "Dummy", "tree": "Decision Tree", "forest": "Random Forest", "gbt": "Gradient Boosting",
           "logistic": "Logistic Regression", "svm": "Linear SVM", "mlp": "MLP"}


@dataclass(frozen=True)
class ModelSpec:
    family: str
    params: tuple = field(default_factory=tuple)   # sorted (name, value) pairs

    @staticmethod
    def of(family: str, **params) -> "ModelSpec":
        full = dict(DEFAULTS[family])
        full.update(params)
        return ModelSpec(family, tuple(sorted(full.items())))

    @property
    def p(self) -> dict:
        return dict(self.params)

    def describe(self, limit: int | None = MAX_DEPTH) -> str:
        """Parameters as fitted: a depth of ``None`` is Spark ML's limit (keyed fits have none)."""
        p = self.p
        if "max_depth" in p and p["max_depth"] is None:
            p["max_depth"] = limit
        return json.dumps({"family": self.family, **p}, default=str)

    @property
    def cut(self) -> float:
        """Score from which a row counts as positive: 0 for decision values, else one half."""
        return 0.0 if self.family == "svm" else 0.5


def grid(family: str) -> list[ModelSpec]:
    """M8: full candidate grid of a family."""
    g = GRIDS[family]
    if not g:
        return [ModelSpec.of(family)]
    keys = sorted(g)
    return [ModelSpec.of(family, **dict(zip(keys, vals))) for vals in itertools.product(*[g[k] for k in keys])]


def random_candidates(family: str, n_iter: int = 10, seed: int = 42) -> list[ModelSpec]:
    """M8: ``n_iter`` distinct draws from the grid (all of it when smaller)."""
    full = grid(family)
    if len(full) <= n_iter:
        return full
    return random.Random(seed).sample(full, n_iter)


def _subset(v):
    return {"sqrt": "sqrt", "log2": "log2", None: "all"}[v]


def _depth(v):
    return MAX_DEPTH if v is None else int(v)


def estimator(spec: ModelSpec, n_rows: int, features="features", label="y", weight: str | None = None,
              seed: int = 42) -> Estimator | None:
    """Spark ML estimator for a spec (None for the constant baseline)."""
    p, f = spec.p, spec.family
    common = {"featuresCol": features, "labelCol": label}
    if f == "dummy":
        return None
    if f in ("tree", "forest"):
        if p.get("splitter") == "random":
            raise ValueError("random thresholds are fitted keyed only")
        n_trees = 1 if f == "tree" else int(p["n_estimators"])
        kw = dict(common, numTrees=n_trees, maxDepth=_depth(p["max_depth"]),
                  featureSubsetStrategy=_subset(p["max_features"]), seed=seed, maxBins=MAX_BINS)
        if f == "tree":
            kw.update(bootstrap=False, subsamplingRate=1.0)
        if weight:
            kw["weightCol"] = weight
        if p["criterion"] == "gini":
            return RandomForestRegressor(**kw)
        return RandomForestClassifier(impurity="entropy", **kw)
    if f == "gbt":
        kw = dict(common, maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]),
                  maxDepth=_depth(p["max_depth"]), featureSubsetStrategy=_subset(p["max_features"]), seed=seed,
                  maxBins=MAX_BINS)
        return GBTClassifier(**kw)  # boosting takes no class weights, as in the original workflow
    if f == "logistic":
        kw = dict(common, elasticNetParam=float(p["l1_ratio"]), regParam=1.0 / (float(p["C"]) * max(n_rows, 1)),
                  standardization=False, maxIter=5000, family="binomial")
        if weight:
            kw["weightCol"] = weight
        return LogisticRegression(**kw)
    if f == "svm":
        kw = dict(common, regParam=1.0 / (float(p["C"]) * max(n_rows, 1)), maxIter=1000, tol=1e-4,
                  standardization=False)
        if weight:
            kw["weightCol"] = weight
        return LinearSVC(**kw)
    if f == "mlp":
        raise ValueError("mlp needs the feature count; use mlp_estimator")
    raise ValueError(f"unknown family {f}")


def mlp_estimator(spec: ModelSpec, n_features: int, features="features", label="y", seed: int = 42):
    p = spec.p
    layers = [n_features, *list(p["hidden"]), 2]
    # gradient steps: the only solver of the engine that uses the learning rate
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=layers, seed=seed,
                                          stepSize=MLP_STEP * float(p["learning_rate_init"]), maxIter=MLP_ITERATIONS, solver="gd")


@dataclass
class Fitted:
    spec: ModelSpec
    model: object | None   # Spark ML model or None (constant)

    def score(self, df: DataFrame, features="features") -> DataFrame:
        """Add ``score`` (positive-class probability or decision value)."""
        return self.score_margin(df).drop("margin")

    def save(self, path: str) -> None:
        """Keep the fitted model (an exponential booster: each weighted tree, its weight in the name)."""
        if isinstance(self.model, ExpBoost):
            for i, (tree, alpha) in enumerate(self.model.stages):
                at = f"{path}/stage-{i:04d}-{alpha:.17g}"
                if isinstance(tree, WeightedTree):      # a node table
                    SparkSession.active().createDataFrame(tree.rows(), WeightedTree.SCHEMA).write.mode("overwrite").parquet(at)
                else:
                    tree.write().overwrite().save(at)
        else:
            self.model.write().overwrite().save(path)

    def margin(self, df: DataFrame) -> DataFrame:
        """Add ``margin`` (see :meth:`score_margin`)."""
        return self.score_margin(df).drop("score")

    def score_margin(self, df: DataFrame) -> DataFrame:
        """Add ``score`` and ``margin`` from one transform.  The margin is the
        decision value for calibration: raw margin for boosting / logistic / SVM,
        otherwise the probability itself."""
        if self.model is None:
            return df.withColumn("score", F.lit(1.0)).withColumn("margin", F.lit(1.0))
        fam = self.spec.family
        if isinstance(self.model, ExpBoost):
            out = self.model.score(df)
            return out.withColumn("margin", F.log(F.col("score") / (1 - F.col("score"))) / 2)
        out = self.model.transform(df)
        raw = vector_to_array(F.col("rawPrediction"))[1] if fam in ("gbt", "logistic", "svm") else None
        if fam in ("tree", "forest") and self.spec.p["criterion"] == "gini":
            s = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
        elif fam == "svm":
            s = raw
        else:
            s = vector_to_array(F.col("probability"))[1]
        return out.select(*[col(c) for c in df.columns], s.alias("score"), (s if raw is None else raw).alias("margin"))


def fit(spec: ModelSpec, train: DataFrame, n_features: int, features="features", label="y",
        weight: str | None = None, seed: int = 42, n_rows: int | None = None) -> Fitted:
    """Fit one candidate; the label is cast to double for Spark ML."""
    if spec.family == "dummy":
        return Fitted(spec, None)
    # Spark ML caches its own instance / tree-point RDD for the iterations; the
    # caller persists the (unassembled) rows it reuses across fits.
    data = train.withColumn(label, col(label).cast("double"))
    if spec.family == "gbt" and spec.p["loss"] == "exponential":
        return Fitted(spec, fit_exp_boost(data, spec.p["n_estimators"], _depth(spec.p["max_depth"]),
                                          float(spec.p["learning_rate"]), label, features, seed=seed))
    if spec.family == "mlp" and weight:
        raise ValueError("the multilayer perceptron takes no row weights; balance its rows instead")
    n = n_rows if n_rows is not None else (data.count() if spec.family in ("logistic", "svm") else 0)
    est = mlp_estimator(spec, n_features, features, label, seed) if spec.family == "mlp" else \
        estimator(spec, n, features, label, weight, seed)
    return Fitted(spec, est.fit(data))


def assemble(df: DataFrame, features, out="features") -> DataFrame:
    """Assemble the prepared double columns into one vector column."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def importances(fitted: Fitted, feature_names) -> list[tuple[str, float]]:
    """Impurity importances (trees, forests, boosting) or coefficients
    (logistic, SVM); empty for models with neither."""
    m = fitted.model
    if m is None:
        return []
    if isinstance(m, ExpBoost):
        total = sum(a for _, a in m.stages) or 1.0
        mean = sum(a / total * t.featureImportances.toArray() for t, a in m.stages) if m.stages else [0.0] * len(feature_names)
        return [(n, float(x)) for n, x in zip(feature_names, mean)]
    if hasattr(m, "featureImportances"):
        v = m.featureImportances.toArray()
    elif hasattr(m, "coefficients"):
        v = m.coefficients.toArray()
    else:
        return []
    return [(n, float(x)) for n, x in zip(feature_names, v)]


# -- C10 Platt calibration -------------------------------------------------------


def platt_fit(scored: DataFrame, label="y", margin="margin", max_iter: int = 100) -> tuple[float, float]:
    """Fit ``p = 1 / (1 + exp(A f + B))`` with the smoothed targets
    ``(n+ + 1) / (n+ + 2)`` (positives) and ``1 / (n- + 2)`` (negatives) by
    Newton's method with step halving.  Each iteration is one aggregate
    (gradient, Hessian and log-likelihood summed over rows, partial per task);
    only five numbers reach the driver."""
    rows = scored.select(F.col(margin).cast("double").alias("f"), col(label).alias("_y")).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        counts = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
        n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
        t_pos, t_neg = (n_pos + 1.0) / (n_pos + 2.0), 1.0 / (n_neg + 2.0)
        t = F.when(F.col("_y") == 1, F.lit(t_pos)).otherwise(F.lit(t_neg))

        def stats(a, b):
            z = F.lit(a) * F.col("f") + F.lit(b)
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(z))          # P(positive)
            # -log-likelihood, written stably for either sign of z
            nll = F.when(z >= 0, (t * z) + F.log1p(F.exp(-z))).otherwise(((t - 1) * z) + F.log1p(F.exp(z)))
            w = p * (1 - p)
            r = rows.agg(F.sum(nll).alias("L"), F.sum((t - p) * F.col("f")).alias("g1"),
                         F.sum(t - p).alias("g2"), F.sum(w * F.col("f") * F.col("f")).alias("h11"),
                         F.sum(w * F.col("f")).alias("h12"), F.sum(w).alias("h22")).first()
            return r

        a, b = 0.0, math.log((n_neg + 1.0) / (n_pos + 1.0))
        cur = stats(a, b)
        for _ in range(max_iter):
            h11, h12, h22 = cur["h11"] + 1e-12, cur["h12"], cur["h22"] + 1e-12
            det = h11 * h22 - h12 * h12
            if det == 0:
                break
            da = -(h22 * cur["g1"] - h12 * cur["g2"]) / det
            db = -(-h12 * cur["g1"] + h11 * cur["g2"]) / det
            step = 1.0
            while step >= 1e-10:
                nxt = stats(a + step * da, b + step * db)
                if nxt["L"] <= cur["L"] + 1e-4 * step * (cur["g1"] * da + cur["g2"] * db):
                    break
                step /= 2
            if step < 1e-10:
                break
            a, b, cur = a + step * da, b + step * db, nxt
            if abs(step * da) < 1e-10 and abs(step * db) < 1e-10:
                break
        return a, b
    finally:
        rows.unpersist()


def platt_apply(df: DataFrame, a: float, b: float, margin="margin", out="score") -> DataFrame:
    return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(a) * F.col(margin) + F.lit(b))))


# -- M14 tree as a table -------------------------------------------------------------


def tree_nodes(spark: SparkSession, fitted: Fitted, path: str) -> DataFrame:
    """Save the model and read back its node table (one row per node)."""
    fitted.model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    return nodes.select(*[c for c in nodes.columns if c in (
        "treeID", "id", "prediction", "impurity", "gain", "leftChild", "rightChild", "rawCount")],
        *([F.col("split.featureIndex").alias("feature_index"),
           F.col("split.leftCategoriesOrThreshold").alias("threshold")] if "split" in nodes.columns else []))
