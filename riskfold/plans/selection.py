"""Model-based feature selection.

Each fit is a distributed Spark ML job; the loops here iterate over a
handful of fits (seeds, elimination steps), never over rows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions import curves as CV
from riskfold.operators.filters import cumulative_importance
from riskfold.operators.split import stratified_kfold
from riskfold.plans import models as MO
from riskfold.plans import units as UN
from riskfold.session import cut_lineage


def gbm_importance(df: DataFrame, features, n_iterations: int = 10, max_iter: int = 1000,
                   learning_rate: float = 0.05, label: str = "y", task: str = "classification") -> DataFrame:
    """M7: boosted-tree importances averaged over ``n_iterations`` seeds, with
    early stopping on the hold-out rows (``role = 'valid'``); then normalised
    and cumulated (W1).  ``task``: classification of a 0/1 label, or regression."""
    if task not in ("classification", "regression"):
        raise ValueError(f"no importance task named {task!r}")
    kind = GBTClassifier if task == "classification" else GBTRegressor
    spark = df.sparkSession
    d = MO.assemble(df.withColumn("_valid", F.col("role") == "valid")
                    .withColumn(label, F.col(label).cast("double")), features)
    acc = [0.0] * len(features)
    for i in range(n_iterations):
        m = kind(featuresCol="features", labelCol=label, maxIter=max_iter, stepSize=learning_rate,
                          seed=i, validationIndicatorCol="_valid", validationTol=0.01).fit(d)
        for j, v in enumerate(m.featureImportances.toArray()):
            acc[j] += float(v) / n_iterations
    imp = spark.createDataFrame(list(zip(features, acc)), "feature string, importance double")
    return cumulative_importance(imp)


def select_from_model(imp: DataFrame) -> DataFrame:
    """Features whose importance is at least the mean importance."""
    mean = imp.agg(F.avg("importance")).first()[0] or 0.0
    return imp.filter(F.col("importance") >= F.lit(mean)).select("feature", "importance")


def rfecv(train: DataFrame, features, min_fraction: float = 0.5, cv: int = 5,
          spec: MO.ModelSpec | None = None, seed: int = 42) -> DataFrame:
    """Recursive elimination (one feature per step, weakest importance
    first) scored by cross-validated average precision down to
    ``int(n * min_fraction)`` features; the best step is marked selected.

    The rows are packed once; a step is one keyed job that fits the folds and the
    whole together.  Above ``units.LOCAL_ROWS`` rows each step packs its own features,
    and the fits grow by passes."""
    spec = spec or MO.ModelSpec.of("gbt", n_estimators=100)
    spark, features = train.sparkSession, list(features)
    folds = stratified_kfold(train, "y", cv, seed).select("row_id", F.col("y").cast("string").alias("y"), F.col("fold").alias("inner_fold"))
    plan = cut_lineage(folds.select("row_id", F.lit("y").alias("endpoint"), F.lit(seed).alias("seed"), F.lit(0).alias("outer_fold"), "y",
                                    F.lit("train").alias("role"), "inner_fold"))
    whole = UN.pack(train, plan, features)
    units = [(0, f) for f in range(cv)] + [(0, UN.FULL)]
    cur, rows = list(features), []
    while True:
        if whole.rows(0) > UN.LOCAL_ROWS:
            cells, names, job = UN.pack(train, plan, cur), cur, UN.Job({(0, spec.family): [(0, spec)]}, balanced=False)
        else:
            cells, names = whole, features
            job = UN.Job({(0, spec.family): [(0, spec)]}, balanced=False, columns=tuple(features.index(c) for c in cur))
        out = UN.stash(UN.fit_trees(cells, units, job), "elimination")
        held = out.filter((F.col("kind") == UN.PREDICTION) & (F.col("f") >= 0)).select("f", "y", "score")
        score = CV.pr_summary(held, ["f"]).agg(F.avg(F.coalesce("avg_precision", F.lit(0.0)))).first()[0] or 0.0
        rows.append((len(cur), score, ",".join(cur)))
        if len(cur) <= max(1, int(len(features) * min_fraction)):
            break
        weights = {names[r["feature"]]: r["score"] for r in out.filter(F.col("kind") == UN.IMPORTANCE).collect()}     # a row per feature
        weakest = min(cur, key=lambda c: (weights[c], c))
        cur = [c for c in cur if c != weakest]
    best = max(rows, key=lambda r: (r[1], -r[0]))
    return spark.createDataFrame([(n, s, f, (n, s, f) == best) for n, s, f in rows],
                                 "n_features int, cv_score double, features string, selected boolean")
