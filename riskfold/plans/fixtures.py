"""Derived inputs shared by the registered queries: the prepared order cohort
and a keyed predictions table built from cohort columns (scores that need
no model, so curve and metric operators can be checked exactly)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions.exprs import unpivot
from riskfold.operators.split import ranked
from riskfold.sources.cohorts import order_cohort

SEED = 42
FOLDS = 5


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(endpoint, model, fold, row_id, y, score, pred)``.

    Endpoints ``returned`` and ``pending``; two score columns ("lines":
    ``least(1, lines / 10)`` with heavy ties, "qty": ``least(1, qty / 300)``);
    folds: stratified 5-fold per endpoint in md5 order."""
    oc = order_cohort(spark, sf_dir)
    base = oc.select("row_id",
                     F.least(F.lit(1.0), F.coalesce(F.col("lines"), F.lit(0.0)) / 10.0).alias("s_lines"),
                     F.least(F.lit(1.0), F.coalesce(F.col("qty"), F.lit(0.0)) / 300.0).alias("s_qty"),
                     "returned", "pending")
    lab = unpivot(base, ["row_id", "s_lines", "s_qty"], ["returned", "pending"], "endpoint", "y", cast="int")
    r = ranked(lab, ["endpoint", "y"], F.md5(F.concat_ws("|", F.col("row_id").cast("string"), F.lit(str(SEED)))))
    folded = r.withColumn("fold", ((F.col("rn") - 1) % FOLDS).cast("int"))
    scores = F.explode(F.array(F.struct(F.lit("lines").alias("model"), F.col("s_lines").alias("score")),
                               F.struct(F.lit("qty").alias("model"), F.col("s_qty").alias("score"))))
    out = folded.select("endpoint", "fold", "row_id", "y", scores.alias("m"))
    return out.select("endpoint", F.col("m.model").alias("model"), "fold", "row_id", "y",
                      F.col("m.score").alias("score"),
                      (F.col("m.score") >= 0.5).cast("int").alias("pred"))
