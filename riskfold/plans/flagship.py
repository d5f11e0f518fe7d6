"""Flagship evaluation: order cohort → preparation → nested evaluation → summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskfold.operators.transforms import PrepConfig, prepare
from riskfold.plans.evaluate import EvalConfig, evaluate
from riskfold.session import ensure_checkpoint_dir
from riskfold.sources.cohorts import ORDER_CATALOG, order_cohort

#: The default repetitions of the reference, and the endpoints of the order cohort.
SEEDS = (0, 111, 222, 333, 444)
ENDPOINTS = ["returned", "pending"]


def prepared_orders(spark: SparkSession, sf_dir: str, imputer: str = "knn", normaliser: str = "standard"):
    """Prepared order cohort ``(row_id, features..., returned, pending)`` and its feature names."""
    oc = order_cohort(spark, sf_dir)
    cfg = PrepConfig(imputer=imputer, normaliser=normaliser, missing_threshold=0.5, drop_single_unique=True,
                     correlation_threshold=0.95)
    prep = prepare(oc, ORDER_CATALOG, cfg)
    return prep.fitted_rows(), prep.features


FLAGSHIP = EvalConfig(seeds=SEEDS)


def flagship(spark: SparkSession, sf_dir: str, cfg: EvalConfig = FLAGSHIP) -> DataFrame:
    ensure_checkpoint_dir(spark)
    df, feats = prepared_orders(spark, sf_dir)
    res = evaluate(df, feats, ENDPOINTS, cfg)
    return res.summary()
