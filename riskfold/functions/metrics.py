"""Confusion-based classification metrics (C1) for every key at once.

Input: a predictions table with key columns, a 0/1 label ``y`` and a 0/1
prediction ``pred``.  One grouped aggregate (partial per task) gives the
2x2 matrix per key; the metrics are expressions over its four counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.exprs import zero_div

METRICS = ("balanced_accuracy", "recall", "precision", "mcc", "f1_score")
CURVE_METRICS = ("roc_auc", "prc_auc", "avg_precision")
ALL_METRICS = METRICS + CURVE_METRICS


def confusion_counts(pred: DataFrame, keys, y="y", p="pred") -> DataFrame:
    """``(keys..., tn, fp, fn, tp)`` as longs, always the full 2x2 matrix."""
    yy, pp = F.col(y), F.col(p)
    return pred.groupBy(*keys).agg(
        F.count(F.when((yy == 0) & (pp == 0), 1)).alias("tn"),
        F.count(F.when((yy == 0) & (pp == 1), 1)).alias("fp"),
        F.count(F.when((yy == 1) & (pp == 0), 1)).alias("fn"),
        F.count(F.when((yy == 1) & (pp == 1), 1)).alias("tp"))


def metric_columns(tn="tn", fp="fp", fn="fn", tp="tp") -> list:
    """Metric expressions over the four counts (undefined ratios are 0;
    balanced accuracy averages the recall of the classes present)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in (tn, fp, fn, tp))
    pos, neg = tp + fn, tn + fp
    rec1 = F.try_divide(tp, pos)
    rec0 = F.try_divide(tn, neg)
    bal = F.when((pos > 0) & (neg > 0), (rec1 + rec0) / 2).when(pos > 0, rec1).when(neg > 0, rec0)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)
    return [bal.alias("balanced_accuracy"),
            zero_div(tp, pos).alias("recall"),
            zero_div(tp, tp + fp).alias("precision"),
            mcc.alias("mcc"),
            zero_div(2 * tp, 2 * tp + fp + fn).alias("f1_score")]


def classification_metrics(pred: DataFrame, keys, y="y", p="pred") -> DataFrame:
    """``(keys..., tn, fp, fn, tp, balanced_accuracy, recall, precision, mcc, f1_score)``."""
    cm = confusion_counts(pred, keys, y, p)
    return cm.select(*keys, "tn", "fp", "fn", "tp", *metric_columns())


def threshold_labels(score: str = "score", threshold: float = 0.5):
    """``(score >= t)`` as 0/1 int."""
    return (F.col(score) >= F.lit(threshold)).cast("int")
