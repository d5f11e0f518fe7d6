"""Result tables: per-fold metrics, their summaries over folds and seeds
(A3, A4, A8), cross-model curve tables (C11), comparison rows (C12) and
sinks (S7-S10).  Figures of the original workflow become these tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions import curves as CV
from riskfold.functions import metrics as ME

SUMMARY_METRICS = ("balanced_accuracy", "recall", "precision", "mcc", "f1_score", "roc_auc", "avg_precision",
                   "prc_auc")


def fold_metrics(pred: DataFrame, keys, y="y", score="score", p="pred") -> DataFrame:
    """All metrics of every key: confusion counts, C1 metrics, ROC AUC, AP, PR AUC."""
    keys = list(keys)
    cm = ME.classification_metrics(pred, keys, y, p)
    cum = CV.curve_table(pred, keys, y, score)
    auc = CV.roc_auc(pred, keys, y, score, cum)
    prs = CV.pr_summary(pred, keys, y, score, cum).select(*keys, "avg_precision", "prc_auc")
    return cm.join(auc, keys).join(prs, keys)


def metric_summary(fm: DataFrame, keys, metrics=SUMMARY_METRICS) -> DataFrame:
    """A3: mean, sample std, count, min, max per metric: ``<metric>_<agg>`` columns."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"),
                 F.count(m).alias(f"{m}_count"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return fm.groupBy(*keys).agg(*aggs)


def metric_rollup(fm: DataFrame, metrics=SUMMARY_METRICS) -> DataFrame:
    """A3 over seeds as well: rollup (endpoint, model, seed) → seed NULL rows are over all seeds."""
    aggs = [F.avg(m).alias(f"{m}_mean") for m in metrics] + [F.stddev_samp(m).alias(f"{m}_std") for m in metrics]
    return fm.rollup("endpoint", "model", "seed").agg(*aggs).filter(F.col("model").isNotNull())


def cm_over_folds(cm: DataFrame, keys) -> DataFrame:
    """A4: confusion matrices summed (and averaged) over folds."""
    return cm.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")],
                                 *[F.avg(c).alias(f"{c}_mean") for c in ("tn", "fp", "fn", "tp")])


def metric_boxplot(fm: DataFrame, keys, metrics=SUMMARY_METRICS) -> DataFrame:
    """Five-number summary per (keys, metric) over folds with 1.5·IQR whiskers.

    A group holds one value per fold, so the exact ``percentile`` is bounded."""
    keys = list(keys)
    long = fm.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double")
                                                         .alias("value")) for m in metrics])).alias("kv"))
    long = long.select(*keys, "kv.metric", "kv.value")
    q = long.groupBy(*keys, "metric").agg(F.percentile("value", 0.25).alias("q1"),
                                          F.percentile("value", 0.5).alias("median"),
                                          F.percentile("value", 0.75).alias("q3"))
    w = long.join(q, [*keys, "metric"]).withColumn("iqr", F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    return (w.groupBy(*keys, "metric", "q1", "median", "q3", "iqr")
            .agg(F.min(F.when(F.col("value") >= lo, F.col("value"))).alias("whisker_low"),
                 F.max(F.when(F.col("value") <= hi, F.col("value"))).alias("whisker_high"),
                 F.count(F.when((F.col("value") < lo) | (F.col("value") > hi), 1)).alias("fliers")))


def summary_curves(mean_roc: DataFrame, names: dict, exclude=("dummy",)) -> DataFrame:
    """C11: fold-mean ROC of every model except the constant baseline, with display labels."""
    expr = F.col("model")
    for k, v in reversed(list(names.items())):
        expr = F.when(F.col("model") == k, F.lit(v)).otherwise(expr)
    return (mean_roc.filter(~F.col("model").isin(list(exclude)))
            .select("endpoint", "model", "g", "fpr", "mean_tpr", "mean_auc", expr.alias("label")))


def individual_metrics(validation: DataFrame, test: DataFrame, keys, metrics=SUMMARY_METRICS) -> DataFrame:
    """One row per key with ``<metric>_validation`` and ``<metric>_test``."""
    v = validation.select(*keys, *[F.col(m).alias(f"{m}_validation") for m in metrics])
    t = test.select(*keys, *[F.col(m).alias(f"{m}_test") for m in metrics])
    return v.join(t, list(keys), "full")


def metrics_map(fm: DataFrame, metrics=SUMMARY_METRICS) -> DataFrame:
    """``(endpoint, metric, values)`` where ``values`` maps model → fold values
    (ordered by fold) – the JSON summary as a table (``to_json`` on write)."""
    long = fm.select("endpoint", "model", "fold",
                     F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v"))
                                         for m in metrics])).alias("kv"))
    per_model = (long.groupBy("endpoint", "kv.metric", "model")
                 .agg(F.array_sort(F.collect_list(F.struct("fold", F.col("kv.v").alias("v")))).alias("fv")))
    per_model = per_model.select("endpoint", "metric", "model", F.transform("fv", lambda s: s["v"]).alias("vals"))
    return (per_model.groupBy("endpoint", "metric")
            .agg(F.map_from_entries(F.collect_list(F.struct("model", "vals"))).alias("values")))


def write_results(df: DataFrame, path: str, partition_by=("endpoint", "seed", "model"), mode="append",
                  fmt="parquet", run_id: str | None = None) -> None:
    """Results as partitioned tables (partition pruning on read)."""
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(run_id))
    cols = [c for c in partition_by if c in df.columns]
    w = df.write.mode(mode)
    if cols:
        w = w.partitionBy(*cols)
    w.format(fmt).save(path)


def run_id() -> str:
    """Run directory stamp ``%Y-%m-%d_T_%H-%M-%S`` (UTC)."""
    import datetime as _dt
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d_T_%H-%M-%S")

