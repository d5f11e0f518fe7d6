"""Exact ROC / precision-recall / calibration curves and their areas
for every key of a predictions table at once.

Plan (no global sort per key):
1. group by ``(keys, score)`` → positive / negative counts (map-side partial
   aggregation; a hot score value collapses to one row), checkpointed once: the
   predictions are read by this one pass only;
2. running sums in score-descending order in two levels: per-(key, bucket)
   totals give bucket offsets, rows are then summed inside their bucket.
   ``bucket`` is a quantile range of the scores, so buckets are even however the
   scores lie;
3. ROC and PR points, areas and the grid all derive from that one table
   (:func:`curve_table`); callers that want several of them build it once and
   hand it over as ``cum``;
4. grid interpolation and threshold sweeps aggregate into 101 cells per key
   and finish with a window over those cells only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.operators.ranges import value_bucket
from riskfold.session import cut_lineage

GRID = 101          # fixed value: 101-point grid 0, 0.01, ..., 1
CAL_BINS = 10       # fixed value: 10 equal-width calibration bins


def grid_value(i) -> F.Column:
    """Grid point i: ``i * 0.01`` in double arithmetic, the last exactly 1.0."""
    i = i if isinstance(i, F.Column) else F.lit(i)
    return F.when(i >= GRID - 1, F.lit(1.0)).otherwise(i.cast("double") * F.lit(0.01))


def score_counts(pred: DataFrame, keys, y="y", score="score") -> DataFrame:
    """``(keys..., score, pos, neg)`` per distinct score."""
    return (pred.groupBy(*keys, F.col(score).alias("score"))
            .agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"),
                 F.count(F.when(F.col(y) == 0, 1)).alias("neg")))


def cumulative(counts: DataFrame, keys) -> DataFrame:
    """Add ``tp, fp`` (counts at score >= this score) and key totals ``P, N``."""
    keys = list(keys)
    c = value_bucket(counts, "score", "_b")
    per_b = c.groupBy(*keys, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wk = Window.partitionBy(*keys)
    wb = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offs = per_b.select(*keys, "_b",
                        F.coalesce(F.sum("_bp").over(wb), F.lit(0)).alias("_op"),
                        F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_on"),
                        F.sum("_bp").over(wk).alias("P"), F.sum("_bn").over(wk).alias("N"))
    wi = (Window.partitionBy(*keys, "_b").orderBy(F.col("score").desc())
          .rowsBetween(Window.unboundedPreceding, 0))
    j = c.join(offs, [*keys, "_b"])
    return j.select(*keys, "score", "pos", "neg",
                    (F.col("_op") + F.sum("pos").over(wi)).alias("tp"),
                    (F.col("_on") + F.sum("neg").over(wi)).alias("fp"),
                    "P", "N")


def curve_table(pred: DataFrame, keys, y="y", score="score") -> DataFrame:
    """Running sums of every key, materialised: the input of all curves and areas."""
    return cut_lineage(cumulative(cut_lineage(score_counts(pred, list(keys), y, score)), keys))


# -- ROC (C2, C3, C4) ----------------------------------------------------------


def roc_points(pred: DataFrame, keys, y="y", score="score", cum: DataFrame | None = None) -> DataFrame:
    """``(keys..., threshold, fpr, tpr)``: the origin (threshold NULL) and
    one point per distinct score."""
    keys = list(keys)
    cum = cum if cum is not None else curve_table(pred, keys, y, score)
    pts = cum.select(*keys, F.col("score").alias("threshold"),
                     F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
                     F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"))
    origin = cum.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("threshold"),
                                                  F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def roc_auc(pred: DataFrame, keys, y="y", score="score", cum: DataFrame | None = None) -> DataFrame:
    """Exact trapezoidal ROC AUC with tied scores grouped: ``(keys..., roc_auc)``."""
    keys = list(keys)
    cum = cum if cum is not None else curve_table(pred, keys, y, score)
    term = F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("pos").cast("double") / 2)
    return (cum.groupBy(*keys)
            .agg(F.sum(term).alias("_a"), F.first("P").alias("P"), F.first("N").alias("N"))
            .select(*keys, F.try_divide(F.col("_a"), F.col("P").cast("double") * F.col("N")).alias("roc_auc")))


def roc_grid(pred: DataFrame, keys, y="y", score="score", cum: DataFrame | None = None) -> DataFrame:
    """ROC interpolated on the 101-point grid, ``(keys..., g, fpr, tpr)``.

    At grid x: left = last curve point with fpr <= x (highest tpr among tied
    fpr), right = first point with fpr > x; linear interpolation; x beyond the
    last point → last tpr."""
    keys = list(keys)
    pts = roc_points(pred, keys, y, score, cum).filter(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
    x = F.col("fpr")
    c0 = F.least(F.floor(x * 100).cast("int"), F.lit(GRID - 1))
    # cell = largest grid index with grid_value <= fpr (guards float edges)
    cell = (F.when((c0 + 1 <= GRID - 1) & (x >= grid_value(c0 + 1)), c0 + 1)
            .when(x >= grid_value(c0), c0).otherwise(c0 - 1))
    p = pts.withColumn("cell", cell).withColumn("pt", F.struct(F.col("fpr"), F.col("tpr")))
    on_edge = F.col("fpr") == grid_value(F.col("cell"))
    per = p.groupBy(*keys, "cell").agg(
        F.max("pt").alias("cmax"), F.min("pt").alias("cmin"),
        F.max(F.when(on_edge, F.col("pt"))).alias("eqmax"),
        F.min(F.when(~on_edge, F.col("pt"))).alias("gtmin"))
    grid = per.select(*keys).distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    cells = grid.join(per.withColumnRenamed("cell", "g"), [*keys, "g"], "left")
    before = Window.partitionBy(*keys).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("g").rowsBetween(1, Window.unboundedFollowing)
    cells = cells.select(*keys, "g",
                         F.greatest(F.max("cmax").over(before), F.col("eqmax")).alias("L"),
                         F.least(F.col("gtmin"), F.min("cmin").over(after)).alias("R"))
    xg = grid_value(F.col("g"))
    slope = (F.col("R.tpr") - F.col("L.tpr")) / (F.col("R.fpr") - F.col("L.fpr"))
    tpr = (F.when(F.col("L").isNull(), F.lit(0.0))
           .when(F.col("R").isNull(), F.col("L.tpr"))
           .otherwise(slope * (xg - F.col("L.fpr")) + F.col("L.tpr")))
    return cells.select(*keys, F.col("g").cast("int").alias("g"), xg.alias("fpr"), tpr.alias("tpr"))


def mean_roc(grid: DataFrame, aucs: DataFrame, keys) -> DataFrame:
    """C4: mean ROC over folds: ``(keys..., g, fpr, mean_tpr, std_tpr, lower, upper,
    mean_auc, std_auc)``; last mean tpr forced to 1, band clipped to [0, 1],
    ``mean_auc`` = trapezoid of the mean curve, ``std_auc`` population σ of fold AUCs."""
    keys = list(keys)
    m = grid.groupBy(*keys, "g", "fpr").agg(F.avg("tpr").alias("_m"), F.stddev_pop("tpr").alias("std_tpr"))
    m = m.withColumn("mean_tpr", F.when(F.col("g") == GRID - 1, F.lit(1.0)).otherwise(F.col("_m"))).drop("_m")
    w = Window.partitionBy(*keys).orderBy("g")
    seg = ((F.col("fpr") - F.lag("fpr").over(w)) * (F.col("mean_tpr") + F.lag("mean_tpr").over(w)) / 2)
    area = m.withColumn("_seg", seg).groupBy(*keys).agg(F.sum("_seg").alias("mean_auc"))
    sd = aucs.groupBy(*keys).agg(F.stddev_pop("roc_auc").alias("std_auc"))
    return (m.join(area, keys).join(sd, keys)
            .select(*keys, "g", "fpr", "mean_tpr", "std_tpr",
                    F.greatest(F.col("mean_tpr") - F.col("std_tpr"), F.lit(0.0)).alias("lower"),
                    F.least(F.col("mean_tpr") + F.col("std_tpr"), F.lit(1.0)).alias("upper"),
                    "mean_auc", "std_auc"))


# -- precision-recall (C5, C6, C7) -----------------------------------------------


def pr_points(pred: DataFrame, keys, y="y", score="score", cum: DataFrame | None = None) -> DataFrame:
    """``(keys..., threshold, recall, precision)`` per distinct score plus the
    end point (recall 0, precision 1, threshold NULL)."""
    keys = list(keys)
    cum = cum if cum is not None else curve_table(pred, keys, y, score)
    pts = cum.select(*keys, F.col("score").alias("threshold"),
                     F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("recall"),
                     (F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))).alias("precision"))
    end = cum.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("threshold"),
                                               F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return end.unionByName(pts)


def pr_summary(pred: DataFrame, keys, y="y", score="score", cum: DataFrame | None = None) -> DataFrame:
    """C5 + C6: ``(keys..., avg_precision, prc_auc, positive_share)``.

    AP = Σ (R_n - R_{n-1}) P_n; PR AUC = trapezoid over the PR points
    including the (0, 1) end point."""
    keys = list(keys)
    cum = cum if cum is not None else curve_table(pred, keys, y, score)
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    prec = tp / (tp + fp)
    ptp, pfp = tp - pos, fp - neg
    prev_prec = F.when(ptp + pfp == 0, F.lit(1.0)).otherwise(ptp / (ptp + pfp))
    return (cum.groupBy(*keys)
            .agg(F.sum(pos * prec).alias("_ap"), F.sum(pos * (prec + prev_prec) / 2).alias("_pa"),
                 F.first("P").alias("P"), F.first("N").alias("N"))
            .select(*keys, F.try_divide(F.col("_ap"), F.col("P")).alias("avg_precision"),
                    F.try_divide(F.col("_pa"), F.col("P")).alias("prc_auc"),
                    (F.col("P") / (F.col("P") + F.col("N"))).alias("positive_share")))


# -- thresholds (C8) --------------------------------------------------------------


def threshold_sweep(pred: DataFrame, keys, y="y", score="score") -> DataFrame:
    """f1 at thresholds ``i * 0.01`` (i = 0..100) with ``score >= t``:
    ``(keys..., i, threshold, tp, fp, fn, f1)``."""
    keys = list(keys)
    s = F.col(score)
    c0 = F.least(F.greatest(F.floor(s * 100).cast("int"), F.lit(0)), F.lit(GRID - 1))
    cell = (F.when((c0 + 1 <= GRID - 1) & (s >= grid_value(c0 + 1)), c0 + 1)
            .when(s >= grid_value(c0), c0).otherwise(c0 - 1))
    per = (pred.groupBy(*keys, cell.alias("i"))
           .agg(F.count(F.when(F.col(y) == 1, 1)).alias("_p"), F.count(F.when(F.col(y) == 0, 1)).alias("_n")))
    tot = per.groupBy(*keys).agg(F.sum("_p").alias("P"))
    grid = tot.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    cells = grid.join(per.filter(F.col("i") >= 0), [*keys, "i"], "left").fillna(0, ["_p", "_n"])
    suffix = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp = F.sum("_p").over(suffix)
    fp = F.sum("_n").over(suffix)
    out = cells.select(*keys, F.col("i").cast("int").alias("i"), grid_value(F.col("i")).alias("threshold"),
                       tp.alias("tp"), fp.alias("fp"), "P")
    out = out.withColumn("fn", F.col("P") - F.col("tp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return out.select(*keys, "i", "threshold", "tp", "fp", "fn", f1.alias("f1"))


def best_threshold(sweep: DataFrame, keys) -> DataFrame:
    """First threshold reaching the maximum f1: ``(keys..., threshold, f1)``."""
    keys = list(keys)
    best = sweep.groupBy(*keys).agg(F.min_by(F.struct("i", "threshold", "f1"),
                                             F.struct((-F.col("f1")).alias("nf"), F.col("i"))).alias("b"))
    return best.select(*keys, F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


# -- calibration (C9) --------------------------------------------------------------


def calibration_bin(score: str = "score") -> F.Column:
    """Bin index = number of inner edges ``j * 0.1`` (j = 1..9) strictly below the score."""
    s = F.col(score)
    b = F.lit(0)
    for j in range(1, CAL_BINS):
        b = b + (s > F.lit(j) * F.lit(0.1)).cast("int")
    return b


def calibration_curve(pred: DataFrame, keys, y="y", score="score") -> DataFrame:
    """``(keys..., bin, n, prob_pred, prob_true)``; empty bins omitted."""
    keys = list(keys)
    return (pred.groupBy(*keys, calibration_bin(score).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(score)).alias("prob_pred"),
                 F.avg(F.col(y).cast("double")).alias("prob_true")))
