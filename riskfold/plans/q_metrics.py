"""Registered queries: metrics, curves and their aggregation over folds
(C1-C9, C11, A3, A4, A8, S9) on the keyed score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold.functions import curves as CV
from riskfold.functions import metrics as ME
from riskfold.plans import report as RP
from riskfold.plans.fixtures import score_table
from riskfold.plans.oracle import SCORE_TABLE, with_
from riskfold.plans.registry import query

K = ["endpoint", "model", "fold"]
K2 = ["endpoint", "model"]
ST = with_(SCORE_TABLE)
KS = ", ".join(K)
K2S = ", ".join(K2)

_CM = """
cm AS (SELECT {keys}, count(CASE WHEN y = 0 AND pred = 0 THEN 1 END) AS tn,
              count(CASE WHEN y = 0 AND pred = 1 THEN 1 END) AS fp,
              count(CASE WHEN y = 1 AND pred = 0 THEN 1 END) AS fn,
              count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) AS tp FROM st GROUP BY {keys}),
cmd AS (SELECT *, CAST(tn AS DOUBLE) AS dtn, CAST(fp AS DOUBLE) AS dfp, CAST(fn AS DOUBLE) AS dfn,
               CAST(tp AS DOUBLE) AS dtp FROM cm),
mets AS (SELECT {keys}, tn, fp, fn, tp,
  CASE WHEN dtp + dfn > 0 AND dtn + dfp > 0 THEN (dtp / (dtp + dfn) + dtn / (dtn + dfp)) / 2
       WHEN dtp + dfn > 0 THEN dtp / (dtp + dfn) WHEN dtn + dfp > 0 THEN dtn / (dtn + dfp) END AS balanced_accuracy,
  coalesce(dtp / nullif(dtp + dfn, 0), 0.0) AS recall,
  coalesce(dtp / nullif(dtp + dfp, 0), 0.0) AS precision,
  CASE WHEN sqrt((dtp + dfp) * (dtp + dfn) * (dtn + dfp) * (dtn + dfn)) > 0
       THEN (dtp * dtn - dfp * dfn) / sqrt((dtp + dfp) * (dtp + dfn) * (dtn + dfp) * (dtn + dfn)) ELSE 0.0 END AS mcc,
  coalesce(2 * dtp / nullif(2 * dtp + dfp + dfn, 0), 0.0) AS f1_score FROM cmd)"""

_CUM = """
sc AS (SELECT {keys}, score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg
       FROM st GROUP BY {keys}, score),
cum AS (SELECT {keys}, score, pos, neg,
          sum(pos) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
          sum(neg) OVER (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
          sum(pos) OVER (PARTITION BY {keys}) AS P, sum(neg) OVER (PARTITION BY {keys}) AS N FROM sc)"""

_ROC_PTS = """
pts AS (SELECT {keys}, CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM cum GROUP BY {keys}
        UNION ALL
        SELECT {keys}, score AS threshold, CAST(fp AS DOUBLE) / N AS fpr, CAST(tp AS DOUBLE) / P AS tpr FROM cum)"""

_AUC = """
auc AS (SELECT {keys}, sum(CAST(neg AS DOUBLE) * (CAST(tp AS DOUBLE) - CAST(pos AS DOUBLE) / 2))
                       / (CAST(max(P) AS DOUBLE) * max(N)) AS roc_auc FROM cum GROUP BY {keys})"""

_PRS = """
prs AS (SELECT {keys},
          sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp))) / max(P) AS avg_precision,
          sum(CAST(pos AS DOUBLE) * (CAST(tp AS DOUBLE) / (tp + fp)
              + CASE WHEN (tp - pos) + (fp - neg) = 0 THEN 1.0
                     ELSE CAST(tp - pos AS DOUBLE) / ((tp - pos) + (fp - neg)) END) / 2) / max(P) AS prc_auc,
          CAST(max(P) AS DOUBLE) / (max(P) + max(N)) AS positive_share
        FROM cum GROUP BY {keys})"""

_GRID = """
g AS (SELECT CAST(range AS INTEGER) AS g,
             CASE WHEN range >= 100 THEN 1.0 ELSE CAST(range AS DOUBLE) * CAST(0.01 AS DOUBLE) END AS x
      FROM range(101)),
lr AS (SELECT k.*, g.g, g.x,
          (SELECT max(fpr) FROM pts p WHERE {match} AND p.fpr <= g.x) AS lf,
          (SELECT min(fpr) FROM pts p WHERE {match} AND p.fpr > g.x) AS rf
       FROM (SELECT DISTINCT {keys} FROM pts) k, g),
lr2 AS (SELECT k.*, (SELECT max(tpr) FROM pts p WHERE {match} AND p.fpr = k.lf) AS lt,
                    (SELECT min(tpr) FROM pts p WHERE {match} AND p.fpr = k.rf) AS rt FROM lr k),
grid AS (SELECT {keys}, g, x AS fpr,
           CASE WHEN lf IS NULL THEN 0.0 WHEN rf IS NULL THEN lt
                ELSE (rt - lt) / (rf - lf) * (x - lf) + lt END AS tpr FROM lr2)"""


def _fmt(s, keys):
    match = " AND ".join(f"p.{k} = k.{k}" for k in keys)
    return s.format(keys=", ".join(keys), match=match)


def _st(spark, sf):
    return score_table(spark, sf)


def _mean_roc(spark, sf):
    st = _st(spark, sf)
    cum = CV.curve_table(st, K)
    return CV.mean_roc(CV.roc_grid(st, K, cum=cum), CV.roc_auc(st, K, cum=cum), K2)


@query("classification_metrics", ST + "," + _fmt(_CM, K) + "\nSELECT * FROM mets",
       list(ME.METRICS), "C1")
def q_cls_metrics(spark, sf):
    return ME.classification_metrics(_st(spark, sf), K)


@query("baseline_metrics", ST + """,
b AS (SELECT endpoint, fold, count(CASE WHEN y = 0 THEN 1 END) AS tn0, count(CASE WHEN y = 1 THEN 1 END) AS tp0
      FROM st WHERE model = 'lines' GROUP BY endpoint, fold)
SELECT endpoint, fold, CAST(0 AS BIGINT) AS tn, tn0 AS fp, CAST(0 AS BIGINT) AS fn, tp0 AS tp,
  CASE WHEN tp0 > 0 AND tn0 > 0 THEN 0.5 WHEN tp0 > 0 THEN 1.0 ELSE 0.0 END AS balanced_accuracy,
  CASE WHEN tp0 > 0 THEN 1.0 ELSE 0.0 END AS recall,
  coalesce(CAST(tp0 AS DOUBLE) / nullif(tp0 + tn0, 0), 0.0) AS precision,
  0.0 AS mcc,
  coalesce(2.0 * tp0 / nullif(2.0 * tp0 + tn0, 0), 0.0) AS f1_score FROM b""",
       list(ME.METRICS), "M1 constant baseline")
def q_baseline(spark, sf):
    st = _st(spark, sf).filter(F.col("model") == "lines").select("endpoint", "fold", "y")
    pred = st.withColumn("pred", F.lit(1))
    return ME.classification_metrics(pred, ["endpoint", "fold"])


@query("roc_points", ST + "," + _fmt(_CUM, K) + "," + _fmt(_ROC_PTS, K) + "\nSELECT * FROM pts",
       ["threshold", "fpr", "tpr"], "C2")
def q_roc_points(spark, sf):
    return CV.roc_points(_st(spark, sf), K)


@query("roc_auc", ST + "," + _fmt(_CUM, K) + "," + _fmt(_AUC, K) + "\nSELECT * FROM auc", ["roc_auc"], "C2")
def q_roc_auc(spark, sf):
    return CV.roc_auc(_st(spark, sf), K)


_GRID_SQL = ST + "," + _fmt(_CUM, K) + "," + _fmt(_ROC_PTS, K) + "," + _fmt(_GRID, K)


@query("roc_grid", _GRID_SQL + "\nSELECT * FROM grid", ["fpr", "tpr"], "C3")
def q_roc_grid(spark, sf):
    return CV.roc_grid(_st(spark, sf), K)


_MEAN_ROC = _GRID_SQL + "," + _fmt(_AUC, K) + f""",
m AS (SELECT {K2S}, g, fpr, CASE WHEN g = 100 THEN 1.0 ELSE avg(tpr) END AS mean_tpr, stddev_pop(tpr) AS std_tpr
      FROM grid GROUP BY {K2S}, g, fpr),
area AS (SELECT {K2S}, sum(seg) AS mean_auc FROM (
   SELECT {K2S}, (fpr - lag(fpr) OVER w) * (mean_tpr + lag(mean_tpr) OVER w) / 2 AS seg
   FROM m WINDOW w AS (PARTITION BY {K2S} ORDER BY g)) GROUP BY {K2S}),
sd AS (SELECT {K2S}, stddev_pop(roc_auc) AS std_auc FROM auc GROUP BY {K2S}),
mr AS (SELECT m.{K[0]}, m.{K[1]}, g, fpr, mean_tpr, std_tpr, greatest(mean_tpr - std_tpr, 0.0) AS lower,
       least(mean_tpr + std_tpr, 1.0) AS upper, mean_auc, std_auc
       FROM m JOIN area USING ({K2S}) JOIN sd USING ({K2S}))"""


@query("mean_roc", _MEAN_ROC + "\nSELECT * FROM mr",
       ["fpr", "mean_tpr", "std_tpr", "lower", "upper", "mean_auc", "std_auc"], "C4")
def q_mean_roc(spark, sf):
    return _mean_roc(spark, sf)


@query("summary_curves", _MEAN_ROC + f"""
SELECT endpoint, model, g, fpr, mean_tpr, mean_auc,
       CASE model WHEN 'lines' THEN 'Line count' WHEN 'qty' THEN 'Quantity' ELSE model END AS label
FROM mr WHERE model <> 'dummy'""", ["fpr", "mean_tpr", "mean_auc"], "C11")
def q_summary_curves(spark, sf):
    return RP.summary_curves(_mean_roc(spark, sf), {"lines": "Line count", "qty": "Quantity"})


@query("pr_points", ST + "," + _fmt(_CUM, K) + f"""
SELECT {KS}, CAST(NULL AS DOUBLE) AS threshold, 0.0 AS recall, 1.0 AS precision FROM cum GROUP BY {KS}
UNION ALL
SELECT {KS}, score AS threshold, CAST(tp AS DOUBLE) / P AS recall, CAST(tp AS DOUBLE) / (tp + fp) AS precision
FROM cum""", ["threshold", "recall", "precision"], "C5")
def q_pr_points(spark, sf):
    return CV.pr_points(_st(spark, sf), K)


@query("pr_auc", ST + "," + _fmt(_CUM, K) + "," + _fmt(_PRS, K) + f"\nSELECT {KS}, prc_auc FROM prs",
       ["prc_auc"], "C5")
def q_pr_auc(spark, sf):
    return CV.pr_summary(_st(spark, sf), K).select(*K, "prc_auc")


@query("avg_precision", ST + "," + _fmt(_CUM, K) + "," + _fmt(_PRS, K) + f"\nSELECT {KS}, avg_precision FROM prs",
       ["avg_precision"], "C6")
def q_avg_precision(spark, sf):
    return CV.pr_summary(_st(spark, sf), K).select(*K, "avg_precision")


@query("pooled_pr", ST + "," + _fmt(_CUM, K2) + "," + _fmt(_PRS, K2) + "\nSELECT * FROM prs",
       ["avg_precision", "prc_auc", "positive_share"], "C7")
def q_pooled_pr(spark, sf):
    return CV.pr_summary(_st(spark, sf), K2)


_SWEEP = ST + f""",
t AS (SELECT CAST(range AS INTEGER) AS i,
             CASE WHEN range >= 100 THEN 1.0 ELSE CAST(range AS DOUBLE) * CAST(0.01 AS DOUBLE) END AS threshold
      FROM range(101)),
kk AS (SELECT {KS}, count(CASE WHEN y = 1 THEN 1 END) AS P FROM st GROUP BY {KS}),
c AS (SELECT kk.{K[0]}, kk.{K[1]}, kk.{K[2]}, t.i, t.threshold, kk.P,
        (SELECT count(*) FROM st WHERE st.endpoint = kk.endpoint AND st.model = kk.model AND st.fold = kk.fold
           AND st.y = 1 AND st.score >= t.threshold) AS tp,
        (SELECT count(*) FROM st WHERE st.endpoint = kk.endpoint AND st.model = kk.model AND st.fold = kk.fold
           AND st.y = 0 AND st.score >= t.threshold) AS fp FROM kk, t),
sw AS (SELECT {KS}, i, threshold, tp, fp, P - tp AS fn,
         coalesce(2.0 * tp / nullif(2.0 * tp + fp + (P - tp), 0), 0.0) AS f1 FROM c)"""


@query("threshold_sweep", _SWEEP + "\nSELECT * FROM sw", ["threshold", "f1"], "C8")
def q_threshold_sweep(spark, sf):
    return CV.threshold_sweep(_st(spark, sf), K)


@query("best_threshold", _SWEEP + f"""
SELECT {KS}, threshold, f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY {KS} ORDER BY f1 DESC, i) AS r FROM sw) WHERE r = 1""",
       ["threshold", "f1"], "C8")
def q_best_threshold(spark, sf):
    return CV.best_threshold(CV.threshold_sweep(_st(spark, sf), K), K)


_BIN = " + ".join(f"CASE WHEN score > CAST({j} AS DOUBLE) * CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END"
                  for j in range(1, 10))


@query("calibration_curve", ST + f"""
SELECT {KS}, {_BIN} AS bin, count(*) AS n, avg(score) AS prob_pred, avg(CAST(y AS DOUBLE)) AS prob_true
FROM st GROUP BY ALL""", ["prob_pred", "prob_true"], "C9")
def q_calibration(spark, sf):
    return CV.calibration_curve(_st(spark, sf), K)


# -- aggregation over folds -------------------------------------------------------------

_FOLD_METRICS = (ST + "," + _fmt(_CM, K) + "," + _fmt(_CUM, K) + "," + _fmt(_AUC, K) + "," + _fmt(_PRS, K) + f""",
fm AS (SELECT mets.*, auc.roc_auc, prs.avg_precision, prs.prc_auc FROM mets
       JOIN auc USING ({KS}) JOIN prs USING ({KS}))""")


def _fold_metrics(spark, sf):
    return RP.fold_metrics(_st(spark, sf), K)


def _summary_sql():
    cols = []
    for m in RP.SUMMARY_METRICS:
        cols += [f"avg({m}) AS {m}_mean", f"stddev_samp({m}) AS {m}_std", f"count({m}) AS {m}_count",
                 f"min({m}) AS {m}_min", f"max({m}) AS {m}_max"]
    return _FOLD_METRICS + f"\nSELECT {K2S}, " + ", ".join(cols) + f" FROM fm GROUP BY {K2S}"


@query("metric_summary", _summary_sql(),
       [f"{m}_{a}" for m in RP.SUMMARY_METRICS for a in ("mean", "std", "min", "max")], "A3")
def q_metric_summary(spark, sf):
    return RP.metric_summary(_fold_metrics(spark, sf), K2)


@query("cm_over_folds", ST + "," + _fmt(_CM, K) + f"""
SELECT {K2S}, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
       CAST(sum(tp) AS BIGINT) AS tp, avg(tn) AS tn_mean, avg(fp) AS fp_mean, avg(fn) AS fn_mean, avg(tp) AS tp_mean
FROM cm GROUP BY {K2S}""", ["tn_mean", "fp_mean", "fn_mean", "tp_mean"], "A4")
def q_cm_over_folds(spark, sf):
    return RP.cm_over_folds(ME.confusion_counts(_st(spark, sf), K), K2)


@query("metric_boxplot", _FOLD_METRICS + f""",
lng AS (UNPIVOT fm ON {", ".join(RP.SUMMARY_METRICS)} INTO NAME metric VALUE value),
q AS (SELECT {K2S}, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM lng GROUP BY ALL),
w AS (SELECT l.{K[0]}, l.{K[1]}, l.metric, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr, l.value FROM lng l
      JOIN q ON l.{K[0]} = q.{K[0]} AND l.{K[1]} = q.{K[1]} AND l.metric = q.metric)
SELECT {K2S}, metric, q1, median, q3, iqr,
       min(CASE WHEN value >= q1 - 1.5 * iqr THEN value END) AS whisker_low,
       max(CASE WHEN value <= q3 + 1.5 * iqr THEN value END) AS whisker_high,
       count(CASE WHEN value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr THEN 1 END) AS fliers
FROM w GROUP BY {K2S}, metric, q1, median, q3, iqr""",
       ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"], "A8")
def q_metric_boxplot(spark, sf):
    return RP.metric_boxplot(_fold_metrics(spark, sf), K2)


@query("metrics_json_map", None, [], "S9 metric → {model: fold values} map (JSON on write)")
def q_metrics_json_map(spark, sf):
    return RP.metrics_map(_fold_metrics(spark, sf))
