"""Literal edge cases of the metric, curve and filter operators."""

import numpy as np
import pytest

from riskfold.functions import curves as CV
from riskfold.functions import metrics as ME
from riskfold.operators import filters as FL
from riskfold.operators import transforms as TR


def _pred(spark, rows):
    return spark.createDataFrame(rows, "k string, y int, score double, pred int")


@pytest.mark.parametrize("scores,expected", [([0.1, 0.2, 0.8, 0.9], 1.0), ([0.9, 0.8, 0.2, 0.1], 0.0),
                                             ([0.5, 0.5, 0.5, 0.5], 0.5)])
def test_auc_perfect_reversed_constant(spark, scores, expected):
    ys = [0, 0, 1, 1]
    df = _pred(spark, [("a", y, s, 0) for y, s in zip(ys, scores)])
    assert CV.roc_auc(df, ["k"]).first()["roc_auc"] == pytest.approx(expected)


def test_no_predicted_positives(spark):
    m = ME.classification_metrics(_pred(spark, [("a", 0, 0.0, 0), ("a", 1, 0.0, 0)]), ["k"]).first()
    assert (m["precision"], m["f1_score"], m["mcc"], m["balanced_accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_one_class_present(spark):
    m = ME.classification_metrics(_pred(spark, [("a", 1, 0.0, 1), ("a", 1, 0.0, 0)]), ["k"]).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (0, 0, 1, 1)
    assert m["balanced_accuracy"] == 0.5


def test_calibration_bin_edges(spark):
    df = spark.createDataFrame([(p,) for p in (0.0, 0.1, 0.1000001, 1.0)], "score double")
    bins = [r[0] for r in df.select(CV.calibration_bin("score")).collect()]
    assert bins == [0, 0, 1, 9]


def test_sparse_row_rule():
    assert FL.min_non_null(10, 20) == 9


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, None, 1.0, 2.0), (1.0, None, 2.0, None), (1.0, None, 3.0, 7.0),
                                (1.0, None, None, 5.0)], "c double, n double, a double, b double")
    r = {(x["feature_i"], x["feature_j"]): x["corr"] for x in FL.correlation_pairs(df, ["c", "n", "a", "b"]).collect()}
    assert r[("c", "a")] is None and r[("n", "a")] is None
    # pairwise complete: rows 1 and 3 only
    assert r[("a", "b")] == pytest.approx(1.0)


def test_average_precision_and_auc_match_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 2)  # ties
    df = _pred(spark, [("a", int(a), float(b), 0) for a, b in zip(y, s)])
    got = CV.pr_summary(df, ["k"]).first()["avg_precision"]
    order = np.argsort(-s, kind="stable")
    ys, ss = y[order], s[order]
    ap, tp, fp, prev_r = 0.0, 0, 0, 0.0
    P = y.sum()
    for i in range(len(ss)):
        tp += ys[i]
        fp += 1 - ys[i]
        if i == len(ss) - 1 or ss[i + 1] != ss[i]:
            r = tp / P
            ap += (r - prev_r) * tp / (tp + fp)
            prev_r = r
    assert got == pytest.approx(ap)
    # AUC by pair counting (ties count one half)
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert CV.roc_auc(df, ["k"]).first()["roc_auc"] == pytest.approx(auc)


def test_binary_recode_cases(spark):
    df = spark.createDataFrame([("m", 1, "x", "a"), ("f", 2, "x", "b"), ("m", 2, "x", "c")],
                               "s string, i int, one string, three string")
    m = TR.fit_binary(df, ["s", "i"])
    out = df.select(*TR.binary_exprs(m)).collect()
    assert [(r["s"], r["i"]) for r in out] == [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0)]
    with pytest.warns(UserWarning):
        TR.fit_binary(df, ["one"])
    with pytest.raises(ValueError):
        TR.fit_binary(df, ["three"])


def test_empty_table(spark):
    df = _pred(spark, [])
    assert ME.classification_metrics(df, ["k"]).count() == 0
    assert CV.roc_auc(df, ["k"]).count() == 0
