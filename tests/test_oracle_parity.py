"""Spark queries against their DuckDB SQL oracles on the sf0.001 tables."""

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

FAST = ["order_cohort", "text_cohort", "feature_set_select", "drop_declared", "align_external", "drop_sparse_rows",
        "missing_fraction", "drop_sparse_cols", "single_unique", "correlation_matrix", "correlation_gram",
        "collinear_pairs", "fill_category", "binary_recode", "fill_zero", "impute_mean", "impute_median",
        "scale_standard", "scale_minmax", "impute_knn", "class_distribution", "endpoint_describe",
        "stratified_kfold", "stratified_shuffle", "holdout_split", "loo_folds", "nested_fold_plan", "split_sizes",
        "class_weights", "random_oversample", "balance_report", "smote", "adasyn_counts",
        "classification_metrics", "baseline_metrics", "roc_points", "roc_auc", "roc_grid", "mean_roc",
        "pr_points", "pr_auc", "avg_precision", "pooled_pr", "threshold_sweep", "best_threshold",
        "calibration_curve", "metric_summary", "cm_over_folds", "metric_boxplot",
        "cumulative_importance", "features_needed", "low_importance", "coef_report", "linear_attribution",
        "pooled_attribution", "attribution_summary", "profile_numeric", "profile_categorical", "profile_target",
        "profile_assoc", "profile_uncertainty", "profile_compare", "selector_union"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    q, sql = E.queries(), E.oracle_sql()
    assert name in q and name in sql
    sdf = q[name](spark, SF001)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.execute(sql[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, srows) == _rows(dcols, rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
