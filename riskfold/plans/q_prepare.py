"""Registered queries: sources, column selection, filters and transforms
(S1-S6, P1-P8, T1-T11, J1-J3, U1, U3, A1, A2, A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold.operators import columns as C
from riskfold.operators import filters as FL
from riskfold.operators import transforms as TR
from riskfold.operators.knn import knn_impute
from riskfold.plans.oracle import ORDER_COHORT, TEXT_COHORT, with_
from riskfold.plans.registry import query
from riskfold.sources.cohorts import ORDER_CATALOG, order_cohort, order_split, text_cohort

OC = with_(ORDER_COHORT)
NUMS = ["total", "acctbal", "lines", "qty", "price", "disc", "constant", "total_x2"]
PREP_NUMS = ["total", "acctbal", "lines", "qty", "price"]
KNN_NUMS = ["total", "acctbal", "lines", "qty", "price", "constant", "total_x2"]
FEATS = ORDER_CATALOG.all_features()
ALL_COLS = FEATS + ORDER_CATALOG.all_endpoints()
# The categorical levels of the order cohort (after the "0" fill).
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["0", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _q(name):
    return '"' + name + '"'


# -- sources ---------------------------------------------------------------------

@query("order_cohort", OC + "\nSELECT * FROM oc", NUMS, "S3 cohort builder")
def q_order_cohort(spark, sf):
    return order_cohort(spark, sf)


@query("text_cohort", with_(TEXT_COHORT) + "\nSELECT * FROM tc", ["n_chars"], "S3 cohort builder")
def q_text_cohort(spark, sf):
    return text_cohort(spark, sf)


# -- P1-P4 ------------------------------------------------------------------------

@query("feature_set_select",
       OC + "\nSELECT row_id, total, acctbal, constant, total_x2, segment, half, yr, returned, pending FROM oc",
       ["total", "acctbal", "constant", "total_x2"], "P1")
def q_feature_set(spark, sf):
    df, *_ = C.select_columns(order_cohort(spark, sf), ORDER_CATALOG, feature_set=("pre",), drop_declared=False)
    return df


@query("drop_declared", OC + "\nSELECT * EXCLUDE (yr) FROM oc", NUMS, "P2")
def q_drop_declared(spark, sf):
    df, *_ = C.select_columns(order_cohort(spark, sf), ORDER_CATALOG)
    return df


@query("align_external",
       OC + """
SELECT * EXCLUDE (disc, yr), 'train' AS cohort FROM oc WHERE yr < 2000
UNION ALL
SELECT * EXCLUDE (disc, yr), 'external' AS cohort FROM oc WHERE yr >= 2000""",
       [c for c in NUMS if c != "disc"], "P3 + U1")
def q_align_external(spark, sf):
    """External site without ``disc``: training columns are aligned to it."""
    train, ext = order_split(order_cohort(spark, sf))
    train, _, _, _ = C.select_columns(train, ORDER_CATALOG)
    ext = ext.drop("disc", "yr")
    a, b = C.align_external(train, ext)
    return C.union_cohorts(a, b, tags=["train", "external"])


# -- P5 ----------------------------------------------------------------------------

_NN = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in ALL_COLS)


@query("drop_sparse_rows", OC + f"\nSELECT * FROM oc WHERE ({_NN}) >= {FL.min_non_null(len(ALL_COLS), 20)}",
       NUMS, "P5")
def q_drop_sparse_rows(spark, sf):
    return FL.drop_sparse_rows(order_cohort(spark, sf), 20)


# -- P6 / P7 / A2 ------------------------------------------------------------------

def _stats_sql():
    parts = []
    for i, c in enumerate(FEATS):
        parts.append(f"SELECT {i} AS ordinal, '{c}' AS feature, "
                     f"CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS missing_fraction, "
                     f"count({c}) AS non_null, coalesce(min({c}) = max({c}), false) AS single_value FROM oc")
    return "\nUNION ALL\n".join(parts)


@query("missing_fraction", OC + "\n" + _stats_sql(), ["missing_fraction"], "P6/P7/A2")
def q_missing_fraction(spark, sf):
    return FL.column_stats(order_cohort(spark, sf), FEATS)


@query("drop_sparse_cols", OC + ", s AS (\n" + _stats_sql() + ")\n"
       "SELECT ordinal, feature, missing_fraction FROM s WHERE missing_fraction > 0.5",
       ["missing_fraction"], "P6")
def q_drop_sparse_cols(spark, sf):
    return FL.sparse_columns(FL.column_stats(order_cohort(spark, sf), FEATS), 0.5)


@query("single_unique", OC + ", s AS (\n" + _stats_sql() + ")\n"
       "SELECT ordinal, feature, non_null FROM s WHERE single_value", [], "P7")
def q_single_unique(spark, sf):
    return FL.single_value_columns(FL.column_stats(order_cohort(spark, sf), FEATS))


# -- A5 / P8 -----------------------------------------------------------------------

def _corr_sql(cols, table="oc"):
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            x, y = cols[i], cols[j]
            parts.append(
                f"SELECT {i} AS i, {j} AS j, '{x}' AS feature_i, '{y}' AS feature_j, "
                f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) AS n, "
                f"covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * "
                f"stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0) AS corr FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("correlation_matrix", OC + "\n" + _corr_sql(NUMS), ["corr"], "A5")
def q_correlation_matrix(spark, sf):
    return FL.correlation_pairs(order_cohort(spark, sf), NUMS)


@query("correlation_gram", OC + "\n" + _corr_sql(PREP_NUMS), ["corr"], "A5 (features of the preparation)")
def q_correlation_gram(spark, sf):
    return FL.correlation_pairs(order_cohort(spark, sf), PREP_NUMS)


@query("collinear_pairs", OC + ", c AS (\n" + _corr_sql(NUMS) + ")\n"
       "SELECT j AS ordinal, feature_j AS drop_feature, feature_i AS corr_feature, corr AS corr_value "
       "FROM c WHERE abs(corr) > 0.95", ["corr_value"], "P8")
def q_collinear_pairs(spark, sf):
    return FL.collinear_pairs(FL.correlation_pairs(order_cohort(spark, sf), NUMS), 0.95)


@query("drop_correlated", OC + "\nSELECT * EXCLUDE (total_x2) FROM oc",
       [c for c in NUMS if c != "total_x2"], "P8")
def q_drop_correlated(spark, sf):
    df, _dropped = FL.drop_correlated(order_cohort(spark, sf), 0.95, NUMS)
    return df


# -- T1-T4 --------------------------------------------------------------------------

@query("fill_category", OC + "\nSELECT row_id, coalesce(segment, '0') AS segment, "
       "coalesce(priority, '0') AS priority FROM oc", [], "T1")
def q_fill_category(spark, sf):
    return TR.fill_category(order_cohort(spark, sf).select("row_id", "segment", "priority"),
                            ["segment", "priority"])


def _dummies_sql():
    out = []
    for c, levels in (("segment", SEGMENTS), ("priority", PRIORITIES)):
        for lv in levels:
            out.append(f"CASE WHEN coalesce({c}, '0') = '{lv}' THEN 1.0 ELSE 0.0 END AS {_q(c + '_' + lv)}")
    return out


DUMMIES = [f"segment_{v}" for v in SEGMENTS] + [f"priority_{v}" for v in PRIORITIES]


@query("one_hot", OC + "\nSELECT row_id, " + ", ".join(_dummies_sql()) + " FROM oc", DUMMIES, "T2")
def q_one_hot(spark, sf):
    oc = order_cohort(spark, sf).select("row_id", "segment", "priority")
    vocab = TR.fit_vocabulary(oc, ["segment", "priority"])
    return TR.one_hot(oc, vocab)


@query("binary_recode", OC + "\nSELECT row_id, CASE WHEN half = 'H1' THEN 0.0 WHEN half = 'H2' THEN 1.0 "
       "ELSE 0.0 END AS half, CAST(returned AS DOUBLE) AS returned FROM oc", ["half", "returned"], "T3")
def q_binary_recode(spark, sf):
    oc = order_cohort(spark, sf)
    m = TR.fit_binary(oc, ["half", "returned"])
    return oc.select("row_id", *TR.binary_exprs(m))


@query("fill_zero", OC + "\nSELECT row_id, coalesce(lines, 0) AS lines, coalesce(qty, 0) AS qty, "
       "coalesce(price, 0) AS price FROM oc", ["lines", "qty", "price"], "T4")
def q_fill_zero(spark, sf):
    return TR.fill_zero(order_cohort(spark, sf).select("row_id", "lines", "qty", "price"),
                        ["lines", "qty", "price"])


# -- T5 / T8 / T9 ---------------------------------------------------------------------

@query("impute_mean", OC + "\nSELECT row_id, " + ", ".join(
    f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in NUMS) + " FROM oc", NUMS, "T5 mean")
def q_impute_mean(spark, sf):
    oc = order_cohort(spark, sf).select("row_id", *NUMS)
    return TR.apply_columns(oc, TR.impute_exprs(TR.fit_impute(oc, NUMS, "mean")))


@query("impute_median", OC + "\nSELECT row_id, " + ", ".join(
    f"coalesce({c}, quantile_cont({c}, 0.5) OVER ()) AS {c}" for c in NUMS) + " FROM oc", NUMS, "T5 median")
def q_impute_median(spark, sf):
    oc = order_cohort(spark, sf).select("row_id", *NUMS)
    return TR.apply_columns(oc, TR.impute_exprs(TR.fit_impute(oc, NUMS, "median")))


_MEANFILL = OC + ", m AS (SELECT row_id, " + ", ".join(
    f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in NUMS) + " FROM oc)"


@query("scale_standard", _MEANFILL + "\nSELECT row_id, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in NUMS)
       + " FROM m", NUMS, "T8")
def q_scale_standard(spark, sf):
    oc = order_cohort(spark, sf).select("row_id", *NUMS)
    filled = TR.apply_columns(oc, TR.impute_exprs(TR.fit_impute(oc, NUMS, "mean")))
    return TR.apply_columns(filled, TR.scale_exprs(TR.fit_scale(filled, NUMS, "standard")))


@query("scale_minmax", _MEANFILL + "\nSELECT row_id, " + ", ".join(
    f"({c} - min({c}) OVER ()) / coalesce(nullif(max({c}) OVER () - min({c}) OVER (), 0), 1) AS {c}"
    for c in NUMS) + " FROM m", NUMS, "T9")
def q_scale_minmax(spark, sf):
    oc = order_cohort(spark, sf).select("row_id", *NUMS)
    filled = TR.apply_columns(oc, TR.impute_exprs(TR.fit_impute(oc, NUMS, "mean")))
    return TR.apply_columns(filled, TR.scale_exprs(TR.fit_scale(filled, NUMS, "minmax")))


# -- T6 kNN ------------------------------------------------------------------------------

def _knn_sql(cols, k=5):
    d = len(cols)
    ss = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND x.{c} IS NOT NULL THEN (q.{c} - x.{c}) * (q.{c} - x.{c}) "
                    f"ELSE 0 END" for c in cols)
    m = " + ".join(f"CASE WHEN q.{c} IS NOT NULL AND x.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in cols)
    anynull = " OR ".join(f"{c} IS NULL" for c in cols)
    cands = "\nUNION ALL\n".join(
        f"SELECT qid, {i} AS c, dist, did, v{i} AS v FROM pairs WHERE q_null{i} AND v{i} IS NOT NULL"
        for i in range(d))
    vsel = ", ".join(f"x.{c} AS v{i}, q.{c} IS NULL AS q_null{i}" for i, c in enumerate(cols))
    fills = ", ".join(
        f"coalesce(b.{c}, (SELECT avg(v) FROM top WHERE top.qid = b.row_id AND top.c = {i}), "
        f"(SELECT avg({c}) FROM b0)) AS {c}" for i, c in enumerate(cols))
    return (OC + f""",
b0 AS (SELECT row_id, {', '.join(cols)} FROM oc),
qs AS (SELECT * FROM b0 WHERE {anynull}),
pairs AS (
  SELECT q.row_id AS qid, x.row_id AS did, {vsel},
         CASE WHEN ({m}) = 0 THEN NULL ELSE sqrt(({ss}) * {d} / ({m})) END AS dist
  FROM qs q, b0 x),
cand AS ({cands}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, c ORDER BY dist, did) AS rk
           FROM cand WHERE dist IS NOT NULL),
top AS (SELECT qid, c, v FROM ranked WHERE rk <= {k})
SELECT b.row_id, {fills} FROM b0 b""")


@query("impute_knn", _knn_sql(KNN_NUMS), KNN_NUMS, "T6 kNN imputation (whole cohort; brute force in SQL)")
def q_impute_knn(spark, sf):
    oc = order_cohort(spark, sf).select("row_id", *KNN_NUMS)
    return knn_impute(oc, KNN_NUMS, k=5)


# -- T11 -----------------------------------------------------------------------------------

_PREP_NUMS = PREP_NUMS


def _prepare_sql():
    dummies = ", ".join(_dummies_sql())
    fill = ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in _PREP_NUMS)
    scale = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}"
                      for c in _PREP_NUMS)
    return OC + f""",
e AS (SELECT row_id, CASE WHEN half = 'H1' THEN 0.0 WHEN half = 'H2' THEN 1.0 ELSE 0.0 END AS half,
             {dummies}, {fill}, returned, pending FROM oc)
SELECT row_id, half, {', '.join(_q(d) for d in DUMMIES)}, {scale}, returned, pending FROM e"""


@query("prepare_full", _prepare_sql(), ["half"] + DUMMIES + _PREP_NUMS, "T11 (P2, P6-P8, T1-T5, T8)")
def q_prepare_full(spark, sf):
    oc = order_cohort(spark, sf)
    cfg = TR.PrepConfig(imputer="mean", normaliser="standard", missing_threshold=0.5,
                        drop_single_unique=True, correlation_threshold=0.95)
    prep = TR.prepare(oc, ORDER_CATALOG, cfg)
    return prep.transform(oc)


_SPARSE_PCT = 10.0


def _prepare_sparse_sql():
    """P5 first: rows with fewer present cells than int((100 - pct) / 100 * columns + 1) go, then the fit."""
    present = " + ".join(f"CAST({_q(c)} IS NOT NULL AS INTEGER)" for c in ALL_COLS)
    need = int((100 - _SPARSE_PCT) / 100 * len(ALL_COLS) + 1)
    return _prepare_sql().replace("FROM oc)\nSELECT", f"FROM oc WHERE {present} >= {need})\nSELECT")


@query("prepare_sparse", _prepare_sparse_sql(), ["half"] + DUMMIES + _PREP_NUMS, "T11 with P5 (rows and columns)")
def q_prepare_sparse(spark, sf):
    oc = order_cohort(spark, sf)
    cfg = TR.PrepConfig(imputer="mean", normaliser="standard", drop_missing_value=_SPARSE_PCT, missing_threshold=0.5,
                        drop_single_unique=True, correlation_threshold=0.95)
    return TR.prepare(oc, ORDER_CATALOG, cfg).transform(oc)


# -- J1 / J3 / A1 -------------------------------------------------------------------------

@query("outer_join_blocks", OC + "\nSELECT row_id, half, total, acctbal FROM oc", ["total", "acctbal"], "J1")
def q_outer_join_blocks(spark, sf):
    oc = order_cohort(spark, sf)
    binary = oc.select("row_id", "half")
    numeric = oc.select("row_id", "total", "acctbal")
    return binary.join(numeric, "row_id", "full")


@query("class_distribution", OC + """
SELECT endpoint, y, n, n / sum(n) OVER (PARTITION BY endpoint) AS share FROM (
  SELECT 'returned' AS endpoint, returned AS y, count(*) AS n FROM oc GROUP BY returned
  UNION ALL
  SELECT 'pending' AS endpoint, pending AS y, count(*) AS n FROM oc GROUP BY pending)""", ["share"], "A1")
def q_class_distribution(spark, sf):
    from riskfold.operators.stats import class_distribution
    return class_distribution(order_cohort(spark, sf), ["returned", "pending"])


def _describe_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
                     f"min({c}) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
                     f"quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM oc")
    return "\nUNION ALL\n".join(parts)


@query("endpoint_describe", OC + "\n" + _describe_sql(["lines", "qty", "price"]),
       ["mean", "std", "min", "q25", "q50", "q75", "max"], "A1 numeric describe")
def q_describe(spark, sf):
    from riskfold.operators.stats import describe
    return describe(order_cohort(spark, sf), ["lines", "qty", "price"])

