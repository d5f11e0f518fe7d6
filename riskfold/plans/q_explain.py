"""Registered queries: importance tables and windows (W1, W2, P10, P16, K3),
attributions (X1-X4, A7) and profiles (A9, A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold.functions.exprs import col
from riskfold.operators import filters as FL
from riskfold.operators import stats as STS
from riskfold.operators.split import stratified_kfold
from riskfold.plans import explain as EX
from riskfold.plans import models as MO
from riskfold.plans.oracle import ORDER_COHORT, with_
from riskfold.plans.q_prepare import _corr_sql
from riskfold.plans.registry import query
from riskfold.session import scratch_path
from riskfold.sources.cohorts import order_cohort, order_split

OC = with_(ORDER_COHORT)
NUMS = ["total", "acctbal", "lines", "qty", "price", "disc", "constant", "total_x2"]
F5 = ["total", "acctbal", "lines", "qty", "price"]


# -- importance table: |Pearson r| with the endpoint, rounded so exact ties stay ties

def _importance(spark, sf):
    oc = order_cohort(spark, sf)
    y = F.col("returned").cast("double")
    recs = [F.struct(F.lit(c).alias("feature"),
                     F.coalesce(F.round(F.abs(FL._pair_corr(col(c).cast("double"), y)), 10), F.lit(0.0))
                     .alias("importance")) for c in NUMS]
    return oc.agg(F.array(*recs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


_IMP_SQL = OC + ",\nimp AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, coalesce(round(abs(covar_pop({c}, returned) / nullif(stddev_pop(CASE WHEN returned "
    f"IS NOT NULL THEN {c} END) * stddev_pop(CASE WHEN {c} IS NOT NULL THEN returned END), 0)), 10), 0.0) "
    f"AS importance FROM oc" for c in NUMS) + """),
cum AS (SELECT feature, importance, coalesce(importance / nullif(sum(importance) OVER (), 0), 0.0) AS normalized_importance,
        CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM imp),
cum2 AS (SELECT *, sum(normalized_importance) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cumulative_importance
         FROM cum)"""


@query("cumulative_importance", _IMP_SQL + "\nSELECT * FROM cum2",
       ["importance", "normalized_importance", "cumulative_importance"], "W1 / K1")
def q_cumulative(spark, sf):
    return FL.cumulative_importance(_importance(spark, sf))


@query("features_needed", _IMP_SQL + "\nSELECT CAST(min(rank) AS INTEGER) AS features_needed FROM cum2 "
       "WHERE cumulative_importance > 0.9", [], "W2")
def q_features_needed(spark, sf):
    return FL.features_needed(FL.cumulative_importance(_importance(spark, sf)), 0.9)


@query("low_importance", _IMP_SQL + "\nSELECT * FROM cum2 WHERE cumulative_importance > 0.9",
       ["importance", "normalized_importance", "cumulative_importance"], "P10")
def q_low_importance(spark, sf):
    return FL.low_importance(FL.cumulative_importance(_importance(spark, sf)), 0.9)


@query("selector_union", _IMP_SQL + """,
stats AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS mf, "
    f"coalesce(min({c}) = max({c}), false) AS single FROM oc" for c in NUMS) + """),
co AS (""" + _corr_sql(NUMS) + """),
rem AS (SELECT 'missing' AS method, feature FROM stats WHERE mf > 0.5
        UNION ALL SELECT 'single_unique', feature FROM stats WHERE single
        UNION ALL SELECT DISTINCT 'collinear', feature_j FROM co WHERE abs(corr) > 0.95
        UNION ALL SELECT 'zero_importance', feature FROM cum2 WHERE importance = 0.0
        UNION ALL SELECT 'low_importance', feature FROM cum2 WHERE cumulative_importance > 0.9)
SELECT DISTINCT feature FROM rem""", [], "P11 union of removal sets")
def q_selector_union(spark, sf):
    cum = FL.cumulative_importance(_importance(spark, sf))
    return FL.features_to_remove(FL.identify_all(order_cohort(spark, sf), NUMS, cum, 0.5, 0.95, 0.9), "all")


# -- coefficients: univariate slopes of the endpoint on each mean-filled column ------

_FILL5 = ", ".join(f"coalesce({c}, avg({c}) OVER ()) AS {c}" for c in F5)
_COEF_SQL = OC + f""",
m AS (SELECT row_id, returned, {_FILL5} FROM oc),
co AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, covar_pop({c}, returned) / stddev_pop({c}) AS coef FROM m" for c in F5) + ")"


def _filled5(spark, sf):
    oc = order_cohort(spark, sf).select("row_id", "returned", *F5)
    means = oc.agg(*[F.avg(c).alias(c) for c in F5]).first().asDict()
    return oc.select("row_id", "returned", *[F.coalesce(col(c), F.lit(means[c])).alias(c) for c in F5]), means


def _coefs(spark, sf):
    m, _ = _filled5(spark, sf)
    y = F.col("returned").cast("double")
    recs = [F.struct(F.lit(c).alias("feature"), (F.covar_pop(col(c), y) / F.stddev_pop(col(c))).alias("coef"))
            for c in F5]
    return m.agg(F.array(*recs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query("coef_report", _COEF_SQL + """
SELECT feature, coef, CAST(row_number() OVER (ORDER BY abs(coef) DESC, feature) AS INTEGER) AS rank FROM co
WHERE abs(coef) > 0.001 QUALIFY rank <= 3""", ["coef"], "P16 coefficient filter, top-n by |coef|")
def q_coef_report(spark, sf):
    from pyspark.sql import Window
    co = _coefs(spark, sf).filter(F.abs("coef") > 1e-3)
    w = Window.orderBy(F.abs("coef").desc(), F.col("feature"))  # one row per feature: schema-sized
    return co.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 3)


_SLOPE_SQL = OC + f""",
m AS (SELECT row_id, returned, {_FILL5} FROM oc),
st AS (SELECT """ + ", ".join(
    f"covar_pop({c}, returned) / var_pop({c}) AS c_{c}, avg({c}) AS m_{c}" for c in F5) + """ FROM m),
la AS (""" + "\nUNION ALL\n".join(
    f"SELECT m.row_id, '{c}' AS feature, m.{c} AS value, st.c_{c} * (m.{c} - st.m_{c}) AS phi FROM m, st"
    for c in F5) + ")"


@query("linear_attribution", _SLOPE_SQL + "\nSELECT * FROM la", ["value", "phi"], "X1")
def q_linear_attribution(spark, sf):
    m, _ = _filled5(spark, sf)
    y = F.col("returned").cast("double")
    row = m.agg(*[(F.covar_pop(col(c), y) / F.var_pop(col(c))).alias(f"c_{c}") for c in F5],
                *[F.avg(col(c)).alias(f"m_{c}") for c in F5]).first()
    return EX.linear_attribution(m, {c: row[f"c_{c}"] for c in F5}, {c: row[f"m_{c}"] for c in F5})


_POOLED_SQL = OC + f""",
m AS (SELECT row_id, returned, {_FILL5} FROM oc),
fo AS (SELECT m.*, CAST((row_number() OVER (PARTITION BY returned ORDER BY
          md5(concat_ws('|', CAST(row_id AS VARCHAR), '42'))) - 1) % 5 AS INTEGER) AS fold FROM m),
folds AS (SELECT DISTINCT fold FROM fo),
st AS (SELECT f.fold, """ + ", ".join(
    f"covar_pop(d.{c}, d.returned) / var_pop(d.{c}) AS c_{c}, avg(d.{c}) AS m_{c}" for c in F5) + """
       FROM folds f JOIN fo d ON d.fold <> f.fold GROUP BY f.fold),
pa AS (""" + "\nUNION ALL\n".join(
    f"SELECT fo.fold, fo.row_id, '{c}' AS feature, fo.{c} AS value, st.c_{c} * (fo.{c} - st.m_{c}) AS phi "
    f"FROM fo JOIN st ON fo.fold = st.fold" for c in F5) + ")"


def _pooled(spark, sf):
    m, _ = _filled5(spark, sf)
    folds = stratified_kfold(m, "returned", 5, 42).select("row_id", "fold")
    d = m.join(folds, "row_id")
    y = F.col("returned").cast("double")
    # Per-fold sums; the training statistics of fold f are total minus fold f.
    sums = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy")]
    for c in F5:
        x = col(c)
        sums += [F.sum(x).alias(f"sx_{c}"), F.sum(x * x).alias(f"sxx_{c}"), F.sum(x * y).alias(f"sxy_{c}")]
    per = d.groupBy("fold").agg(*sums)
    from pyspark.sql import Window
    tot = Window.partitionBy()  # at most k rows (one per fold)
    names = ["n", "sy"] + [f"{p}_{c}" for c in F5 for p in ("sx", "sxx", "sxy")]
    comp = per.select("fold", *[(F.sum(n).over(tot) - F.col(n)).alias(n) for n in names])
    exprs = []
    for c in F5:
        n = F.col("n").cast("double")
        mx, my = F.col(f"sx_{c}") / n, F.col("sy") / n
        cov = F.col(f"sxy_{c}") / n - mx * my
        var = F.col(f"sxx_{c}") / n - mx * mx
        exprs += [(cov / var).alias(f"c_{c}"), mx.alias(f"m_{c}")]
    st = comp.select("fold", *exprs)
    j = d.join(F.broadcast(st), "fold")  # st: one row per fold
    recs = [F.struct(F.lit(c).alias("feature"), col(c).alias("value"),
                     (F.col(f"c_{c}") * (col(c) - F.col(f"m_{c}"))).alias("phi")) for c in F5]
    return j.select("fold", "row_id", F.explode(F.array(*recs)).alias("r")).select(
        "fold", "row_id", "r.feature", "r.value", "r.phi")


@query("pooled_attribution", _POOLED_SQL + "\nSELECT * FROM pa", ["value", "phi"], "X4 pooled over folds")
def q_pooled_attribution(spark, sf):
    return _pooled(spark, sf)


@query("attribution_summary", _POOLED_SQL + """
SELECT feature, avg(abs(phi)) AS mean_abs_phi,
       CAST(row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS INTEGER) AS rank FROM pa GROUP BY feature QUALIFY rank <= 40""",
       ["mean_abs_phi"], "A7 mean |attribution|, top 40")
def q_attribution_summary(spark, sf):
    return EX.attribution_summary(_pooled(spark, sf), top=40)


@query("top_features", _POOLED_SQL + """
SELECT feature, avg(abs(phi)) AS mean_abs_phi,
       CAST(row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS INTEGER) AS rank FROM pa GROUP BY feature QUALIFY rank <= 3""",
       ["mean_abs_phi"], "K3 top-n report")
def q_top_features(spark, sf):
    return EX.attribution_summary(_pooled(spark, sf), top=3)


# -- model-based attributions (rows-only + property tests) -------------------------------

def _forest_parts(spark, sf, n_trees=100, depth=5):
    from riskfold.plans.q_models import _split
    train, test, feats = _split(spark, sf)
    fitted = MO.fit(MO.ModelSpec.of("forest", n_estimators=n_trees, max_depth=depth),
                    MO.assemble(train, feats), len(feats))
    return train, test, feats, fitted, MO.tree_nodes(spark, fitted, scratch_path(spark, "forest"))


@query("tree_attribution", None, [], "X2 path-dependent TreeSHAP")
def q_tree_attribution(spark, sf):
    _train, test, feats, _fitted, nodes = _forest_parts(spark, sf)
    return EX.tree_shap(test, feats, nodes)


@query("background_attribution", None, [], "X2 against background rows: margins of a boosted model, all training rows as background")
def q_background_attribution(spark, sf):
    from riskfold.plans.q_models import _split
    train, test, feats = _split(spark, sf)
    fitted = MO.fit(MO.ModelSpec.of("gbt"), MO.assemble(train, feats), len(feats))
    nodes = MO.tree_nodes(spark, fitted, scratch_path(spark, "boosted"))
    return EX.background_shap(test, train, feats, nodes, fitted.model.treeWeights)


@query("kernel_shapley", None, [], "X3 kernel explainer of a linear SVM's decision value")
def q_kernel_shapley(spark, sf):
    from riskfold.plans.q_models import _split
    train, test, feats = _split(spark, sf)
    fitted = MO.fit(MO.ModelSpec.of("svm"), MO.assemble(train, feats), len(feats))
    return EX.kernel_shapley(test, train, feats, lambda d: fitted.score(MO.assemble(d, feats)))


@query("permutation_shapley", None, [], "X3 sampled-permutation Shapley values")
def q_permutation_shapley(spark, sf):
    from riskfold.plans.q_models import _split
    train, test, feats = _split(spark, sf)
    fitted = MO.fit(MO.ModelSpec.of("logistic"), MO.assemble(train, feats), len(feats))
    return EX.permutation_shapley(test, train, feats, lambda d: fitted.score(MO.assemble(d, feats)))


# -- A9 / A10 profiles ----------------------------------------------------------------------

PNUMS = ["total", "acctbal", "lines", "qty", "price", "constant"]


def _profile_sql(table, cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature, count({c}) AS count, count(*) - count({c}) AS missing,
  count(DISTINCT {c}) AS distinct, count(CASE WHEN {c} = 0 THEN 1 END) AS zeros, avg({c}) AS mean,
  stddev_samp({c}) AS std, var_samp({c}) AS variance, sum({c}) AS sum, min({c}) AS min, max({c}) AS max,
  quantile_cont({c}, 0.05) AS q05, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
  quantile_cont({c}, 0.75) AS q75, quantile_cont({c}, 0.95) AS q95, max({c}) - min({c}) AS range,
  quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr,
  CASE WHEN avg(power({c} - mu.m_{c}, 2)) = 0 THEN NULL
       ELSE avg(power({c} - mu.m_{c}, 3)) / power(avg(power({c} - mu.m_{c}, 2)), 1.5) END AS skewness,
  CASE WHEN avg(power({c} - mu.m_{c}, 2)) = 0 THEN NULL
       ELSE avg(power({c} - mu.m_{c}, 4)) / power(avg(power({c} - mu.m_{c}, 2)), 2) - 3 END AS kurtosis
FROM {table}, (SELECT avg({c}) AS m_{c} FROM {table}) mu""")
    return "\nUNION ALL\n".join(parts)


_PROFILE_DOUBLES = ["mean", "std", "variance", "sum", "min", "max", "q05", "q25", "q50", "q75", "q95", "range", "iqr",
                    "skewness", "kurtosis"]


@query("profile_numeric", OC + "\n" + _profile_sql("oc", PNUMS), _PROFILE_DOUBLES, "A9 numeric profile")
def q_profile_numeric(spark, sf):
    return STS.profile_numeric(order_cohort(spark, sf), PNUMS)


@query("profile_categorical", OC + """,
l AS (SELECT 'segment' AS feature, segment AS value, returned FROM oc
      UNION ALL SELECT 'priority', priority, returned FROM oc
      UNION ALL SELECT 'half', half, returned FROM oc),
g AS (SELECT feature, value, count(*) AS n, avg(CAST(returned AS DOUBLE)) AS target_rate FROM l GROUP BY ALL)
SELECT feature, value, n, target_rate, n / sum(n) OVER (PARTITION BY feature) AS share,
       CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC NULLS FIRST) AS INTEGER) AS rank
FROM g""", ["target_rate", "share"], "A9 categorical profile with target rate")
def q_profile_categorical(spark, sf):
    return STS.profile_categorical(order_cohort(spark, sf), ["segment", "priority", "half"], target="returned")


@query("profile_target", OC + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg(CASE WHEN returned = 0 THEN {c} END) AS mean_y0, "
    f"avg(CASE WHEN returned = 1 THEN {c} END) AS mean_y1, covar_pop({c}, returned) / nullif("
    f"stddev_pop(CASE WHEN returned IS NOT NULL THEN {c} END) * stddev_pop(CASE WHEN {c} IS NOT NULL THEN returned END)"
    f", 0) AS pearson FROM oc" for c in PNUMS), ["mean_y0", "mean_y1", "pearson"], "A9 numeric vs target")
def q_profile_target(spark, sf):
    return STS.profile_target(order_cohort(spark, sf), PNUMS, "returned")


def _eta_sql(cat, num):
    return f"""SELECT '{cat}' AS categorical, '{num}' AS numeric, sqrt(greatest(0.0,
  (sum(sx * sx / nk) - sum(sx) * sum(sx) / sum(nk)) / nullif(sum(sxx) - sum(sx) * sum(sx) / sum(nk), 0))) AS eta
FROM (SELECT coalesce(CAST({cat} AS VARCHAR), 'NULL') AS k, count(*) AS nk, sum({num}) AS sx, sum({num} * {num}) AS sxx
      FROM oc WHERE {num} IS NOT NULL GROUP BY k)"""


@query("profile_assoc", OC + "\n" + "\nUNION ALL\n".join(
    _eta_sql(c, n) for c in ("segment", "priority") for n in ("lines", "price")),
       ["eta"], "A9 correlation ratio")
def q_profile_assoc(spark, sf):
    return STS.correlation_ratio(order_cohort(spark, sf), ["segment", "priority"], ["lines", "price"])


@query("profile_uncertainty", OC + """,
j AS (SELECT coalesce(segment, 'NULL') AS x, coalesce(priority, 'NULL') AS y, count(*) AS nxy FROM oc GROUP BY ALL),
j2 AS (SELECT *, sum(nxy) OVER (PARTITION BY x) AS nx, sum(nxy) OVER (PARTITION BY y) AS ny FROM j),
t AS (SELECT sum(nxy) AS n, sum(-nxy * ln(nxy / ny)) AS n_hxy, sum(-nxy * ln(nx)) AS s FROM j2)
SELECT 'segment' AS x, 'priority' AS y,
       ((s / n + ln(n)) - n_hxy / n) / nullif(s / n + ln(n), 0) AS u FROM t""", ["u"], "A9 uncertainty coefficient")
def q_profile_uncertainty(spark, sf):
    return STS.uncertainty_coefficient(order_cohort(spark, sf), "segment", "priority")


def _compare_sql():
    cols = ["count", "missing", "mean", "std", "min", "max", "q50"]
    tr = _profile_sql("tr", PNUMS)
    ex = _profile_sql("ex", PNUMS)
    sel_a = ", ".join(f"{c} AS {c}_train" for c in cols)
    sel_b = ", ".join(f"{c} AS {c}_external" for c in cols)
    return OC + f""",
tr AS (SELECT * FROM oc WHERE yr < 2000), ex AS (SELECT * FROM oc WHERE yr >= 2000),
a AS (SELECT feature, {sel_a} FROM ({tr})), b AS (SELECT feature, {sel_b} FROM ({ex}))
SELECT * FROM a FULL JOIN b USING (feature)"""


_CMP_COLS = ["count", "missing", "mean", "std", "min", "max", "q50"]


@query("profile_compare", _compare_sql(),
       [f"{c}_{s}" for c in ("mean", "std", "min", "max", "q50") for s in ("train", "external")],
       "A10 train vs external profile")
def q_profile_compare(spark, sf):
    train, ext = order_split(order_cohort(spark, sf))
    a = STS.profile_numeric(train, PNUMS).select("feature", *_CMP_COLS)
    b = STS.profile_numeric(ext, PNUMS).select("feature", *_CMP_COLS)
    return STS.profile_compare(a, b)
