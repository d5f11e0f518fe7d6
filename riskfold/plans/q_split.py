"""Registered queries: resampling plans and class balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskfold.operators import balance as BA
from riskfold.operators import split as SP
from riskfold.plans.oracle import ORDER_COHORT, TEXT_COHORT, vector_cohort, with_
from riskfold.plans.registry import query
from riskfold.sources.cohorts import order_cohort, text_cohort, vector_cohort as vcohort

OC = with_(ORDER_COHORT)
TC = with_(TEXT_COHORT)
VC = with_(vector_cohort())
DIM = 64
VFEATS = [f"e{i}" for i in range(DIM)]

_MD5 = "md5(concat_ws('|', CAST(row_id AS VARCHAR), {salt}))"


def _hexint(expr, digits=15):
    return f"CAST('0x' || substr({expr}, 1, {digits}) AS BIGINT)"


@query("stratified_kfold", OC + f"""
SELECT row_id, returned AS y,
       CAST((row_number() OVER (PARTITION BY returned ORDER BY {_MD5.format(salt="'42'")}) - 1) % 5 AS INTEGER) AS fold
FROM oc""", [], "R1")
def q_kfold(spark, sf):
    return SP.stratified_kfold(order_cohort(spark, sf), "returned", 5, 42)


@query("stratified_shuffle", OC + """,
x AS (SELECT row_id, returned AS y, CAST(s.range AS INTEGER) AS split FROM oc, range(5) s),
r AS (SELECT *, row_number() OVER (PARTITION BY split, y
                 ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '42', CAST(split AS VARCHAR)))) AS rn,
             count(*) OVER (PARTITION BY split, y) AS n FROM x)
SELECT row_id, y, split, CASE WHEN rn <= round(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS role
FROM r""", [], "R2")
def q_shuffle(spark, sf):
    return SP.stratified_shuffle(order_cohort(spark, sf), "returned", 5, 0.2, 42)


@query("train_test_split", TC + """,
r AS (SELECT row_id, toxic AS y, row_number() OVER (PARTITION BY toxic
                 ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '42', '0'))) AS rn,
             count(*) OVER (PARTITION BY toxic) AS n FROM tc WHERE toxic IS NOT NULL)
SELECT row_id, y, CASE WHEN rn <= round(CAST(0.25 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS role
FROM r""", [], "R3")
def q_train_test(spark, sf):
    return SP.train_test_split(text_cohort(spark, sf), "toxic", 0.25, 42)


@query("holdout_split", OC + f""",
r AS (SELECT row_id, row_number() OVER (ORDER BY {_MD5.format(salt="'42', 'holdout'")}) AS rn,
             count(*) OVER () AS n FROM oc)
SELECT row_id, CASE WHEN rn <= round(CAST(0.15 AS DOUBLE) * n) THEN 'valid' ELSE 'train' END AS role FROM r""",
       [], "R4")
def q_holdout(spark, sf):
    return SP.holdout_split(order_cohort(spark, sf), 0.15, 42)


@query("loo_folds", TC + "\nSELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS fold FROM tc", [], "R5")
def q_loo(spark, sf):
    return SP.loo_folds(text_cohort(spark, sf))


_NESTED = OC + """,
lab AS (SELECT row_id, 'returned' AS endpoint, CAST(returned AS VARCHAR) AS y FROM oc
        UNION ALL SELECT row_id, 'pending' AS endpoint, CAST(pending AS VARCHAR) AS y FROM oc),
grid AS (SELECT CAST(s AS INTEGER) AS seed, CAST(o AS INTEGER) AS outer_fold
         FROM (VALUES (42), (7)) a(s), range(5) b(o)),
x AS (SELECT lab.*, grid.seed, grid.outer_fold FROM lab, grid),
o AS (SELECT x.*, row_number() OVER (PARTITION BY endpoint, seed, outer_fold, y ORDER BY
        md5(concat_ws('|', CAST(row_id AS VARCHAR), CAST(seed AS VARCHAR), CAST(outer_fold AS VARCHAR)))) AS orn,
        count(*) OVER (PARTITION BY endpoint, seed, outer_fold, y) AS n FROM x),
o2 AS (SELECT *, CASE WHEN orn <= round(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS role FROM o),
tr AS (SELECT row_id, endpoint, seed, outer_fold, y, role,
              CAST((row_number() OVER (PARTITION BY endpoint, seed, outer_fold, y ORDER BY
                md5(concat_ws('|', CAST(row_id AS VARCHAR), CAST(seed AS VARCHAR), CAST(outer_fold AS VARCHAR),
                'inner'))) - 1) % 5 AS INTEGER) AS inner_fold
       FROM o2 WHERE role = 'train'),
plan AS (SELECT * FROM tr UNION ALL
         SELECT row_id, endpoint, seed, outer_fold, y, role, CAST(NULL AS INTEGER) AS inner_fold
         FROM o2 WHERE role = 'test')"""


def _nested(spark, sf):
    return SP.nested_fold_plan(order_cohort(spark, sf), ["returned", "pending"], seeds=(42, 7), n_outer=5,
                               n_inner=5, test_fraction=0.2)


_DIGEST = ["endpoint", "seed", "outer_fold", "y", "role", "inner_fold"]


@query("nested_fold_plan", _NESTED + f"""
SELECT {", ".join(_DIGEST)}, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids,
       CAST(sum(row_id * row_id % 1000003) AS BIGINT) AS squares FROM plan GROUP BY ALL""", [], "R6 (digest of each fold's rows)")
def q_nested(spark, sf):
    i = F.col("row_id")
    return _nested(spark, sf).groupBy(*_DIGEST).agg(F.count(F.lit(1)).alias("n"), F.sum(i).alias("ids"),
                                                    F.sum(i * i % 1000003).alias("squares"))


@query("split_sizes", _NESTED + """
SELECT endpoint, seed, outer_fold, role, n, n / sum(n) OVER (PARTITION BY endpoint, seed, outer_fold) AS share
FROM (SELECT endpoint, seed, outer_fold, role, count(*) AS n FROM plan GROUP BY ALL)""", ["share"], "A6")
def q_split_sizes(spark, sf):
    return SP.split_sizes(_nested(spark, sf))


@query("fold_rows", _NESTED + """
SELECT p.row_id, p.inner_fold, oc.total, oc.lines FROM plan p JOIN oc ON p.row_id = oc.row_id
WHERE p.endpoint = 'returned' AND p.seed = 42 AND p.outer_fold = 0 AND p.role = 'train'""",
       ["total", "lines"], "J3")
def q_fold_rows(spark, sf):
    plan = _nested(spark, sf).filter((F.col("endpoint") == "returned") & (F.col("seed") == 42)
                                     & (F.col("outer_fold") == 0) & (F.col("role") == "train"))
    oc = order_cohort(spark, sf).select("row_id", "total", "lines")
    return plan.join(oc, "row_id").select("row_id", "inner_fold", "total", "lines")


# -- balancing ---------------------------------------------------------------------------

@query("class_weights", TC + """,
l AS (SELECT 'quality' AS endpoint, quality AS y FROM tc WHERE quality IS NOT NULL
      UNION ALL SELECT 'toxic' AS endpoint, toxic AS y FROM tc WHERE toxic IS NOT NULL),
g AS (SELECT endpoint, y, count(*) AS n FROM l GROUP BY ALL)
SELECT endpoint, y, n, sum(n) OVER (PARTITION BY endpoint) / (count(*) OVER (PARTITION BY endpoint) * n) AS weight
FROM g""", ["weight"], "B1")
def q_class_weights(spark, sf):
    return BA.class_weights(text_cohort(spark, sf), ["quality", "toxic"])


_OVER = TC + """,
lab AS (SELECT row_id, toxic FROM tc WHERE toxic IS NOT NULL),
cls AS (SELECT toxic, count(*) AS n FROM lab GROUP BY toxic),
mm AS (SELECT (SELECT toxic FROM cls ORDER BY n, toxic LIMIT 1) AS minc,
              (SELECT min(n) FROM cls) AS n_min, (SELECT max(n) FROM cls) AS n_maj),
mino AS (SELECT row_id, toxic, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '42'))) AS rk
         FROM lab WHERE toxic = (SELECT minc FROM mm)),
draws AS (SELECT unnest(range(n_maj - n_min)) AS draw, n_min FROM mm),
picks AS (SELECT draw, """ + _hexint("md5(concat_ws('|', '42', CAST(draw AS VARCHAR), 'over'))") + """ % n_min + 1 AS rk
          FROM draws),
bal AS (SELECT row_id, toxic, CAST(NULL AS BIGINT) AS draw FROM lab
        UNION ALL SELECT m.row_id, m.toxic, p.draw FROM picks p JOIN mino m ON p.rk = m.rk)"""


def _oversampled(spark, sf):
    lab = text_cohort(spark, sf).filter(F.col("toxic").isNotNull()).select("row_id", "toxic")
    return lab, BA.random_oversample(lab, "toxic", 42)


@query("random_oversample", _OVER + "\nSELECT * FROM bal", [], "B2")
def q_oversample(spark, sf):
    return _oversampled(spark, sf)[1]


@query("balance_report", _OVER + """
SELECT b.y, b.n_before, a.n_after FROM
  (SELECT toxic AS y, count(*) AS n_before FROM lab GROUP BY toxic) b
  FULL JOIN (SELECT toxic AS y, count(*) AS n_after FROM bal GROUP BY toxic) a ON a.y = b.y""", [], "B5")
def q_balance_report(spark, sf):
    lab, bal = _oversampled(spark, sf)
    return BA.balance_report(lab, bal, "toxic")


def _dist_sql(a, b, cols):
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in cols) + ")"


def _smote_sql(k=5):
    feats = ", ".join(f"b.{c} + d.u * (n.{c} - b.{c}) AS {c}" for c in VFEATS)
    unit = f"CAST({_hexint('h', 13)} AS DOUBLE) / CAST(4503599627370496 AS DOUBLE)"
    return VC + f""",
cls AS (SELECT is_zero, count(*) AS n FROM vc GROUP BY is_zero),
mm AS (SELECT (SELECT is_zero FROM cls ORDER BY n, is_zero LIMIT 1) AS minc,
              (SELECT min(n) FROM cls) AS n_min, (SELECT max(n) FROM cls) AS n_maj),
mino AS (SELECT * FROM vc WHERE is_zero = (SELECT minc FROM mm)),
nb AS (SELECT * FROM (SELECT q.row_id AS qid, x.row_id AS did,
        row_number() OVER (PARTITION BY q.row_id ORDER BY {_dist_sql('q', 'x', VFEATS)}, x.row_id) AS rank
        FROM mino q, mino x WHERE q.row_id <> x.row_id) WHERE rank <= {k}),
keff AS (SELECT qid, count(*) AS kq FROM nb GROUP BY qid),
rk AS (SELECT row_id AS base_id, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '42'))) AS rk
       FROM mino),
d0 AS (SELECT unnest(range(n_maj - n_min)) AS draw, n_min FROM mm),
d1 AS (SELECT draw, {_hexint("md5(concat_ws('|', '42', CAST(draw AS VARCHAR), 'smote', 'base'))")} % n_min + 1 AS rk
       FROM d0),
d2 AS (SELECT d1.draw, rk.base_id FROM d1 JOIN rk ON d1.rk = rk.rk),
d3 AS (SELECT d2.*, {_hexint("md5(concat_ws('|', '42', CAST(draw AS VARCHAR), 'smote', 'nb'))")} % keff.kq + 1 AS rank,
              md5(concat_ws('|', '42', CAST(draw AS VARCHAR), 'smote', 'u')) AS h
       FROM d2 JOIN keff ON d2.base_id = keff.qid),
d AS (SELECT d3.draw, d3.base_id, nb.did AS nb_id, {unit} AS u
      FROM d3 JOIN nb ON d3.base_id = nb.qid AND d3.rank = nb.rank)
SELECT d.draw, d.base_id, d.nb_id, d.u, {feats}
FROM d JOIN mino b ON b.row_id = d.base_id JOIN mino n ON n.row_id = d.nb_id"""


@query("smote", _smote_sql(), ["u"] + VFEATS, "B3")
def q_smote(spark, sf):
    return BA.smote(vcohort(spark, sf), "is_zero", VFEATS, 5, 42)


@query("adasyn_counts", VC + f""",
cls AS (SELECT is_zero, count(*) AS n FROM vc GROUP BY is_zero),
mm AS (SELECT (SELECT is_zero FROM cls ORDER BY n, is_zero LIMIT 1) AS minc,
              (SELECT max(n) FROM cls) - (SELECT min(n) FROM cls) AS g_total),
nb AS (SELECT * FROM (SELECT q.row_id AS qid, x.is_zero AS y,
        row_number() OVER (PARTITION BY q.row_id ORDER BY {_dist_sql('q', 'x', VFEATS)}, x.row_id) AS rank
        FROM vc q, vc x WHERE q.is_zero = (SELECT minc FROM mm) AND q.row_id <> x.row_id) WHERE rank <= 5),
r AS (SELECT qid, count(CASE WHEN y <> (SELECT minc FROM mm) THEN 1 END) / CAST(5 AS DOUBLE) AS r FROM nb GROUP BY qid)
SELECT qid AS row_id, r, CAST(round_even(r / (SELECT sum(r) FROM r) * (SELECT g_total FROM mm), 0) AS BIGINT) AS g
FROM r""", ["r"], "B4 allocation")
def q_adasyn_counts(spark, sf):
    return BA.adasyn_counts(vcohort(spark, sf), "is_zero", VFEATS, 5)


@query("adasyn", None, [], "B4")
def q_adasyn(spark, sf):
    return BA.adasyn(vcohort(spark, sf), "is_zero", VFEATS, 5, 42)
