"""Class balancing on training rows.

Random choices are md5 draws keyed by (seed, draw number), so a balanced
set is reproducible and identical on recompute.  Draw numbers come from
``spark.range`` (distributed); picked rows are fetched with an equi-join on
a dense rank, never by collecting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.exprs import col
from riskfold.operators.knn import nearest_neighbours
from riskfold.operators.split import ranked


def _md5_int(modulus, *parts):
    h = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, F.Column) else F.lit(str(p)) for p in parts]))
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), F.lit(modulus).cast("long"))


def _md5_unit(*parts):
    h = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, F.Column) else F.lit(str(p)) for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def class_sizes(df: DataFrame, label: str) -> dict:
    """Class counts (one row per class)."""
    return {r[0]: r[1] for r in df.groupBy(col(label)).count().collect() if r[0] is not None}


def class_weights(df: DataFrame, endpoints) -> DataFrame:
    """B1: balanced weights ``w_c = n / (n_classes * n_c)`` per endpoint and class."""
    from riskfold.functions.exprs import unpivot
    long = unpivot(df, [], list(endpoints), "endpoint", "y", cast="int").filter(F.col("y").isNotNull())
    g = long.groupBy("endpoint", "y").agg(F.count(F.lit(1)).alias("n"))
    t = g.groupBy("endpoint").agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return (g.join(t, "endpoint")
            .select("endpoint", "y", "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight")))


def with_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (class table is tiny)."""
    w = class_weights(df.select(col(label)), [label]).select(F.col("y").alias("_y"), F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), col(label) == F.col("_y")).drop("_y")


def _minority_majority(df: DataFrame, label: str):
    sizes = class_sizes(df, label)
    if len(sizes) != 2:
        raise ValueError(f"balancing needs two classes, found {sorted(sizes)}")
    (minc, n_min), (majc, n_maj) = sorted(sizes.items(), key=lambda kv: (kv[1], kv[0]))
    return minc, n_min, majc, n_maj


def random_oversample(df: DataFrame, label: str, seed: int = 42, key: str = "row_id") -> DataFrame:
    """B2: add ``n_maj - n_min`` minority rows drawn with replacement.

    Output: the input rows with ``draw = NULL`` plus the copies with their
    draw number."""
    minc, n_min, _majc, n_maj = _minority_majority(df, label)
    n_new = n_maj - n_min
    base = df.withColumn("draw", F.lit(None).cast("long"))
    if n_new <= 0:
        return base
    spark = df.sparkSession
    mino = ranked(df.filter(col(label) == F.lit(minc)), [], F.md5(F.concat_ws("|", col(key).cast("string"),
                                                                          F.lit(str(seed)))), "_rk")
    picks = spark.range(n_new).select(F.col("id").alias("draw"),
                                      (_md5_int(n_min, seed, F.col("id"), "over") + 1).alias("_rk"))
    copies = picks.join(mino, "_rk").select(*[col(c) for c in df.columns], "draw")
    return base.unionByName(copies)


def balance_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """``(y, n_before, n_after)``."""
    b = before.groupBy(col(label).alias("y")).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(col(label).alias("y")).agg(F.count(F.lit(1)).alias("n_after"))
    return b.join(a, "y", "full")


def smote(df: DataFrame, label: str, features, k: int = 5, seed: int = 42, key: str = "row_id") -> DataFrame:
    """``n_maj - n_min`` synthetic minority rows
    ``base + u * (neighbour - base)``: base drawn uniformly, neighbour among
    its ``k`` nearest minority rows, ``u`` uniform in [0, 1).

    Output: ``(draw, base_id, nb_id, u, features...)``."""
    features = list(features)
    minc, n_min, _majc, n_maj = _minority_majority(df, label)
    n_new = n_maj - n_min
    mino = df.filter(col(label) == F.lit(minc))
    return _interpolate(df.sparkSession, mino, features, k, seed, key, n_new, n_min, "smote")


def _interpolate(spark, mino, features, k, seed, key, n_new, n_min, salt, base_draws=None):
    nb = nearest_neighbours(mino, mino, features, k, key)
    k_eff = nb.groupBy("qid").agg(F.count(F.lit(1)).alias("_kq"))
    rk = ranked(mino.select(col(key).alias("_id")), [], F.md5(F.concat_ws("|", F.col("_id").cast("string"),
                                                                         F.lit(str(seed)))), "_rk")
    if base_draws is None:
        draws = spark.range(n_new).select(F.col("id").alias("draw"),
                                          (_md5_int(n_min, seed, F.col("id"), salt, "base") + 1).alias("_rk"))
        draws = draws.join(rk, "_rk").select("draw", F.col("_id").alias("base_id"))
    else:
        draws = base_draws
    draws = (draws.join(k_eff, draws.base_id == k_eff.qid).drop("qid")
             .withColumn("rank", (_md5_int(F.col("_kq"), seed, F.col("draw"), salt, "nb") + 1).cast("int"))
             .withColumn("u", _md5_unit(seed, F.col("draw"), salt, "u")))
    pairs = draws.join(nb, (draws.base_id == nb.qid) & (draws["rank"] == nb["rank"])).select(
        "draw", "base_id", F.col("did").alias("nb_id"), "u")
    fb = mino.select(col(key).alias("base_id"), *[col(c).cast("double").alias(f"b_{c}") for c in features])
    fn = mino.select(col(key).alias("nb_id"), *[col(c).cast("double").alias(f"n_{c}") for c in features])
    x = pairs.join(fb, "base_id").join(fn, "nb_id")
    return x.select("draw", "base_id", "nb_id", "u",
                    *[(F.col(f"b_{c}") + F.col("u") * (F.col(f"n_{c}") - F.col(f"b_{c}"))).alias(c)
                      for c in features])


def adasyn_counts(df: DataFrame, label: str, features, k: int = 5, key: str = "row_id") -> DataFrame:
    """B4 allocation: per minority row the share ``r`` of other-class rows among
    its ``k`` nearest neighbours in all data, and ``g = round_half_even(r / sum(r) * G)``
    synthetic rows with ``G = n_maj - n_min``.  Raises when ``sum(r) = 0``."""
    features = list(features)
    minc, n_min, _majc, n_maj = _minority_majority(df, label)
    G = n_maj - n_min
    mino = df.filter(col(label) == F.lit(minc))
    nb = nearest_neighbours(mino, df, features, k, key)
    lab = df.select(col(key).alias("did"), col(label).alias("_y"))
    r = (nb.join(lab, "did").groupBy("qid")
         .agg((F.count(F.when(F.col("_y") != F.lit(minc), 1)) / F.lit(float(k))).alias("r")))
    total = r.agg(F.sum("r")).first()[0] or 0.0
    if total == 0:
        raise ValueError("Not any neigbours belong to the majority class; ADASYN cannot generate samples")
    return r.select(F.col("qid").alias(key), "r",
                    F.bround(F.col("r") / F.lit(total) * F.lit(float(G))).cast("long").alias("g"))


def adasyn(df: DataFrame, label: str, features, k: int = 5, seed: int = 42, key: str = "row_id") -> DataFrame:
    """``g_i`` synthetic rows per minority row ``i``, each interpolated
    towards one of its ``k`` nearest minority neighbours."""
    features = list(features)
    minc, n_min, _majc, _n_maj = _minority_majority(df, label)
    counts = adasyn_counts(df, label, features, k, key).filter(F.col("g") > 0)
    draws = counts.select(F.col(key).alias("base_id"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("j"))
    draws = draws.select("base_id", F.concat_ws("-", F.col("base_id").cast("string"),
                                                F.col("j").cast("string")).alias("draw"))
    mino = df.filter(col(label) == F.lit(minc))
    return _interpolate(df.sparkSession, mino, features, k, seed, key, None, n_min, "adasyn", base_draws=draws)
