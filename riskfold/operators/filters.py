"""Row and column filters (P5-P8, P10, P11) and the statistics behind them
(A2 null / single-value counts, A5 pairwise-complete Pearson correlation).

Every column statistic is computed in one aggregate pass over the cohort
(partial aggregation per task, a single tiny row at the end); the drop lists
are schema-sized and are the only thing that reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.functions.exprs import add_all, col, unpivot

# -- P5 --------------------------------------------------------------------


def min_non_null(n_cols: int, pct: float) -> int:
    """Non-null cells a row needs when at most ``pct`` percent may be missing."""
    return int(((100 - pct) / 100) * n_cols + 1)


def drop_sparse_rows(df: DataFrame, pct: float, key="row_id", columns=None) -> DataFrame:
    """P5: keep rows with at least ``min_non_null`` present values over all
    non-key columns (endpoints included); a no-op when ``pct <= 0``."""
    if pct <= 0:
        return df
    cols = list(columns) if columns is not None else [c for c in df.columns if c != key]
    need = min_non_null(len(cols), pct)
    present = add_all(col(c).isNotNull().cast("int") for c in cols)
    return df.filter(present >= F.lit(need))


# -- P6 / P7 / A2 ------------------------------------------------------------


def column_stats(df: DataFrame, columns) -> DataFrame:
    """One pass: per column the missing fraction, non-null count and whether it
    holds a single distinct value (``min = max``; no distinct aggregation).

    Returns the long table ``(ordinal, feature, missing_fraction, non_null, single_value)``.
    """
    columns = list(columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        aggs += [F.count(col(c)).alias(f"_c{i}"),
                 (F.min(col(c)) == F.max(col(c))).alias(f"_s{i}")]
    row = df.agg(*aggs)
    recs = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("feature"),
                     F.col(f"_c{i}").alias("non_null"), F.col(f"_s{i}").alias("single"))
            for i, c in enumerate(columns)]
    return (row.select("_n", F.explode(F.array(*recs)).alias("r"))
            .select("r.ordinal", "r.feature",
                    F.coalesce(F.try_divide((F.col("_n") - F.col("r.non_null")).cast("double"), F.col("_n")),
                               F.lit(0.0)).alias("missing_fraction"),
                    F.col("r.non_null").alias("non_null"),
                    F.coalesce(F.col("r.single"), F.lit(False)).alias("single_value")))


def sparse_columns(stats: DataFrame, threshold: float) -> DataFrame:
    """Columns whose missing fraction is strictly above ``threshold``."""
    return stats.filter(F.col("missing_fraction") > F.lit(threshold)).select("ordinal", "feature", "missing_fraction")


def single_value_columns(stats: DataFrame) -> DataFrame:
    """Columns with exactly one distinct non-null value (all-null kept)."""
    return stats.filter("single_value").select("ordinal", "feature", "non_null")


def names(df: DataFrame, column="feature") -> list[str]:
    """Collect a schema-sized list of names (bounded by the column count)."""
    return [r[0] for r in df.select(column).orderBy("ordinal").collect()] if "ordinal" in df.columns \
        else [r[0] for r in df.select(column).collect()]


def drop_sparse_cols(df: DataFrame, threshold: float, columns=None, key="row_id"):
    """P6 as a transformation: ``(df without the sparse columns, dropped names)``."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c != key]
    dropped = names(sparse_columns(column_stats(df, columns), threshold))
    return df.drop(*dropped), dropped


# -- A5 / P8 -----------------------------------------------------------------

def _pair_corr(x, y):
    """Pearson correlation over rows where both are present; NULL when either
    side has zero variance there (ANSI-safe, unlike ``corr``)."""
    xs = F.when(y.isNotNull(), x)
    ys = F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))


def correlation_pairs(df: DataFrame, columns) -> DataFrame:
    """A5: upper-triangle pairwise-complete Pearson correlations as
    ``(i, j, feature_i, feature_j, n, corr)`` with ``i < j`` in column order.

    One path at every width: each task emits the masked moment matrices of its
    rows (numpy matrix products), summed by ``(i, j)``.
    """
    columns = list(columns)
    if len(columns) < 2:
        spark = df.sparkSession
        return spark.createDataFrame([], "i int, j int, feature_i string, feature_j string, n long, corr double")
    return _correlation_gram(df, columns)


def _correlation_gram(df: DataFrame, columns) -> DataFrame:
    d = len(columns)
    # Centre at the column means first: moment sums of centred values keep
    # their precision when the raw values are large.
    means = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    mu = np.array([0.0 if means[f"m{i}"] is None else means[f"m{i}"] for i in range(d)])
    schema = T.StructType([T.StructField(n, T.IntegerType() if n in ("i", "j") else T.DoubleType())
                           for n in ("i", "j", "n", "sx", "sy", "sxx", "syy", "sxy")])
    iu, ju = np.triu_indices(d, 1)

    def blocks(it):
        acc = None
        for pdf in it:
            x = pdf.to_numpy(dtype="float64") - mu
            m = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x)
            parts = (m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x)
            acc = parts if acc is None else tuple(a + b for a, b in zip(acc, parts))
        if acc is None:
            return
        n, sxm, sxxm, sxy = acc
        yield pd.DataFrame({"i": iu.astype("int32"), "j": ju.astype("int32"), "n": n[iu, ju],
                            "sx": sxm[iu, ju], "sy": sxm[ju, iu], "sxx": sxxm[iu, ju],
                            "syy": sxxm[ju, iu], "sxy": sxy[iu, ju]})

    sel = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    g = (sel.mapInPandas(blocks, schema).groupBy("i", "j")
         .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]))
    cov = F.col("sxy") / F.col("n") - (F.col("sx") / F.col("n")) * (F.col("sy") / F.col("n"))
    vx = F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2)
    vy = F.col("syy") / F.col("n") - F.pow(F.col("sy") / F.col("n"), 2)
    spark = df.sparkSession
    names_df = spark.createDataFrame(list(enumerate(columns)), "k int, name string")
    r = F.when((F.col("n") > 0) & (vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx * vy)))
    return (g.select("i", "j", F.col("n").cast("long").alias("n"), r.alias("corr"))
            .join(F.broadcast(names_df.withColumnRenamed("k", "i").withColumnRenamed("name", "feature_i")), "i")
            .join(F.broadcast(names_df.withColumnRenamed("k", "j").withColumnRenamed("name", "feature_j")), "j")
            .select("i", "j", "feature_i", "feature_j", "n", "corr"))


def collinear_pairs(corr: DataFrame, threshold: float) -> DataFrame:
    """P8 record: ``(drop_feature, corr_feature, corr_value)`` for every pair
    with ``|r| > threshold``; the later column of the pair is dropped."""
    return (corr.filter(F.abs("corr") > F.lit(threshold))
            .select(F.col("j").alias("ordinal"), F.col("feature_j").alias("drop_feature"),
                    F.col("feature_i").alias("corr_feature"), F.col("corr").alias("corr_value")))


def drop_correlated(df: DataFrame, threshold: float, columns=None, key="row_id"):
    """Drop a column when any earlier column correlates above ``threshold``
    (compared with all earlier columns, dropped or not)."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c != key]
    rec = collinear_pairs(correlation_pairs(df, columns), threshold)
    dropped = sorted({r[0] for r in rec.select("drop_feature").distinct().collect()}, key=columns.index)
    return df.drop(*dropped), dropped


# -- P10 / W1 / W2 -------------------------------------------------------------


def cumulative_importance(imp: DataFrame, keys=()) -> DataFrame:
    """Normalised and running cumulative importance, most important first
    (ties by feature name).  ``keys`` partitions independent rankings."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), F.col("feature"))
    total = Window.partitionBy(*keys)
    norm = F.try_divide(F.col("importance"), F.sum("importance").over(total))
    out = imp.withColumn("normalized_importance", F.coalesce(norm, F.lit(0.0)))
    return (out.withColumn("rank", F.row_number().over(order))
            .withColumn("cumulative_importance",
                        F.sum("normalized_importance").over(order.rowsBetween(Window.unboundedPreceding, 0))))


def low_importance(cum: DataFrame, threshold: float) -> DataFrame:
    """P10: features not needed to reach ``threshold`` of cumulative importance."""
    return cum.filter(F.col("cumulative_importance") > F.lit(threshold))


def zero_importance(cum: DataFrame) -> DataFrame:
    """P9 filter on an importance table: importance exactly 0."""
    return cum.filter(F.col("importance") == 0.0)


def features_needed(cum: DataFrame, threshold: float, keys=()) -> DataFrame:
    """Number of features needed to pass ``threshold`` of the importance."""
    keys = list(keys)
    return (cum.filter(F.col("cumulative_importance") > F.lit(threshold))
            .groupBy(*keys).agg(F.min("rank").cast("int").alias("features_needed")))


# -- P11 -----------------------------------------------------------------------

METHODS = ("missing", "single_unique", "collinear", "zero_importance", "low_importance")


def removal_table(records: dict) -> DataFrame:
    """Union of per-method removal records into ``(method, feature)``; the
    record of ``collinear`` names its feature ``drop_feature``."""
    out = None
    for method, frame in records.items():
        name = "feature" if "feature" in frame.columns else "drop_feature"
        part = frame.select(F.lit(method).alias("method"), F.col(name).alias("feature")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def identify_all(df: DataFrame, columns, importance: DataFrame, missing_threshold: float, correlation_threshold: float,
                 cumulative_threshold: float) -> DataFrame:
    """All five methods at once; ``importance`` is a cumulated table."""
    stats = column_stats(df, columns)
    return removal_table({
        "missing": sparse_columns(stats, missing_threshold),
        "single_unique": single_value_columns(stats),
        "collinear": collinear_pairs(correlation_pairs(df, columns), correlation_threshold),
        "zero_importance": zero_importance(importance),
        "low_importance": low_importance(importance, cumulative_threshold)})


def features_to_remove(table: DataFrame, methods="all") -> DataFrame:
    """Distinct features chosen by ``methods`` (a list, or 'all')."""
    if methods != "all":
        present = {r[0] for r in table.select("method").distinct().collect()}
        for m in methods:
            if m not in present:
                raise ValueError(f"no removal record for method {m!r}")
        table = table.filter(F.col("method").isin(list(methods)))
    return table.select("feature").distinct()


def select_features(df: DataFrame, table: DataFrame, methods="all") -> DataFrame:
    """Drop the chosen features (a schema-sized list) from ``df``."""
    drop = [r[0] for r in features_to_remove(table, methods).collect()]
    return df.drop(*drop)


__all__ = ["min_non_null", "drop_sparse_rows", "column_stats", "sparse_columns", "single_value_columns",
           "drop_sparse_cols", "correlation_pairs", "collinear_pairs", "drop_correlated",
           "cumulative_importance", "low_importance", "zero_importance", "features_needed",
           "removal_table", "identify_all", "features_to_remove", "select_features", "unpivot"]
