"""Iterative (round-robin regression) imputation.

Start from mean-filled values; in each round, for each column in turn, fit a
least-squares regression of the column on all others over the rows where
it was observed and replace its missing entries by the prediction.  A fit
is one aggregate of the normal equations (partial sums per task, a
``(d+1)^2`` matrix on the driver), so no row ever leaves the executors.
Lineage is cut with a reliable checkpoint after every round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.exprs import col
from riskfold.session import cut_lineage


def _fit_column(df: DataFrame, target: str, others: list, ridge: float = 1e-8):
    obs = F.col(f"_obs_{target}")
    feats = [F.lit(1.0)] + [col(o) for o in others]
    aggs = []
    for i, a in enumerate(feats):
        aggs.append(F.sum(F.when(obs, a * col(target))).alias(f"y{i}"))
        for j in range(i, len(feats)):
            aggs.append(F.sum(F.when(obs, a * feats[j])).alias(f"g{i}_{j}"))
    row = df.agg(*aggs).first()
    p = len(feats)
    g = np.zeros((p, p))
    y = np.zeros(p)
    for i in range(p):
        y[i] = row[f"y{i}"] or 0.0
        for j in range(i, p):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    g[1:, 1:] += ridge * np.eye(p - 1) * max(1.0, float(np.trace(g)) / p)
    beta = np.linalg.lstsq(g, y, rcond=None)[0]
    return [float(b) for b in beta]


def _step(df: DataFrame, target: str, others: list, beta: list) -> DataFrame:
    pred = F.lit(beta[0])
    for b, o in zip(beta[1:], others):
        pred = pred + F.lit(b) * col(o)
    new = F.when(F.col(f"_obs_{target}"), col(target)).otherwise(pred).alias(target)
    return df.select(*[new if c == target else col(c) for c in df.columns])


def _start(df: DataFrame, columns, means: dict) -> DataFrame:
    keep = [c for c in df.columns if c not in columns]
    return df.select(*[col(c) for c in keep],
                     *[F.coalesce(col(c).cast("double"), F.lit(float(means[c]))).alias(c) for c in columns],
                     *[col(c).isNotNull().alias(f"_obs_{c}") for c in columns])


def fit_iterative(df: DataFrame, columns, means: dict, rounds: int = 10) -> list:
    """Return the fitted coefficients ``[(round, column, others, beta)]``."""
    columns = [c for c in columns if means.get(c) is not None]
    if len(columns) < 2:
        return []
    cur = _start(df, columns, means)
    models = []
    for r in range(rounds):
        for c in columns:
            others = [o for o in columns if o != c]
            beta = _fit_column(cur, c, others)
            models.append((r, c, others, beta))
            cur = _step(cur, c, others, beta)
        cur = cut_lineage(cur)
    return models


def apply_iterative(df: DataFrame, columns, models: list, means: dict) -> DataFrame:
    """Replay the fitted rounds on any cohort (mean start, same coefficients)."""
    columns = [c for c in columns if means.get(c) is not None]
    cur = _start(df, columns, means)
    for _r, c, others, beta in models:
        cur = _step(cur, c, others, beta)
    return cur.drop(*[f"_obs_{c}" for c in columns])
