"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``,
optionally an equivalent SQL statement and the double columns both sides
round to 6 decimals before comparison."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.plans.oracle import rounded

DIGITS = 6


@dataclass
class Query:
    name: str
    fn: object
    sql: str | None = None
    doubles: list = field(default_factory=list)
    operator: str = ""

    def run(self, spark, sf_dir) -> DataFrame:
        df = self.fn(spark, sf_dir)
        return round_doubles(df, self.doubles)

    def oracle(self) -> str | None:
        return rounded(self.sql, self.doubles, DIGITS) if self.sql else None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, doubles=(), operator: str = ""):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, list(doubles), operator)
        return fn
    return deco


def round_expr(c):
    """Keep ~10 significant digits (values below 1e-9 in magnitude become 0):
    float noise from a different summation order then vanishes on both sides."""
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - F.lit(3))
    return F.when(c.isNull() | F.isnan(c), c).when(F.abs(c) < F.lit(1e-9), F.lit(0.0)) \
        .otherwise(F.round(c / p, DIGITS) * p)


def round_doubles(df: DataFrame, cols) -> DataFrame:
    cols = set(cols)
    if not cols:
        return df
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in cols and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round_expr(c.cast("double")).alias(f.name)
        out.append(c)
    return df.select(*out)
