"""Small Column-expression helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by exact name (names may hold dots, spaces, brackets)."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode raises on plain ``/ 0``)."""
    return F.try_divide(a, b)


def zero_div(a, b) -> Column:
    """a / b with 0 when b is 0 (the metric convention for undefined ratios)."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def add_all(cols) -> Column:
    cols = list(cols)
    return reduce(lambda x, y: x + y, cols) if cols else F.lit(0)


def unpivot(df: DataFrame, ids, columns, name="feature", value="value", cast="double") -> DataFrame:
    """Long form ``(ids..., name, value)`` of ``columns`` (no shuffle)."""
    ids = list(ids)
    pairs = [F.struct(F.lit(c).alias(name), col(c).cast(cast).alias(value)) for c in columns]
    return (df.select(*[col(i) for i in ids], F.explode(F.array(*pairs)).alias("_kv"))
            .select(*[col(i) for i in ids], f"_kv.{name}", f"_kv.{value}"))


def md5_order(*parts) -> Column:
    """Deterministic pseudo-random order key: md5 of the '|'-joined parts."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                                   for p in parts]))


def md5_unit(*parts) -> Column:
    """Deterministic uniform number in [0, 1) from the first 13 hex digits of md5."""
    h = md5_order(*parts)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def md5_int(modulus, *parts) -> Column:
    """Deterministic integer in [0, modulus) from the first 15 hex digits of md5."""
    h = md5_order(*parts)
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), modulus)
