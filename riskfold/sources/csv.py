"""Delimited-file cohort reader.

Cohort exports come as comma or semicolon separated files with a header
line, sometimes preceded by a few preamble lines.  Missing numeric values
are normalised to NULL (``NaN`` in a double column would otherwise poison
``avg``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, delimiter: str = ",", skip_lines: int = 0,
               infer_schema: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """Read a delimited file with a header after ``skip_lines`` preamble lines."""
    reader = (spark.read.option("header", True).option("sep", delimiter)
              .option("inferSchema", infer_schema).option("encoding", encoding)
              .option("nanValue", "NaN").option("mode", "PERMISSIVE"))
    if skip_lines <= 0:
        df = reader.csv(path)
    else:
        # Drop the first lines by global position; zipWithIndex numbers lines
        # partition by partition without moving them to the driver.
        lines = (spark.read.text(path).rdd.map(lambda r: r[0]).zipWithIndex()
                 .filter(lambda t: t[1] >= skip_lines).map(lambda t: t[0]))
        df = reader.csv(lines)
    return nan_to_null(df)


def read_any(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Parquet by extension, otherwise delimited text."""
    if path.endswith(".parquet") or kw.pop("format", None) == "parquet":
        return nan_to_null(spark.read.parquet(path))
    return read_table(spark, path, **kw)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in floating columns (pandas-style missing values)."""
    exprs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c).alias(f.name)
        exprs.append(c)
    return df.select(*exprs)
