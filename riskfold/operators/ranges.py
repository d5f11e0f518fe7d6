"""Order-preserving buckets of nearly equal size, for two-level ranks and running sums."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 512


def value_bucket(df: DataFrame, column: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``out``: the number of the quantile range that a numeric ``column`` falls
    into.  The bounds are approximate quantiles of the rows themselves, so however
    the values lie (all below 4e-4, or over 300 magnitudes), a bucket holds about
    ``1 / buckets`` of the distinct rows; rows of one value share a bucket."""
    probs = [i / buckets for i in range(1, buckets)]
    number = df.select(F.col(column).cast("double").alias("v"))
    cuts = sorted(set(number.approxQuantile("v", probs, 0.25 / buckets))) if buckets > 1 else []
    splits = [-math.inf, *(c for c in cuts if math.isfinite(c)), math.inf]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0))
    return Bucketizer(splits=splits, inputCol="_bv", outputCol=out, handleInvalid="keep").transform(
        df.withColumn("_bv", F.col(column).cast("double"))).drop("_bv")
