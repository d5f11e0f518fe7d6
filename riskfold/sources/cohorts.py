"""Cohort builders over the fixture tables and the dataset registry (S3).

Each builder returns a lazy DataFrame keyed by a unique ``row_id``; the
matching :class:`Catalog` declares the column kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.sources.infos import Catalog, ColumnInfo
from riskfold.sources.tables import table

# The declared column catalog of the order cohort.
ORDER_CATALOG = Catalog.of([
    ColumnInfo("total", False, "N", "pre"),
    ColumnInfo("acctbal", False, "N", "pre"),
    ColumnInfo("lines", False, "N", "post"),
    ColumnInfo("qty", False, "N", "post"),
    ColumnInfo("price", False, "N", "post"),
    ColumnInfo("disc", False, "N", "post"),
    ColumnInfo("constant", False, "N", "pre"),
    ColumnInfo("total_x2", False, "N", "pre"),
    ColumnInfo("segment", False, "C", "pre"),
    ColumnInfo("priority", False, "C", "intra"),
    ColumnInfo("half", False, "B", "pre"),
    ColumnInfo("yr", False, "N", "pre", True),
    ColumnInfo("returned", True, "B", None),
    ColumnInfo("pending", True, "B", None),
])

# The declared column catalog of the text cohort.
TEXT_CATALOG = Catalog.of([
    ColumnInfo("n_chars", False, "N", "pre"),
    ColumnInfo("lang", False, "C", "pre"),
    ColumnInfo("source", False, "C", "pre"),
    ColumnInfo("quality", True, "B", None),
    ColumnInfo("toxic", True, "B", None),
])

EMBEDDING_DIM = 64


def vector_catalog(dim: int = EMBEDDING_DIM) -> Catalog:
    return Catalog.of([ColumnInfo(f"e{i}", False, "N", "pre") for i in range(dim)]
                      + [ColumnInfo("is_zero", True, "B", None)])


def order_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: price and size features, customer balance and
    segment, with the return flag and pending status as endpoints."""
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("li_lines"),
               F.sum("l_quantity").alias("li_qty"),
               F.avg("l_extendedprice").alias("li_price"),
               F.max("l_discount").alias("li_disc_max"),
               F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("li_returned")))
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(li, li.l_orderkey == o.o_orderkey, "left"))
    key = F.col("o_orderkey")
    return j.select(
        key.alias("row_id"),
        F.col("o_totalprice").alias("total"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("acctbal"),
        F.col("li_lines").cast("double").alias("lines"),
        F.col("li_qty").alias("qty"),
        F.col("li_price").alias("price"),
        F.when(key % 10 < 6, F.lit(None)).otherwise(F.col("li_disc_max")).alias("disc"),
        F.lit(1.0).alias("constant"),
        (F.lit(2.0) * F.col("o_totalprice") + F.lit(1.0)).alias("total_x2"),
        F.col("c_mktsegment").alias("segment"),
        F.when(key % 7 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.month("o_orderdate") <= 6, "H1").otherwise("H2").alias("half"),
        F.coalesce(F.col("li_returned"), F.lit(0)).alias("returned"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("pending"),
        F.year("o_orderdate").alias("yr"),
    )


def order_split(cohort: DataFrame, external_from_year: int = 2000):
    """Train cohort (orders before ``external_from_year``) and external cohort."""
    return (cohort.filter(F.col("yr") < external_from_year),
            cohort.filter(F.col("yr") >= external_from_year))


def text_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with partially known quality / toxicity labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = table(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id", "left")
            .select(F.col("doc_id").alias("row_id"), F.col("n_chars").cast("double").alias("n_chars"),
                    "lang", "source", "quality", "toxic"))


def vector_cohort(spark: SparkSession, sf_dir: str, dim: int = EMBEDDING_DIM) -> DataFrame:
    """Embedding coordinates as double columns, endpoint ``is_zero = (label = 0)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dim)],
                    F.when(F.col("label") == 0, 1).otherwise(0).alias("is_zero"))


# -- dataset registry (S3) ---------------------------------------------
_REGISTRY: dict[str, Callable[..., tuple[DataFrame, DataFrame | None, Catalog]]] = {}


def register_dataset(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


def get_dataset(name: str, spark: SparkSession, **opts):
    """Return ``(train, external_or_None, catalog)`` for a registered name."""
    if name not in _REGISTRY:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](spark, **opts)


@register_dataset("orders")
def _orders(spark, sf_dir, external=False, **_):
    cohort = order_cohort(spark, sf_dir)
    if external:
        train, ext = order_split(cohort)
        return train, ext, ORDER_CATALOG
    return cohort, None, ORDER_CATALOG


@register_dataset("documents")
def _documents(spark, sf_dir, **_):
    return text_cohort(spark, sf_dir), None, TEXT_CATALOG


@register_dataset("embeddings")
def _embeddings(spark, sf_dir, **_):
    return vector_cohort(spark, sf_dir), None, vector_catalog()


@register_dataset("csv")
def _csv(spark, path, infos_path, delimiter=",", skip_lines=0, external_path=None, **_):
    from riskfold.sources.csv import read_table
    from riskfold.sources.infos import read_infos
    cat = read_infos(spark, infos_path)
    train = read_table(spark, path, delimiter, skip_lines)
    ext = read_table(spark, external_path, delimiter, skip_lines) if external_path else None
    return train, ext, cat
