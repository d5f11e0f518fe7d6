"""Column-set operators driven by the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.functions.exprs import col
from riskfold.sources.infos import Catalog


def feature_set_columns(catalog: Catalog, tags) -> list[str]:
    """Features whose input time is not in ``tags`` (to be dropped)."""
    tags = set(tags)
    return [r.column_name for r in catalog.rows if not r.endpoint and r.input_time not in tags]


def declared_drop_columns(catalog: Catalog) -> list[str]:
    """Columns marked ``drop`` (endpoints included)."""
    return [r.column_name for r in catalog.rows if r.drop]


def external_drop_columns(train: DataFrame, external: DataFrame, key="row_id") -> list[str]:
    """Training columns the external cohort lacks."""
    ext = set(external.columns)
    return [c for c in train.columns if c not in ext and c != key]


def drop_plan(df: DataFrame, catalog: Catalog, feature_set=None, drop_declared=True,
              external: DataFrame | None = None) -> list[str]:
    """Union of the three drop lists in the loader order (external, feature set, declared)."""
    out: list[str] = []
    if external is not None:
        out += external_drop_columns(df, external)
    if feature_set is not None:
        out += feature_set_columns(catalog, feature_set)
    if drop_declared:
        out += declared_drop_columns(catalog)
    seen, ordered = set(), []
    for c in out:
        if c not in seen:
            seen.add(c)
            ordered.append(c)
    return ordered


def select_columns(df: DataFrame, catalog: Catalog, feature_set=None, drop_declared=True,
                   external: DataFrame | None = None, key="row_id"):
    """Apply the drop plan; return ``(df, catalog, features, endpoints)``.

    Columns keep catalog order: key, features, endpoints.  Declared columns
    absent from the data are removed from the catalog.
    """
    drops = set(drop_plan(df, catalog, feature_set, drop_declared, external))
    present = set(df.columns)
    cat = catalog.restrict(present) if drop_declared else catalog
    feats = [c for c in cat.all_features() if c not in drops and c in present]
    ends = [c for c in cat.all_endpoints() if c not in drops and c in present]
    cat = cat.restrict(feats + ends)
    return df.select(col(key), *[col(c) for c in feats + ends]), cat, feats, ends


def align_external(train: DataFrame, external: DataFrame, key="row_id"):
    """Keep the training columns the external cohort also has, in training
    order; extra external columns (e.g. dummies of unseen categories) are dropped."""
    missing = external_drop_columns(train, external, key)
    keep = [c for c in train.columns if c not in missing]
    return train.select(*[col(c) for c in keep]), external.select(*[col(c) for c in keep])


def require_columns(external: DataFrame, columns) -> None:
    """Error naming the training columns missing from the external cohort."""
    miss = [c for c in columns if c not in set(external.columns)]
    if miss:
        raise ValueError(f"external cohort lacks columns {miss}")


def schema_table(spark: SparkSession, df: DataFrame, cohort: str) -> DataFrame:
    """Column names of a DataFrame as a table ``(cohort, ordinal, column_name, data_type)``."""
    rows = [(cohort, i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "cohort string, ordinal int, column_name string, data_type string")


def catalog_vs_data(spark: SparkSession, catalog: Catalog, df: DataFrame):
    """Declared-but-absent (anti) and declared-and-present (semi) catalog rows."""
    infos = catalog.to_dataframe(spark)
    cols = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    return (infos.join(cols, "column_name", "left_anti"),
            infos.join(cols, "column_name", "left_semi"))


def union_cohorts(*dfs: DataFrame, tags=None) -> DataFrame:
    """Union by name; missing columns become NULL; optional ``cohort`` tag."""
    out = None
    for i, d in enumerate(dfs):
        if tags:
            d = d.withColumn("cohort", F.lit(tags[i]))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
