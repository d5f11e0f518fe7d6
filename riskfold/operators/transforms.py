"""Stateful feature engineering (T1-T5, T8-T9, T11) as fit / transform.

``fit`` runs a few aggregate passes and returns small state (vocabularies,
fill values, centres and scales); ``transform`` is one projection of Column
expressions, so it stays inside whole-stage codegen and applies equally to
training rows, held-out folds and an external cohort.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.exprs import add_all, col
from riskfold.operators.quantiles import exact_quantiles
from riskfold.session import cut_lineage

CATEGORY_FILL = "0"  # fixed value: a missing category becomes its own level "0"


# -- T1 / T2 -------------------------------------------------------------------


def fill_category(df: DataFrame, columns) -> DataFrame:
    """Missing categorical values become the category ``"0"``."""
    cols = set(columns)
    return df.select(*[F.coalesce(col(c).cast("string"), F.lit(CATEGORY_FILL)).alias(c) if c in cols else col(c)
                       for c in df.columns])


@dataclass
class Dictionary:
    """Levels of a column that has too many for one column each.

    ``levels`` is a written table ``(level, slot)``: slots number the sorted levels
    from 0 without gaps, so slot ``i`` is what the ``i``-th dummy column would be."""
    levels: DataFrame
    size: int


def fit_vocabulary(df: DataFrame, columns, dense_levels: int = 10000) -> dict:
    """Distinct levels per categorical column (after the fill), in sorted order.

    One distinct aggregation over ``(column, level)``; levels are counted per column
    before anything reaches the driver.  A column of at most ``dense_levels`` levels
    has a list, which becomes dummy columns; one with more has a :class:`Dictionary`
    that stays in Spark, which becomes one sparse vector column of the same slots.
    Assembled features are equal either way."""
    columns = list(columns)
    if not columns:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"),
                                         F.coalesce(col(c).cast("string"), F.lit(CATEGORY_FILL)).alias("v"))
                                for c in columns]))
    levels = cut_lineage(df.select(pairs.alias("p")).select("p.k", "p.v").distinct())
    n = {r["k"]: r["n"] for r in levels.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    narrow = [c for c in columns if n.get(c, 0) <= dense_levels]
    vocab = {c: [] if c in narrow else Dictionary(level_slots(levels.filter(F.col("k") == c).select(F.col("v").alias("level"))), n[c])
             for c in columns}
    for r in levels.filter(F.col("k").isin(narrow)).collect():
        vocab[r["k"]].append(r["v"])
    return {c: sorted(v) if isinstance(v, list) else v for c, v in vocab.items()}


def level_slots(levels: DataFrame) -> DataFrame:
    """``(level, slot)`` of distinct levels: ranges of levels are numbered inside
    themselves, after an offset from the sizes of the ranges before them."""
    ranged = cut_lineage(levels.repartitionByRange("level").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))       # one row per partition
    before = sizes.alias("a").join(sizes.toDF("_earlier", "_m").alias("b"), F.col("_earlier") < F.col("_range"), "left") \
        .groupBy("_range").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("level")) - 1
    return cut_lineage(ranged.withColumn("_place", place).join(before, "_range")
                       .select("level", (F.col("_before") + F.col("_place")).alias("slot")))


def wide_encode(df: DataFrame, dictionaries: dict) -> DataFrame:
    """T2 for columns with a :class:`Dictionary`: each becomes the sparse vector
    ``<col>_levels`` with a one in its level's slot; unseen level → all zeros."""
    for c, known in dictionaries.items():
        out = [x for x in df.columns if x != c] + [f"{c}_levels"]
        one = OneHotEncoder(inputCol="_slot", outputCol=f"{c}_levels", handleInvalid="keep", dropLast=True) \
            .fit(df.sparkSession.createDataFrame([(float(known.size - 1),)], "_slot double"))
        held = df.withColumn("_level", F.coalesce(col(c).cast("string"), F.lit(CATEGORY_FILL))) \
            .join(known.levels.select(F.col("level").alias("_level"), F.col("slot").cast("double").alias("_slot")), "_level", "left")
        df = one.transform(held.withColumn("_slot", F.coalesce("_slot", F.lit(float(known.size))))).select(*[col(x) for x in out])
    return df


def one_hot_exprs(vocab: dict) -> list:
    """``<col>_<level>`` doubles, levels sorted; unseen level → all zeros."""
    out = []
    for c, levels in vocab.items():
        v = F.coalesce(col(c).cast("string"), F.lit(CATEGORY_FILL))
        out += [F.when(v == F.lit(lv), 1.0).otherwise(0.0).alias(f"{c}_{lv}") for lv in levels]
    return out


def split_vocabulary(vocab: dict) -> tuple[dict, dict]:
    """(columns with a list of levels, columns with a dictionary)."""
    return ({c: v for c, v in vocab.items() if not isinstance(v, Dictionary)},
            {c: v for c, v in vocab.items() if isinstance(v, Dictionary)})


def one_hot(df: DataFrame, vocab: dict) -> DataFrame:
    """Replace the categorical columns by their dummies (or sparse vectors), appended at the end."""
    narrow, wide = split_vocabulary(vocab)
    keep = [col(c) for c in df.columns if c not in narrow]
    return wide_encode(df.select(*keep, *one_hot_exprs(narrow)), wide)


# -- T3 / T4 -------------------------------------------------------------------


def fit_binary(df: DataFrame, columns) -> dict:
    """Per binary column the two sorted distinct values mapped to 0 / 1.

    One pass: min, max and the count of values equal to neither.  ``{0, 1}``
    columns map to themselves; a single value warns (kept as is); a third
    value raises."""
    columns = list(columns)
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        s = col(c).cast("string")
        aggs += [F.min(s).alias(f"lo{i}"), F.max(s).alias(f"hi{i}"),
                 F.count(F.when(col(c).isNotNull(), 1)).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    third = df.agg(*[F.count(F.when(~col(c).cast("string").isin(row[f"lo{i}"], row[f"hi{i}"]), 1)).alias(f"x{i}")
                     for i, c in enumerate(columns) if row[f"lo{i}"] is not None]).first() \
        if any(row[f"lo{i}"] is not None for i in range(len(columns))) else None
    out = {}
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None or lo == hi:
            warnings.warn(f"Binary column {c} has less than 2 unique values.", UserWarning)
            out[c] = None
            continue
        if third is not None and third[f"x{i}"]:
            raise ValueError(f"Binary column {c} has more than 2 unique values")
        out[c] = (lo, hi)
    return out


def _numeric_order(a, b):
    """Order two string-encoded values numerically when both are numbers."""
    try:
        fa, fb = float(a), float(b)
        return (a, b) if fa <= fb else (b, a)
    except (TypeError, ValueError):
        return (a, b)


def binary_exprs(mapping: dict, fill_zero: bool = True) -> list:
    """T3 + T4: lower value → 0.0, upper → 1.0, missing → 0.0 (when ``fill_zero``)."""
    out = []
    for c, pair in mapping.items():
        s = col(c).cast("string")
        if pair is None:
            e = col(c).cast("double")
        else:
            lo, hi = _numeric_order(*pair)
            e = F.when(s == F.lit(lo), 0.0).when(s == F.lit(hi), 1.0)
        out.append((F.coalesce(e, F.lit(0.0)) if fill_zero else e).alias(c))
    return out


def fill_zero(df: DataFrame, columns) -> DataFrame:
    """T4: missing → 0 in the given columns."""
    cols = set(columns)
    return df.select(*[F.coalesce(col(c), F.lit(0)).alias(c) if c in cols else col(c) for c in df.columns])


# -- T5 / T8 / T9 ------------------------------------------------------------------


def fit_impute(df: DataFrame, columns, strategy: str = "mean") -> dict:
    """T5: per-column fill value (mean or exact median) over present values.
    An all-null column gets ``None`` (dropped by :func:`impute_exprs`)."""
    columns = list(columns)
    if not columns:
        return {}
    if strategy == "mean":
        row = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(columns)}
    if strategy == "median":
        q = exact_quantiles(df, columns, (0.5,))
        return {c: q[c][0] for c in columns}
    raise ValueError(f"Imputer type {strategy} not supported")


def impute_exprs(values: dict) -> dict:
    """``{column: filled expression}``; all-null columns are left out (dropped)."""
    out = {}
    for c, v in values.items():
        if v is None:
            warnings.warn(f"column {c} is entirely missing; dropped by the imputer", UserWarning)
            continue
        out[c] = F.coalesce(col(c).cast("double"), F.lit(float(v))).alias(c)
    return out


def fit_scale(df: DataFrame, columns, method: str = "standard") -> dict:
    """``(centre, scale)`` per column from one aggregate pass.

    standard: mean and population standard deviation (zero → 1);
    minmax: min and range (zero range → 1, so the column becomes 0)."""
    columns = list(columns)
    if not columns or method in (None, "none"):
        return {}
    if method == "standard":
        row = df.agg(*[F.avg(col(c)).alias(f"a{i}") for i, c in enumerate(columns)],
                     *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        return {c: (row[f"a{i}"] or 0.0, row[f"s{i}"] if row[f"s{i}"] else 1.0) for i, c in enumerate(columns)}
    if method == "minmax":
        row = df.agg(*[F.min(col(c)).alias(f"a{i}") for i, c in enumerate(columns)],
                     *[F.max(col(c)).alias(f"b{i}") for i, c in enumerate(columns)]).first()
        out = {}
        for i, c in enumerate(columns):
            lo, hi = row[f"a{i}"], row[f"b{i}"]
            rng = (hi - lo) if lo is not None and hi is not None else 0.0
            out[c] = (lo or 0.0, rng if rng else 1.0)
        return out
    raise ValueError(f"Normaliser type {method} not supported")


def scale_exprs(params: dict) -> dict:
    return {c: ((col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, (m, s) in params.items()}


def apply_columns(df: DataFrame, exprs: dict) -> DataFrame:
    """Replace the columns named in ``exprs`` in place, keep the rest."""
    return df.select(*[exprs.get(c, col(c)) for c in df.columns])


# -- T11 -------------------------------------------------------------------------


@dataclass
class PrepConfig:
    imputer: str | None = "knn"
    normaliser: str | None = "standard"
    feature_set: tuple | None = None
    drop_declared: bool = True
    drop_missing_value: float = 0.0       # P5 percent
    missing_threshold: float | None = None  # P6
    drop_single_unique: bool = False        # P7
    correlation_threshold: float | None = None  # P8
    knn_k: int = 5
    iterative_rounds: int = 10


@dataclass
class Prepared:
    """Fitted preparation: apply with :meth:`transform` to any cohort of the same schema."""
    key: str
    binary: dict
    vocab: dict
    numeric: list
    impute: dict
    scale: dict
    endpoints: list
    dropped: dict = field(default_factory=dict)
    knn_donors: DataFrame | None = None
    knn_k: int = 5
    iterative_models: list | None = None
    min_non_null: int = 0             # P5: present cells a row needs over row_columns
    row_columns: tuple = ()
    imputed: DataFrame | None = None  # training rows after imputation, before scaling

    @property
    def features(self) -> list:
        dummies = [x for c, lvs in self.vocab.items()
                   for x in ([f"{c}_levels"] if isinstance(lvs, Dictionary) else [f"{c}_{lv}" for lv in lvs])]
        nums = [c for c in self.numeric if self.impute.get(c, 0.0) is not None]
        return list(self.binary) + dummies + nums

    def feature_slots(self, spark) -> DataFrame:
        """``(slot, feature)``: what each place of the assembled feature vector (the places of
        coefficients and importances) stands for; levels of a dictionary come from its table."""
        at, plain, tables = 0, [], []
        owner = {f"{c}_levels": (c, v) for c, v in split_vocabulary(self.vocab)[1].items()}
        for f in self.features:
            if f in owner:
                c, known = owner[f]
                tables.append(known.levels.select((F.col("slot") + F.lit(at)).cast("long").alias("slot"),
                                                  F.concat(F.lit(f"{c}_"), "level").alias("feature")))
                at += known.size
            else:
                plain.append((at, f))
                at += 1
        out = spark.createDataFrame(plain, "slot long, feature string")
        for t in tables:
            out = out.unionByName(t)
        return out

    def keep_rows(self, df: DataFrame) -> DataFrame:
        """P5 with the threshold of the fit; a column that ``df`` lacks counts as missing."""
        if not self.min_non_null:
            return df
        present = add_all(col(c).isNotNull().cast("int") for c in self.row_columns if c in df.columns)
        return df.filter(present >= F.lit(self.min_non_null))

    def transform(self, df: DataFrame, keep_endpoints: bool = True) -> DataFrame:
        return self._scaled(self._filled(df, keep_endpoints))

    def fitted_rows(self) -> DataFrame:
        """The transformed training rows, from the imputation that the fit has already done."""
        return self._scaled(self.imputed)

    def _scaled(self, base: DataFrame) -> DataFrame:
        return apply_columns(base, scale_exprs(self.scale)) if self.scale else base

    def _filled(self, df: DataFrame, keep_endpoints: bool = True) -> DataFrame:
        nums = [c for c in self.numeric if self.impute.get(c, 0.0) is not None]
        narrow, wide = split_vocabulary(self.vocab)
        base = self.keep_rows(df).select(
            col(self.key), *binary_exprs(self.binary), *one_hot_exprs(narrow),
            *[col(c) for c in wide], *[col(c).cast("double").alias(c) for c in nums],
            *([col(e) for e in self.endpoints] if keep_endpoints else []))
        base = wide_encode(base, wide)
        if self.knn_donors is not None:
            from riskfold.operators.knn import knn_impute
            base = knn_impute(base, nums, k=self.knn_k, key=self.key, donors=self.knn_donors,
                              means={c: self.impute.get(c) for c in nums})
        elif self.iterative_models is not None:
            from riskfold.operators.iterative import apply_iterative
            base = apply_iterative(base, nums, self.iterative_models, self.impute)
        elif self.impute:
            base = apply_columns(base, impute_exprs({c: self.impute[c] for c in nums}))
        return base


def prepare(df: DataFrame, catalog, cfg: PrepConfig | None = None, key: str = "row_id",
            external: DataFrame | None = None) -> Prepared:
    """Fit the whole preparation on ``df`` (training rows).

    Order: drop plan (P1-P4) → sparse rows (P5) → sparse / single-valued /
    correlated columns (P6-P8) → category fill + one-hot (T1-T2) → binary
    recode + zero fill (T3-T4) → impute (T5-T7) → scale (T8-T9).
    """
    from riskfold.operators import columns as C
    from riskfold.operators import filters as FL

    cfg = cfg or PrepConfig()
    df, cat, feats, ends = C.select_columns(df, catalog, cfg.feature_set, cfg.drop_declared, external, key)
    # Fitting makes several aggregate passes over the same rows.
    cached = df = df.persist(StorageLevel.MEMORY_AND_DISK)
    dropped: dict = {}
    row_columns, need = tuple(c for c in df.columns if c != key), 0
    if cfg.drop_missing_value > 0:
        need = FL.min_non_null(len(row_columns), cfg.drop_missing_value)
        df = FL.drop_sparse_rows(df, cfg.drop_missing_value, key)
    if cfg.missing_threshold is not None or cfg.drop_single_unique:
        stats = FL.column_stats(df, feats).collect()
        if cfg.missing_threshold is not None:
            dropped["missing"] = [r["feature"] for r in stats if r["missing_fraction"] > cfg.missing_threshold]
        if cfg.drop_single_unique:
            dropped["single_unique"] = [r["feature"] for r in stats if r["single_value"]]
    gone = {c for v in dropped.values() for c in v}
    nums = [c for c in cat.numerical_features() if c in feats and c not in gone]
    if cfg.correlation_threshold is not None and len(nums) > 1:
        rec = FL.collinear_pairs(FL.correlation_pairs(df, nums), cfg.correlation_threshold)
        dropped["collinear"] = sorted({r[0] for r in rec.select("drop_feature").collect()}, key=nums.index)
        gone |= set(dropped["collinear"])
        nums = [c for c in nums if c not in gone]
    cats = [c for c in cat.categorical_features() if c in feats and c not in gone]
    bins = [c for c in cat.binary_features() if c in feats and c not in gone]
    vocab = fit_vocabulary(df, cats)
    binary = fit_binary(df, bins)
    prep = Prepared(key=key, binary=binary, vocab=vocab, numeric=nums, impute={}, scale={},
                    endpoints=ends, dropped=dropped, knn_k=cfg.knn_k, min_non_null=need, row_columns=row_columns)
    raw = df.select(col(key), *[col(c).cast("double").alias(c) for c in nums])
    if cfg.imputer in ("mean", "median"):
        prep.impute = fit_impute(raw, nums, cfg.imputer)
    elif cfg.imputer == "knn":
        from riskfold.operators.knn import donor_table
        prep.impute = fit_impute(raw, nums, "mean")  # fallback when no donor exists
        prep.knn_donors = donor_table(raw, nums, key)
    elif cfg.imputer == "iterative":
        from riskfold.operators.iterative import fit_iterative
        prep.impute = fit_impute(raw, nums, "mean")
        prep.iterative_models = fit_iterative(raw, nums, prep.impute, cfg.iterative_rounds)
    elif cfg.imputer is not None:
        raise ValueError(f"Imputer type {cfg.imputer} not supported")
    # The imputation runs once: the scale is fitted on its materialised result, and fitted_rows() reads it again.
    prep.imputed = cut_lineage(prep._filled(df))
    if cfg.normaliser not in (None, "none"):
        nums_kept = [c for c in nums if prep.impute.get(c, 0.0) is not None]
        prep.scale = fit_scale(prep.imputed, nums_kept, cfg.normaliser)
    cached.unpersist()  # fitting is done; later transforms recompute from the source
    return prep
