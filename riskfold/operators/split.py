"""Deterministic stratified resampling.

Row order inside a class is ``md5(row_id|seed|salt)``: reproducible on
recompute (unlike ``rand()``) and identical in other engines.  A plain
``row_number() over (partition by class)`` would put a whole class in one
task, so ranks are computed in two levels: counts per (class, md5-prefix
bucket) give bucket offsets (a table of at most classes x buckets rows),
then rows are numbered inside (class, bucket) and shifted by the offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.functions.exprs import col
from riskfold.operators.ranges import value_bucket
from riskfold.session import cut_lineage

BUCKET_HEX = 3  # 4096 buckets per class
SORTED = 1 << 19  # rows (expected) that a task of the fold table sorts


def _order_key(key: str, *salt) -> F.Column:
    return F.md5(F.concat_ws("|", col(key).cast("string"), *[F.lit(str(s)) for s in salt]))


def ranked(df: DataFrame, by, order: F.Column, name: str = "rn", bucket_hex: int = BUCKET_HEX) -> DataFrame:
    """``row_number() over (partition by by order by order)`` in two levels.

    ``order`` must be a hex digest string (its prefix is the bucket)."""
    d = df.withColumn("_h", order)
    return two_level_rank(d.withColumn("_b", F.substring("_h", 1, bucket_hex)), by, name).drop("_h")


def two_level_rank(df: DataFrame, by, name: str) -> DataFrame:
    """Rank by ``_h`` inside ``by``, given a bucket ``_b`` that is monotone in ``_h``."""
    by = list(by)
    counts = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.partitionBy(*by).orderBy("_b")
                                               .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy(*by, "_b").orderBy("_h")
    # The offset table has at most (classes x buckets) rows; AQE turns
    # this join into a broadcast at runtime when it is small.
    out = (df.join(offs.select(*by, "_b", "_off"), [*by, "_b"], "left")
           .withColumn(name, (F.col("_off") + F.row_number().over(inner)).cast("long")))
    return out.drop("_b", "_off")


def class_counts(df: DataFrame, label: str, by=()) -> DataFrame:
    return df.groupBy(*by, col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))


def stratified_kfold(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "row_id") -> DataFrame:
    """``(row_id, y, fold)``; each class dealt round-robin over the folds
    in md5 order, so fold sizes per class differ by at most one."""
    d = df.filter(col(label).isNotNull()).select(col(key).alias(key), col(label).alias("y"))
    r = ranked(d, ["y"], _order_key(key, seed))
    return r.select(key, "y", ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def stratified_shuffle(df: DataFrame, label: str, n_splits: int = 5, test_fraction: float = 0.2,
                       seed: int = 42, key: str = "row_id") -> DataFrame:
    """R2: ``(row_id, y, split, role)``: for every split an independent md5
    draw per class; the first ``round(test_fraction * n_class)`` rows are test.
    Class sizes come from a grouped count joined back (no window over a class)."""
    d = df.filter(col(label).isNotNull()).select(col(key).alias(key), col(label).alias("y"))
    # Each row appears once per split: that replication is the split table itself.
    x = d.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    r = ranked(x, ["split", "y"], F.md5(F.concat_ws("|", col(key).cast("string"), F.lit(str(seed)),
                                                     F.col("split").cast("string"))))
    cnt = d.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    return (r.join(cnt, "y")
            .select(key, "y", "split",
                    F.when(F.col("rn") <= F.round(F.lit(test_fraction) * F.col("_n")), "test")
                    .otherwise("train").alias("role")))


def train_test_split(df: DataFrame, label: str, test_fraction: float = 0.2, seed: int = 42,
                     key: str = "row_id") -> DataFrame:
    """One stratified draw: ``(row_id, y, role)``."""
    return stratified_shuffle(df, label, 1, test_fraction, seed, key).drop("split")


def holdout_split(df: DataFrame, fraction: float = 0.15, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Plain (unstratified) md5 hold-out: ``(row_id, role)`` with role
    ``valid`` for the first ``round(fraction * n)`` rows."""
    d = df.select(col(key).alias(key), F.lit(0).alias("_all"))
    r = ranked(d, ["_all"], _order_key(key, seed, "holdout"))
    n = df.count()
    return r.select(key, F.when(F.col("rn") <= F.round(F.lit(fraction) * F.lit(n)), "valid")
                    .otherwise("train").alias("role"))


def loo_folds(df: DataFrame, key: str = "row_id", max_rows: int | None = None) -> DataFrame:
    """Leave-one-out: one fold per row, numbered in key order.

    The fold table itself scales; ``max_rows`` guards callers that go on to
    fit one model per fold."""
    if max_rows is not None:
        n = df.count()
        if n > max_rows:
            raise ValueError(f"leave-one-out over {n} rows exceeds max_rows={max_rows}")
    # Buckets of nearly equal size between quantiles of the key, so that no task numbers more than one of them.
    d = df.select(col(key).alias(key), col(key).alias("_h"), F.lit(0).alias("_all"))
    r = two_level_rank(value_bucket(d, "_h", "_b"), ["_all"], "rn").drop("_h")
    return r.select(key, (F.col("rn") - 1).alias("fold"))


def nested_fold_plan(df: DataFrame, endpoints, seeds=(42,), n_outer: int = 5, n_inner: int = 5,
                     test_fraction: float = 0.2, key: str = "row_id") -> DataFrame:
    """One fold table ``(row_id, endpoint, seed, outer, role, inner)``.

    Outer: stratified shuffle-split per (endpoint, seed); inner: stratified
    k-fold over the outer training rows (inner is NULL for test rows)."""
    from riskfold.functions.exprs import unpivot

    # Each rank reads its input twice (bucket counts, rows): checkpointed once, the cohort is scanned once.
    lab = cut_lineage(unpivot(df, [key], list(endpoints), "endpoint", "y", cast="string").filter(F.col("y").isNotNull()))
    spark, splits = df.sparkSession, [(int(s), int(o)) for s in seeds for o in range(n_outer)]
    found = lab.groupBy("endpoint", "y").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_t", F.round(F.lit(test_fraction) * F.col("_n"))).orderBy("endpoint", "y").collect()      # a row per class
    kinds = list(dict.fromkeys(splits)) or [(0, 0)]
    classes = [(r["endpoint"], r["y"]) for r in found] or [("", "")]
    # A row of a split is its key and one number, split * classes + class: what a shuffle carries of it.
    size = len(classes)
    numbered = F.broadcast(spark.createDataFrame([(*c, i) for i, c in enumerate(classes)], "endpoint string, y string, _c int"))
    every = F.array(*[F.lit(kinds.index(k)) for k in splits]).cast("array<int>")
    x = lab.join(numbered, ["endpoint", "y"]).select(key, "_c", F.explode(every).alias("_s")).select(key, (F.col("_s") * size + F.col("_c")).alias("_g"))
    wanted = spark.createDataFrame([(k * size + c, float(r["_t"])) for k in range(len(kinds)) for c, r in enumerate(found)], "_g int, _t double")

    def split(values, kind):
        return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.floor(F.col("_g") / size).cast("int") + 1)

    def of_class(values):
        return F.element_at(F.array(*map(F.lit, values)).cast("array<string>"), F.col("_g") % size + 1)

    salt = [col(key).cast("string"), split([f"{s}|{o}" for s, o in kinds], "string")]
    o = _first_ranks(x.withColumn("_h", F.md5(F.concat_ws("|", *salt))), ["_g"], wanted, ["_g"])
    digest = F.md5(F.concat_ws("|", *salt, F.lit("inner")))
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-sum(r["_n"] for r in found) * len(splits) // SORTED))
    train = o.filter(F.col("role") == "train").select(
        key, "_g", F.conv(F.substring(digest, 1, BUCKET_HEX), 16, 10).cast("int").alias("_b"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = train.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_cnt")).select("_g", "_b", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    rank = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h"))
    dealt = train.repartition(parts, "_g", "_b").withColumn("_h", digest)       # the digest is made again behind the shuffle
    inner = dealt.withColumn("_rn", rank).drop("_h").join(offs, ["_g", "_b"], "left").select(
        key, "_g", F.lit("train").alias("role"), ((F.col("_off") + F.col("_rn") - 1) % n_inner).cast("int").alias("inner_fold"))
    out = inner.unionByName(o.filter(F.col("role") == "test").select(key, "_g", "role", F.lit(None).cast("int").alias("inner_fold")))
    return out.select(key, of_class([e for e, _ in classes]).alias("endpoint"), split([s for s, _ in kinds], "int").alias("seed"),
                      split([o for _, o in kinds], "int").alias("outer_fold"), of_class([y for _, y in classes]).alias("y"), "role", "inner_fold")


def _first_ranks(x: DataFrame, group, wanted: DataFrame, on, bucket_hex: int = BUCKET_HEX) -> DataFrame:
    """Add ``role``: test for the first ``_t`` rows of a group in order of the hex digest ``_h``, else train.

    The bucket counts say in which bucket a group's ``_t``-th row lies.  Rows of other
    buckets are decided by their bucket alone; only those of that one are ranked, so
    the rows themselves are neither sorted nor shuffled."""
    group = list(group)
    x = x.withColumn("_b", F.substring("_h", 1, bucket_hex))
    counts = x.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    up_to = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.withColumn("_up", F.sum("_cnt").over(up_to)).join(wanted, list(on))
    # the bucket of the last test row, and how many of its rows are test; a group without test rows has none
    edge = (sums.filter((F.col("_up") >= F.col("_t")) & (F.col("_up") - F.col("_cnt") < F.col("_t")))
            .select(*group, F.col("_b").alias("_eb"), (F.col("_t") - F.col("_up") + F.col("_cnt")).alias("_left")))
    at = x.join(F.broadcast(edge), group, "left")       # one row per group
    sure = at.filter(F.col("_eb").isNull() | (F.col("_b") != F.col("_eb"))).withColumn(
        "role", F.when(F.col("_b") < F.col("_eb"), "test").otherwise("train"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_h"))
    split = at.filter(F.col("_b") == F.col("_eb")).withColumn("_rk", rank).withColumn(
        "role", F.when(F.col("_rk") <= F.col("_left"), "test").otherwise("train")).drop("_rk")
    return sure.unionByName(split).drop("_h", "_b", "_eb", "_left")


def split_sizes(plan: DataFrame, by=("endpoint", "seed", "outer_fold")) -> DataFrame:
    """Rows and share per role."""
    by = list(by)
    g = plan.groupBy(*by, "role").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
