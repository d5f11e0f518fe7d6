"""N-gram Jaccard join with prefix filters under several global token orders.

A text's set holds its distinct shingles.  Under any order of all shingles, two
sets whose Jaccard similarity reaches the threshold share a shingle among the
first ``n - ceil(t * n) + 1`` of each.  Three orders are used.  All put rarer
shingles first, by counts in a fixed number of hash buckets, and break ties by
different hashes.  The first order makes candidates; the prefixes under the other
two must overlap as well, by so much that the rest of the sets can still make up
the threshold, and only then are whole sets compared.

Nothing is quadratic in a group of copies.  Equal sets are one node.  Candidates
of a shared prefix shingle are first only neighbours in size order and pairs with
the group's first member; after their links are merged, a second round compares
across different components only, which completes the result: a pair that is in
no candidate list of either round is linked already or shares no prefix shingle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.llm.common import Words, components, mix64, ship_package, stash, text_chunks, windows

#: Similarity in hundredths, and words of a shingle.
THRESHOLD, SHINGLE = 90, 3
BUCKET_BITS = 20
_RANGES = 16
_SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words than
    ``k`` has its whole word sequence, one without words has none."""
    w = Words(texts)
    h = w.hashes()
    grams, at = windows(w, h, k)
    cut = np.searchsorted(w.doc[at], np.arange(w.rows + 1))
    out = [np.unique(grams[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for i in np.flatnonzero((w.count > 0) & (w.count < k)):
        whole = h[w.first[i]:w.first[i + 1]]
        out[i] = np.array([xxhash.xxh64_intdigest(whole.tobytes(), len(whole))], np.uint64)
    return out


def needed(n, t: int = THRESHOLD):
    """Least number of shared shingles of a set of ``n`` with any partner."""
    return -(-n * t // 100)


def rarity(texts: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """Rarity class of each hash bucket: the bits of its number of (text, shingle)
    pairs.  Tasks send their counts packed by range; the result has a fixed size."""
    size = 1 << BUCKET_BITS
    step = size // _RANGES

    def count(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            for _, part in text_chunks(batch.column(0)):
                grams = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(part, k)])
                seen += np.bincount((grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(_RANGES, dtype=np.int32)),
             pa.array([zlib.compress(seen[i:i + step].tobytes(), 1) for i in range(0, size, step)], pa.binary())], ["r", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(step, np.int64)
        for x in t.column("n"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table({"r": [t.column("r")[0].as_py()], "n": [zlib.compress(np.log2(total + 1).astype(np.uint8).tobytes())]},
                        schema=pa.schema([("r", pa.int32()), ("n", pa.binary())]))

    rows = texts.mapInArrow(count, "r int, n binary").groupBy("r").applyInArrow(add, "r int, n binary").collect()
    out = np.zeros(size, np.uint8)
    for r in rows:
        out[r["r"] * step:(r["r"] + 1) * step] = np.frombuffer(zlib.decompress(bytes(r["n"])), np.uint8)
    return out


def prefixes(grams: np.ndarray, classes: np.ndarray, t: int = THRESHOLD) -> tuple[np.ndarray, list[np.ndarray]]:
    """The prefix of a set, first shingles first: the shingles under the first
    order, and the places (sort keys) of the shingles under each other order."""
    n = len(grams)
    p = n - needed(n, t) + 1 if n else 0
    rare = classes[(grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(57)
    keys = []
    for salt in _SALTS:
        key = rare | (mix64(grams ^ salt) >> np.uint64(7))
        first = np.argpartition(key, p - 1)[:p] if p < n else np.arange(n)
        keys.append((key, first[np.argsort(key[first], kind="stable")]))
    # 32 bits of a place are enough for a filter, and halve what the joins move
    return grams[keys[0][1]], [(key[first] >> np.uint64(32)).astype(np.int32) for key, first in keys[1:]]


def _lists(arrays: list[np.ndarray], kind=np.uint64) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, kind), *arrays])
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64) if kind is np.uint64 else flat))


def describe(texts: DataFrame, kind: str, t: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(id, n, s1, s2, p1, p2, p3) per row: set size, 128-bit hash of the set, prefixes.
    A class is below 64, so sort keys are positive as signed integers too."""
    packed = zlib.compress(rarity(texts.select("text"), k).tobytes())

    def run(batches):
        classes = np.frombuffer(zlib.decompress(packed), np.uint8)
        for batch in batches:
            for at, part in text_chunks(batch.column(1)):
                sets = shingle_sets(part, k)
                sign = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
                first = [prefixes(s, classes, t) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(np.array([len(s) for s in sets], np.int64)),
                     pa.array(sign[:, 0].copy()), pa.array(sign[:, 1].copy()), _lists([f[0] for f in first]), *(_lists([f[1][i] for f in first], np.int32) for i in range(2))],
                    ["id", "n", "s1", "s2", "p1", "p2", "p3"])

    return texts.select("id", "text").mapInArrow(
        run, f"id {kind}, n long, s1 long, s2 long, p1 array<long>, p2 array<int>, p3 array<int>")


def enough(a: str, b: str, an, bn, t: int):
    """Can two sets reach the threshold, given their prefixes under one order?
    Beyond the prefix that ends first, only that set's other shingles can be shared.
    Shortened places may be equal for different shingles: they count as shared, and
    repeated places of one set are added back, so nothing is lost."""
    shared = F.size(F.array_intersect(a, b)) + F.size(a) - F.size(F.array_distinct(a))
    a_end, b_end, a_rest, b_rest = F.element_at(a, -1), F.element_at(b, -1), an - F.size(a), bn - F.size(b)
    rest = F.when(a_end < b_end, a_rest).when(a_end > b_end, b_rest).otherwise(F.greatest(a_rest, b_rest))
    return (shared > 0) & ((shared + rest) * (100 + t) >= t * (an + bn))


def linked(pairs: DataFrame, rows: DataFrame, texts: DataFrame, kind: str, t: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold, of distinct candidate pairs."""
    part = rows.select("id", "n", "p2", "p3")
    both = pairs.join(part.toDF("a", "an", "a2", "a3"), "a").join(part.toDF("b", "bn", "b2", "b3"), "b")
    sizes = F.col("an"), F.col("bn"), t
    close = stash(both.filter(enough("a2", "b2", *sizes) & enough("a3", "b3", *sizes)).select("a", "b"), "close")

    def sets(batches):
        for batch in batches:
            for at, piece in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(piece)), _lists(shingle_sets(piece, k))], ["id", "s"])

    ends = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = stash(texts.join(ends, "id", "left_semi").select("id", "text").mapInArrow(sets, f"id {kind}, s array<long>"), "sets")
    full = close.join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return full.filter(100 * common >= t * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def shared_ids(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of different sets that rows of one id hold."""
    sets = rows.filter((F.col("n") > 0) & F.col("id").isNotNull()).select("id", "s1", "s2")
    both = F.struct("s1", "s2")
    several = sets.groupBy("id").agg(F.min(both).alias("lo"), F.max(both).alias("hi")).filter("lo <> hi").select("id")
    held = stash(sets.join(several, "id", "left_semi").distinct().join(reps, ["s1", "s2"]).select("id", "rep").distinct(), "shared")
    low = held.groupBy("id").agg(F.min("rep").alias("a"))
    return held.join(low, "id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own id where
    there are none.  Null text is empty; empty sets link with nothing.  Rows with a
    null id take no part and have a null component.  Rows that share an id are one
    node, which links by each of its texts.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = stash(describe(texts, kind, t, k), "sets")
    reps = stash(rows.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("s1", "s2").agg(F.min("id").alias("rep")), "reps")
    # each distinct set lists its own prefix, under the smallest id that has it
    own = rows.select("id", "n", "s1", "s2", "p1").join(reps.withColumnRenamed("rep", "id"), ["id", "s1", "s2"], "left_semi") \
        .dropDuplicates(["id", "s1", "s2"])
    same = shared_ids(rows, reps)
    held = own.select("id", "n", F.posexplode("p1").alias("i", "gram"))
    group = Window.partitionBy("gram")
    in_size = group.orderBy("n", "id")
    # shared * (100 + t) >= t * (na + nb) is the threshold on the shared count
    member = held.withColumn("m", F.count("*").over(group)).filter("m > 1")
    member = stash(member.select("gram", "id", "n", "i"), "members")

    def may(an, ai, bn, bi):
        return (F.least(an - ai, bn - bi) * (100 + t) >= t * (an + bn)) & (F.least(an, bn) * 100 >= t * F.greatest(an, bn))

    c = F.col
    near = member.select("id", "n", "i", *[F.lag(x).over(in_size).alias(f"l{x}") for x in ("id", "n", "i")]) \
        .filter(may(c("n"), c("i"), c("ln"), c("li"))).select(c("id").alias("x"), c("lid").alias("y"))
    top = member.groupBy("gram").agg(F.min(F.struct("i", "id", "n")).alias("top"))
    star = member.join(top, "gram").filter(may(c("n"), c("i"), c("top.n"), c("top.i"))) \
        .select(c("id").alias("x"), c("top.id").alias("y"))

    def distinct_pairs(df):
        return df.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    first = stash(linked(distinct_pairs(near.unionByName(star)), rows, texts, kind, t, k), "links")
    first = first.unionByName(same)
    roots = components(first)
    marked = member.join(roots.select(c("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = marked.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("gram")
    open_ = stash(marked.join(mixed, "gram", "left_semi"), "open")
    a, b = open_.alias("a"), open_.alias("b")
    cross = a.join(b, (c("a.gram") == c("b.gram")) & (c("a.id") < c("b.id")) & (c("a.root") != c("b.root"))
                   & may(c("a.n"), c("a.i"), c("b.n"), c("b.i"))).select(c("a.id").alias("x"), c("b.id").alias("y"))
    second = linked(distinct_pairs(cross), rows, texts, kind, t, k)
    final = components(first.unionByName(second))

    known = reps.join(final.select(c("node").alias("rep"), "root"), "rep", "left") \
        .select("s1", "s2", F.coalesce("root", "rep").alias("component_id"))
    return rows.select("id", "n", "s1", "s2").join(known, ["s1", "s2"], "left").select(
        c("id").alias(id_col), c("n").alias("n_shingles"),
        F.when((c("n") > 0) & c("id").isNotNull(), c("component_id")).otherwise(c("id")).alias("component_id"))


def op5_order_filters(docs: DataFrame) -> DataFrame:
    return join(docs)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five-word shingles,
    similarity 0.8) the document with the smallest id stays, with all its rows.
    Documents without words are no near duplicates and stay."""
    gone = join(docs, t=80, k=5).filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
