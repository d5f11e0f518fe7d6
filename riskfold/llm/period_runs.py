"""Periodic runs of words by tiles per period octave.

A run is a stretch of words with smallest period q, at least ``max(min_words, 2q)``
long, that no neighbouring word extends.  Periods are split into octaves; for each
octave a document is exploded into overlapping tiles with boundaries closer
together than its smallest period, so every run holds a boundary with a whole
period behind it.  A tile is solved alone: Z-functions to the right and to the left
of a boundary give, for each period of the octave, the stretch around the boundary.
Fragments are shuffled by (document, period) and those that overlap by a period are
stitched; of equal stretches the smallest period stays.

A run's first six words recur after exactly its period, so tiles are made only
around boundaries behind such a recurrence inside the octave; others hold no run.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskfold.llm.common import mix64, ship_package, stash

MIN_WORDS = 12
GRAM = MIN_WORDS // 2      # a run's first GRAM words recur after its period
TILE = 2048                # boundaries of one tile span at least so many words
EMPTY = hashlib.sha256(b"").hexdigest()


def octaves(n: int):
    """(smallest period, end of periods, distance of boundaries) for a text of ``n`` words."""
    low, high, step = 1, 8, 4
    while low <= n // 2:
        yield low, high, step
        low, high, step = high, high * 2, high


def active_tiles(ids: np.ndarray) -> list[dict]:
    """Tiles ``(low, high, first, bounds, ids)`` of the octaves and places that may hold a run; ``bounds`` count from ``first``."""
    n = len(ids)
    if n < MIN_WORDS:
        return []
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for i in range(GRAM):
        gram = mix64(gram + ids[i:n - GRAM + 1 + i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(gram, kind="stable")
    again = gram[order[1:]] == gram[order[:-1]]
    if not again.any():
        return []
    # positions of grams that recur, as sorted keys (gram number, position)
    number = np.concatenate([[0], np.cumsum(~again)])
    repeated = np.concatenate([again, [False]]) | np.concatenate([[False], again])
    place, key = order[repeated].astype(np.int64), number[repeated].astype(np.int64) * (n + 1) + order[repeated]
    out = []
    for low, high, step in octaves(n):
        nxt = np.searchsorted(key, key + low)
        hit = (nxt < len(key)) & (key[np.minimum(nxt, len(key) - 1)] < key + high)
        hit &= key[np.minimum(nxt, len(key) - 1)] - key + place < n      # the same gram's place, not the next gram's
        if not hit.any():
            continue
        bounds = np.unique(-(-place[hit] // step) * step)
        span = max(TILE, 8 * step)
        for part in np.split(bounds, np.flatnonzero(np.diff(bounds // span)) + 1):
            first = max(0, int(part[0]) - high)
            out.append({"low": low, "high": high, "first": first, "bounds": (part - first).astype(np.uint32).tobytes(),
                        "ids": ids[first:int(part[-1]) + 2 * high + 8].astype(np.uint32).tobytes()})
    return out


def z_function(s: list) -> list[int]:
    """Length of the longest common prefix of ``s`` and each of its suffixes."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(ids: list[int], bounds: list[int], low: int, high: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of stretches with a period of [low, high) around the boundaries, inside the tile."""
    held: dict[int, list[int]] = {}
    out = []
    for c in bounds:
        ahead = z_function(ids[c:c + 2 * high + 8])
        left = min(high, c)
        right = min(high, len(ids) - c)
        mirror = ids[c - left:c + right][::-1]
        behind = z_function([*ids[c - left:c][::-1], -1, *mirror]) if left else None
        for q in range(low, min(high, right + 1, len(ahead))):
            f = ahead[q]
            b = behind[left + 1 + right - q] if left else 0
            if f + b >= q:
                start, end = c - b, c + q + f
                last = held.get(q)
                if last and start <= last[1] - q:
                    last[1] = max(last[1], end)
                else:
                    if last:
                        out.append((q, *last))
                    held[q] = [start, end]
    return out + [(q, *span) for q, span in held.items()]


def _solve(batches):
    for batch in batches:
        uid, period, start, end = [], [], [], []
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.uint32).tolist()
            bounds = np.frombuffer(r["bounds"], np.uint32).tolist()
            for q, s, e in solve_tile(ids, bounds, r["low"], r["high"]):
                uid.append(r["uid"])
                period.append(q)
                start.append(r["first"] + s)
                end.append(r["first"] + e)
        if uid:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid, period, start, end)],
                                             ["uid", "period", "start", "end"])


def stitch(fragments: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(uid, start, end, period): whole runs of (uid, period, start, end) fragments."""
    by = Window.partitionBy("uid", "period").orderBy("start", "end")
    f = fragments.withColumn("reach", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    f = f.withColumn("island", F.sum(F.when(F.col("start") + F.col("period") > F.col("reach"), 1).otherwise(0)).over(
        by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = f.groupBy("uid", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.filter(F.col("end") - F.col("start") >= F.greatest(F.lit(min_words).cast("long"), 2 * F.col("period")))
    return whole.groupBy("uid", "start", "end").agg(F.min("period").alias("period"))


def split_words(doc, text, rewrite=None) -> list[bytes]:
    words = (text or "").encode().split()     # bytes split at 20, 09-0D only
    return rewrite(doc, words) if rewrite and words and doc is not None else words


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite=None) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, period, length>> by start and period, collapsed_sha256).

    Words are runs without ASCII white space, numbered from 0; ``rewrite(id, words)`` may
    change them first (not where the id is null).  Null, empty and blank texts have no
    words, no runs and the digest of nothing.  Every row is answered by itself, repeated
    rows alike; further columns are not read.  ``collapsed_sha256`` is the digest of the
    words outside every run's part behind its first period, joined by one space.
    """
    ship_package(docs.sparkSession)
    tile = pa.struct([("low", pa.int32()), ("high", pa.int32()), ("first", pa.int64()), ("bounds", pa.binary()), ("ids", pa.binary())])

    def prepare(batches):
        for batch in batches:
            rows, load = [], 0
            for uid, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = split_words(doc, text, rewrite)
                known: dict[bytes, int] = {}
                tiles = active_tiles(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
                joined = b" ".join(words)
                rows.append((uid, doc, len(words), joined if tiles else None, None if tiles else hashlib.sha256(joined).hexdigest(), tiles))
                load += len(joined) + sum(len(t["ids"]) for t in tiles) if tiles else 0
                if load > 1 << 22:
                    yield block(rows)
                    rows, load = [], 0
            if rows:
                yield block(rows)

    def block(rows):
        uid, doc, n, words, sha, tiles = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(uid, pa.int64()), pa.array(doc), pa.array(n, pa.int64()), pa.array(words, pa.binary()),
             pa.array(sha, pa.string()), pa.array(tiles, pa.list_(tile))], ["uid", "doc_id", "n_words", "words", "sha", "tiles"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`"))
    ready = stash(own.mapInArrow(
        prepare, f"uid long, doc_id {kind}, n_words long, words binary, sha string, "
                 "tiles array<struct<low: int, high: int, first: long, bounds: binary, ids: binary>>"), "tiles")
    tiles = ready.filter("words IS NOT NULL").select("uid", F.explode("tiles").alias("t")).select("uid", "t.*") \
        .repartition("uid", "low", "first")
    fragments = tiles.mapInArrow(_solve, "uid long, period long, start long, end long")
    runs = stitch(fragments).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(
        "start", "period", (F.col("end") - F.col("start")).alias("length")))).alias("runs"))

    def collapse(batches):
        for batch in batches:
            sha = []
            for words, found in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = words.split()
                cover = np.zeros(len(words) + 1, np.int64)
                for r in found or []:
                    cover[r["start"] + r["period"]] += 1
                    cover[r["start"] + r["length"]] -= 1
                gone = np.cumsum(cover)
                sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone) if not g])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_words", "runs")] + [pa.array(sha, pa.string())],
                                             ["doc_id", "n_words", "runs", "collapsed_sha256"])

    shape = "array<struct<start: long, period: long, length: long>>"
    with_tiles = ready.filter("words IS NOT NULL").join(runs, "uid", "left").select("doc_id", "n_words", "words", "runs") \
        .mapInArrow(collapse, f"doc_id {kind}, n_words long, runs {shape}, collapsed_sha256 string")
    without = ready.filter("words IS NULL").select("doc_id", "n_words", F.lit(None).cast(shape).alias("runs"),
                                                   F.col("sha").alias("collapsed_sha256"))
    return without.unionByName(with_tiles).withColumn("runs", F.coalesce("runs", F.array().cast(shape)))


def planted_tail(doc, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: in documents whose crc32 ends in 0 the tail repeats its first words."""
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a:a + p]
    return words[:a] + (piece * -(-(n - a) // p))[:n - a]


def op12_tiled_periods(docs: DataFrame) -> DataFrame:
    """Digests of :func:`periodic_runs` on the rewritten documents; a null id leaves its text as it is."""
    out = periodic_runs(docs, rewrite=planted_tail)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    ranked = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("neg"), r["start"].alias("start"), r["period"].alias("period"))))
    top = F.try_element_at(ranked, F.lit(1))
    return out.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.neg")).alias("length"),
        F.col("top.period").alias("period"), F.floor(-F.col("top.neg") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")
