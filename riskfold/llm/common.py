"""Helpers shared by the operators of this subpackage: table access, written
intermediate tables, vectorised word hashing and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.session import ensure_checkpoint_dir, scratch_path, ship_package

__all__ = ["table", "stash", "text_chunks", "Words", "mix64", "components", "ship_package"]

#: Bytes of text that one vectorised step handles (a longer single text goes alone).
CHUNK_BYTES = 1 << 20
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors, and later readers prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Split a string array into (first row, slice) pieces of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(np.diff(_offsets(texts)))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
        if len(texts) else np.zeros(1, np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        step = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        step[0] = back[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(step), np.cumprod(back)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words (runs without ASCII white space) of a block of texts.

    ``start``/``end``: byte places in ``raw``; ``doc``: row of each word;
    ``count``: words per row; null texts have none.
    """

    def __init__(self, texts: pa.Array):
        off = _offsets(texts)
        data = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        self.raw, self.off, self.rows = raw, off, len(texts)
        solid = ~_IS_WHITE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[off] = True
        before = np.ones(len(raw), bool)
        before[1:] = ~solid[:-1]
        after = np.ones(len(raw), bool)
        after[:-1] = ~solid[1:]
        self.start = np.flatnonzero(solid & (before | edge[:-1]))
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.rows)[:self.rows]
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hash per word (A-Z lower-cased first when ``lower``)."""
        up, down = _powers(len(self.raw))
        raw = _LOWER[self.raw] if lower else self.raw
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=run[1:])
        return mix64((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def windows(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of every run of ``n`` words inside one text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:len(hashes) - n + 1].copy()
    for i in range(1, n):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25)) + hashes[i:len(hashes) - n + 1 + i]
    whole = np.flatnonzero(words.doc[:len(out)] == words.doc[n - 1:])
    return mix64(out[whole]), whole


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): smallest node reachable from every node that has an edge.

    Alternating large-star and small-star rounds; each is one grouped minimum
    and one join on the node, so a node with very many edges is split by the
    skew join and never gathered.  Each round is checkpointed.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct().checkpoint()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        tops = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(tops, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = small.filter("u <> v").distinct().checkpoint()
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
