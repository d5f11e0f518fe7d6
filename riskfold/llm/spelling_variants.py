"""Spelling variants by Bloom-guided neighbourhoods.

Every word of the vocabulary generates the strings at one edit from it and probes
them against blocked Bloom filters of the vocabulary, one shard per word length.
Only positives are shuffled to an exact join with the vocabulary, which removes
the false ones.  An insertion is the other word's deletion and a replacement is
its own inverse, so deletions and replacements by greater code points find every
pair once.

Filters are built where Spark grouped the words.  A length with many words is cut
into pieces of about ``PIECE_WORDS``, and as many pieces as fit ``PASS_BYTES`` are
broadcast at a time, so what a broadcast holds is bounded while the number of
passes follows the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import mix64, ship_package, stash

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
BITS_PER_WORD = 16
PIECE_WORDS = 1 << 19          # expected words of one filter piece (1 MB of bits)
PASS_BYTES = 64 << 20          # bytes of filters that one broadcast holds
TALLY_WORDS = 200_000          # distinct words a task counts before it hands them on
EDIT_CELLS = 1 << 20           # edits that are hashed at once

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


# -- words ---------------------------------------------------------------------------


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3,
                damage: int | None = None) -> DataFrame:
    """(word, n): letter runs with A-Z lower-cased, of at least ``min_chars`` code
    points, found at least ``min_count`` times over all whole texts.

    With ``damage``, a run whose crc32 of ``<id>:<run>`` it divides loses one code
    point first.  Null and empty texts hold no words; a null id counts as an empty
    one; every repeated row counts.
    """
    ship_package(docs.sparkSession)

    def flush(tally):
        return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])

    def run(batches):
        tally: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                head = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                for word, n in Counter(RUNS.findall(text.encode().lower().decode())).items():
                    if len(word) < min_chars:
                        continue
                    if damage:
                        h = zlib.crc32(word.encode(), head)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < min_chars:
                                continue
                    tally[word] += n
                if len(tally) > TALLY_WORDS:
                    yield flush(tally)
                    tally.clear()
        if tally:
            yield flush(tally)

    seen = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# -- filters -------------------------------------------------------------------------


def code_points(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    out = np.full(length + 1, _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash before mixing: a polynomial in the code points, so that an edit changes it by one term or a shift."""
    return (codes * _powers(codes.shape[1])[:codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def spread(raw: np.ndarray, length: int) -> np.ndarray:
    return mix64(raw + np.uint64(length * 0x632BE59BD9B4E019 % (1 << 64)))


class BlockedBloom:
    """Bloom filter whose key sets six bits inside one block of 512."""

    def __init__(self, blocks: int, bits: np.ndarray | None = None):
        self.blocks = blocks
        self.bits = np.zeros(blocks * 8, np.uint64) if bits is None else bits

    @staticmethod
    def of(hashes: np.ndarray) -> "BlockedBloom":
        out = BlockedBloom(max(1, -(-len(hashes) * BITS_PER_WORD // 512)))
        for cell, bit in out._places(hashes):
            np.bitwise_or.at(out.bits, cell, bit)
        return out

    def _places(self, hashes):
        base = ((hashes >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)) * np.uint64(8)
        inner = mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93))
        for j in range(6):
            place = (inner >> np.uint64(9 * j)) & np.uint64(511)
            yield (base + (place >> np.uint64(6))).astype(np.int64), np.uint64(1) << (place & np.uint64(63))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        left = np.arange(len(hashes))
        for j in range(6):
            own = hashes[left]
            base = ((own >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)) * np.uint64(8)
            place = (mix64(own ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(9 * j)) & np.uint64(511)
            cell = self.bits[(base + (place >> np.uint64(6))).astype(np.int64)]
            left = left[(cell >> (place & np.uint64(63))) & np.uint64(1) == 1]
            if not len(left):
                break
        out = np.zeros(len(hashes), bool)
        out[left] = True
        return out


def piece_of(hashes: np.ndarray, pieces: int) -> np.ndarray:
    return (mix64(hashes + np.uint64(0xA0761D6478BD642F)) % np.uint64(pieces)).astype(np.int64)


def build_filters(words: DataFrame, pieces: dict[int, int]) -> DataFrame:
    """(length, piece, blocks, bits): one filter per piece; a task holds the hashes of one piece."""
    def hashed(batches):
        for batch in batches:
            by: dict[int, list[str]] = {}
            for w in batch.column(0).to_pylist():
                by.setdefault(len(w), []).append(w)
            for length, some in by.items():
                h = spread(word_hashes(code_points(some, length)), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), length, np.int32)), pa.array(piece_of(h, pieces[length]).astype(np.int32)),
                     pa.array(h.view(np.int64))], ["length", "piece", "h"])

    def built(key, pdf):
        f = BlockedBloom.of(pdf["h"].to_numpy().astype(np.int64).view(np.uint64))
        return pd.DataFrame({"length": [key[0]], "piece": [key[1]], "blocks": [f.blocks], "bits": [f.bits.tobytes()]})

    return words.select("word").mapInArrow(hashed, "length int, piece int, h long") \
        .groupBy("length", "piece").applyInPandas(built, "length int, piece int, blocks long, bits binary")


# -- neighbourhoods --------------------------------------------------------------------


def _positive(filters: dict, pieces: dict[int, int], hashes: np.ndarray, length: int) -> np.ndarray:
    """Places of ``hashes`` that a filter of this pass holds."""
    n = pieces.get(length, 0)
    if not n:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.flatnonzero(filters[length, 0].holds(hashes)) if (length, 0) in filters else np.zeros(0, np.int64)
    part, found = piece_of(hashes, n), []
    for p in range(n):
        if (length, p) in filters:
            at = np.flatnonzero(part == p)
            found.append(at[filters[length, p].holds(hashes[at])])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def probe(words: list[str], length: int, alphabet: np.ndarray, filters: dict, pieces: dict[int, int]):
    """(row, edited string) of the words' deletions and replacements that the filters hold."""
    codes = code_points(words, length)
    power, raw = _powers(length), word_hashes(codes)
    if pieces.get(length - 1) and length > 1:
        ahead = np.cumsum(codes * power[:length], axis=1, dtype=np.uint64)
        before = ahead - codes * power[:length]
        cut = spread(before + (raw[:, None] - ahead) * _BACK, length - 1)
        fresh = np.ones(codes.shape, bool)                   # of equal neighbours only the first is deleted
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, at = np.nonzero(fresh)
        for k in _positive(filters, pieces, cut[row, at], length - 1):
            w = words[row[k]]
            yield int(row[k]), w[:at[k]] + w[at[k] + 1:]
    if pieces.get(length):
        step = max(1, EDIT_CELLS // max(1, len(words) * len(alphabet)))
        for low in range(0, length, step):
            part = codes[:, low:low + step]
            row, at, c = np.nonzero(alphabet[None, None, :] > part[:, :, None])
            at = at + low
            h = spread(raw[row] + (alphabet[c] - codes[row, at]) * power[at], length)
            for k in _positive(filters, pieces, h, length):
                w, i = words[row[k]], at[k]
                yield int(row[k]), w[:i] + chr(int(alphabet[c[k]])) + w[i + 1:]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of vocabulary words one edit apart, once.  ``words``: distinct (word, n)."""
    spark = words.sparkSession
    ship_package(spark)
    sizes = {r[0]: r[1] for r in words.groupBy(F.char_length("word")).count().collect()}
    pieces = {length: -(-n // PIECE_WORDS) for length, n in sizes.items()}
    letters = [r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r[0]]
    alphabet = np.array(sorted(map(ord, letters)), np.uint64)
    built = stash(build_filters(words, pieces), "filters")

    groups, room = [[]], PASS_BYTES
    for length in sorted(pieces):
        for p in range(pieces[length]):
            need = 64 * (sizes[length] // pieces[length] * BITS_PER_WORD // 512 + 1)
            if need > room and groups[-1]:
                groups.append([])
                room = PASS_BYTES
            groups[-1].append((length, p))
            room -= need

    def probing(held):
        def run(batches):
            filters = held.value
            for batch in batches:
                by: dict[int, list[int]] = {}
                texts, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, w in enumerate(texts):
                    by.setdefault(len(w), []).append(i)
                for length, rows in by.items():
                    step = max(1, EDIT_CELLS // max(1, length * len(alphabet)))
                    for low in range(0, len(rows), step):
                        some = rows[low:low + step]
                        hits = list(probe([texts[i] for i in some], length, alphabet, filters, pieces))
                        if hits:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([texts[some[r]] for r, _ in hits], pa.string()), pa.array([counts[some[r]] for r, _ in hits], pa.int64()),
                                 pa.array([s for _, s in hits], pa.string())], ["a", "n_a", "edit"])
        return run

    found = None
    for group in groups:
        if not group:
            continue
        low, high = group[0], group[-1]
        rows = built.filter((F.struct("length", "piece") >= F.struct(F.lit(low[0]), F.lit(low[1])))
                            & (F.struct("length", "piece") <= F.struct(F.lit(high[0]), F.lit(high[1])))).collect()
        held = spark.sparkContext.broadcast(
            {(r["length"], r["piece"]): BlockedBloom(r["blocks"], np.frombuffer(bytes(r["bits"]), np.uint64)) for r in rows})
        own = words.filter(F.char_length("word").between(low[0], high[0] + 1)).select("word", "n")
        hits = stash(own.mapInArrow(probing(held), "a string, n_a long, edit string"), "edits")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "a string, n_a long, edit string")
    known = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    return found.join(known, found["edit"] == known["b"]).select("a", "n_a", "b", "n_b")


# -- forms and roots ---------------------------------------------------------------------


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last by pointer jumping;
    a form is more frequent than its word by a factor above one, so there is no cycle
    and the rounds are few."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        a, b = now.alias("a"), now.alias("b")
        now = stash(a.join(b, F.col("a.root") == F.col("b.word"), "left").select(
            F.col("a.word").alias("word"), F.coalesce("b.root", "a.root").alias("root"),
            F.col("b.root").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variant_groups(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words.

    Words one edit (code point inserted, deleted or replaced) apart are near.  The form
    is the near word of largest n, ties to the smallest in code-point order, if its n is
    at least ``factor`` (over 1) times the word's; the root ends the chain of forms.  A null
    word is no word; an empty table gives an empty result.
    """
    if factor <= 1:
        raise ValueError("a form must be more frequent than its word")
    words = stash(words.filter("word IS NOT NULL").select("word", "n"), "vocabulary")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p"))
    best = both.select("p.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near"))).alias("top"), F.max("n").alias("n"))
    enough = -F.col("top.neg") >= factor * F.col("n")
    near = stash(best.select("word", "n_near", F.when(enough, F.col("top.near")).alias("form"),
                             F.when(enough, -F.col("top.neg")).alias("form_n")), "near")
    roots = follow(near.filter("form IS NOT NULL").select("word", "form"))
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_bloom_neighbours(docs: DataFrame) -> DataFrame:
    return variant_groups(word_counts(docs, damage=97))
