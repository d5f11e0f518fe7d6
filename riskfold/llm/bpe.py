"""Byte-level BPE with word ends, by a contiguous rank array.

Encoding a text: split off added special tokens, normalise (NFC, white space,
lower case), cut into words, and merge each word's bytes.  The merge of a short
word holds two flat lists, the parts and the rank of each adjacent pair; it scans
for the smallest rank, joins that pair in place, deletes the boundary and
refreshes the two neighbouring ranks.  Words above ``SHORT`` parts use the same
merge order from a heap, so a text of one very long word stays near linear.

White space cuts a text into pieces that are encoded independently of each
other, so each worker remembers the ids of pieces it has met (bounded memory).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from riskfold.llm.common import ship_package, text_chunks

#: Longest word, in parts, that the scanned array handles.
SHORT = 64
#: Remembered pieces per worker; about 200 bytes each.
REMEMBER = 1_200_000
NO_RANK = 1 << 60

#: The white space class of the tokenizer file's engine.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def engine_class(kind: str) -> str:
    """A character class of exactly the code points that the tokenizer's own engine, which
    knows an older Unicode, counts as ``\\p{kind}``: asked once for every code point."""
    split = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True)
    known, own = set(), regex.compile(rf"\p{{{kind}}}")
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 1 << 16):
        for piece, _ in split.pre_tokenize_str("".join(every[at:at + (1 << 16)])):
            known.update(piece)
    spans: list[list[int]] = []
    for c in every:
        if (c in known) != bool(own.match(c)):
            if spans and spans[-1][1] == ord(c) - 1:
                spans[-1][1] += 1
            else:
                spans.append([ord(c), ord(c)])
    listed = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return rf"[\p{{{kind}}}~~[{listed}]]" if listed else rf"\p{{{kind}}}"


@functools.cache
def word_pattern() -> regex.Pattern:
    """Words of the tokenizer file, built once per worker."""
    letter, digit = engine_class("L"), engine_class("N")
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{digit}|[^{_WHITE}{letter}{digit}]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(spare)) for b in range(256)}


@functools.cache
def odd_lower() -> dict[str, str]:
    """Letters that the tokenizer's engine, which knows a newer table of cases, lowers otherwise than Python."""
    lower, out = normalizers.Lowercase(), {}
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 1 << 16):
        part = every[at:at + (1 << 16)]
        for c, low in zip(part, lower.normalize_str("\n".join(part)).split("\n"), strict=True):
            if low != c.replace("Σ", "σ").lower():
                out[c] = low
    return out


def lower_each(text: str) -> str:
    """Lower case letter by letter (a final sigma is like any other)."""
    if not text.isascii() and not odd_lower().keys().isdisjoint(text):
        text = text.translate({ord(c): low for c, low in odd_lower().items()})
    return text.replace("Σ", "σ").lower()


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        self._mark = [a.encode() for a in self.added]
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + end] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token = [""] * size
        for text, i in [*vocab.items(), *self.added.items()]:
            self.token[i] = text
        self.token_bytes = [t.encode() for t in self.token]
        self.digits = [str(i).encode() for i in range(size)]
        self.seen: dict[bytes, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Merge one word's parts in place."""
        if len(parts) > SHORT:
            return self._merge_long(parts)
        find = self.ranks.get
        none = (NO_RANK, 0)
        pairs = [find(p, none) for p in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best[0] == NO_RANK:
                break
            i = pairs.index(best)
            parts[i] = best[1]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = find((parts[i], parts[i + 1]), none)
            if i:
                pairs[i - 1] = find((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, lowest rank and then leftmost first, from a heap over linked parts."""
        n, find = len(parts), self.ranks.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r[0], i, parts[i], parts[i + 1], r[1]) for i in range(n - 1) if (r := find((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = made, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if r := find((made, parts[right[i]])):
                    heapq.heappush(heap, (r[0], i, made, parts[right[i]], r[1]))
            if left[i] >= 0 and (r := find((parts[left[i]], made))):
                heapq.heappush(heap, (r[0], left[i], parts[left[i]], made, r[1]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without any memory of earlier texts."""
        out: list[int] = []
        for part in self._added.split(text) if self._added else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            for word in word_pattern().findall(lower_each(unicodedata.normalize("NFC", part))):
                raw = word.encode()
                parts = [self.inner[b] for b in raw]
                parts[-1] = self.last[raw[-1]]
                out += self.merge(parts)
        return out

    def encode_bytes(self, text: bytes) -> np.ndarray:
        """Ids of one text in UTF-8, piece by piece from memory."""
        pieces, seen = text.split(), self.seen
        try:
            joined = b"".join(map(seen.__getitem__, pieces))
        except KeyError:
            if len(seen) > REMEMBER:
                seen.clear()
            for p in set(pieces).difference(seen):
                seen[p] = np.array(self.encode(p.decode()), np.uint32).tobytes()
            joined = b"".join(map(seen.__getitem__, pieces))
        return np.frombuffer(joined, np.uint32)

    def decode(self, ids) -> str:
        """Token texts joined by one space, special tokens included."""
        return " ".join([self.token[i] for i in ids])


_LOADED: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """The worker's encoder for a file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids_col`` (array of int; an equally named column is replaced).

    Null or empty text has no ids.  Rows are independent, so repeated rows get equal ids.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c != ids_col]

    def run(batches):
        for batch in batches:
            ids = [codec(path).encode_bytes(t or b"") for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            array = pa.ListArray.from_arrays(ends, pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), array], [*kept, ids_col])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text_col])]).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col`` in ``out_col``; null ids give null."""
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c != out_col]

    def run(batches):
        for batch in batches:
            texts = [None if x is None else codec(path).decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out_col])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(out_col, T.StringType())]))


def op2_bpe_codec(docs: DataFrame, path: str) -> DataFrame:
    """Digests of ids and decoded text per document.  Encoding, decoding and
    hashing run block by block, so ids are never held for more than one text.

    Null or empty text has no ids: both digests are that of nothing.  A null id is kept,
    every repeated row is answered, further columns are not read, and an empty table
    gives an empty result."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, part in text_chunks(batch.column(1)):
                tool, n, ids_sha, text_sha = codec(path), [], [], []
                for t in part.cast(pa.binary()).to_pylist():
                    ids = tool.encode_bytes(t or b"").tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(b" ".join([tool.digits[i] for i in ids])).hexdigest())
                    text_sha.append(hashlib.sha256(b" ".join([tool.token_bytes[i] for i in ids])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                     pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
