"""Best-fit packing by sum of squares.

Open sequences are known by their residual gap; ``open[g]`` counts those with gap
``g``.  A piece of length ``s`` goes to the gap whose change makes the sum of
``open[g]**2`` smallest: a gap ``g`` becomes ``g - s``.  Pieces come in order of
falling length, and a new sequence is opened only when no open one has room.

Tokenising is a narrow pass.  Pieces are then dealt by hash into shards of about
``shard_rows`` pieces, and each shard is packed on its own; nothing but lengths
travels, no shard grows with the input, and at 4096 pieces a shard the loss
against the token bound is about 0.1 %.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.bpe import byte_letters, lower_each
from riskfold.llm.common import ship_package, stash, text_chunks

CAPACITY = 2048
SHARD_ROWS = 4096
#: Remembered pieces of text per worker; about 200 bytes each.
REMEMBER = 1_200_000


class PieceIds:
    """Ids of whole texts by a tokenizer file, as little-endian 32-bit bytes.

    White space never joins a token in the word tokenizer, so a text's ids are
    those of its white-space-free pieces in order; pieces met before are
    remembered.  The file lower-cases, so ASCII capitals are folded first (not
    where a special token might be spelt).  A new piece that is one word of
    letters, with or without a tail of ASCII marks, goes straight to the
    library's BPE model if it is still letters after NFC (which splits some letters
    into letter and mark); all others pass through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tool = Tokenizer.from_file(path)
        self.model = self.tool.model
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.seen: dict[bytes, bytes] = {}

    def _word(self, word: str) -> bytes:
        """Ids of letters only; the model wants the bytes' printable letters."""
        if not word.isascii():
            word = lower_each(unicodedata.normalize("NFC", word)).encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tool.encode(piece, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: set[bytes]) -> None:
        seen = self.seen
        for p in new:
            text = p.decode()
            base = text.rstrip(_MARKS)
            if not (base.isalpha() and base.islower() if base.isascii() else _stays_letters(base)):
                seen[p] = self._whole(text)
                continue
            key = base.encode()
            ids = seen.get(key)
            if ids is None:
                ids = seen[key] = self._word(base)
            if len(base) < len(text):
                tail = p[len(key):]
                if tail not in seen:
                    seen[tail] = self._whole(text[len(base):])
                seen[p] = ids + seen[tail]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        pieces = [(t if b"<|" in t else t.lower()).split() for t in texts]
        new: set[bytes] = set()
        for p in pieces:
            new.update(p)
        self._learn(new.difference(self.seen))
        find = self.seen.__getitem__
        return [b"".join(map(find, p)) for p in pieces]


def _stays_letters(word: str) -> bool:
    """Is the word letters only, and still so as the tokenizer normalises it?"""
    return word.isalpha() and word.lower().isalpha() and lower_each(unicodedata.normalize("NFC", word)).isalpha()


#: ASCII characters that are neither letters, digits nor white space.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOADED: dict[str, PieceIds] = {}


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids followed by ``end_id``,
    cut into pieces of ``capacity`` ids; null and empty texts are the end id alone."""
    ship_package(docs.sparkSession)
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches):
        if path not in _LOADED:
            _LOADED[path] = PieceIds(path)
        tool, width = _LOADED[path], 4 * capacity
        for batch in batches:
            for at, part in text_chunks(batch.column(1)):
                texts = [t or b"" for t in part.cast(pa.binary()).to_pylist()]
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(tool.ids(texts)):
                    raw = ids + end
                    for k, b in enumerate(range(0, len(raw), width)):
                        cut = raw[b:b + width]
                        row.append(i)
                        piece.append(k)
                        length.append(len(cut) >> 2)
                        crc.append(zlib.crc32(cut))
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)).take(pa.array(row, pa.int64())), pa.array(piece),
                     pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces given in placing order."""
    count = np.zeros(capacity + 1, np.int64)
    where: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    never = np.int64(1) << 40
    for i, s in enumerate(lengths.tolist()):
        fits = count[s:] > 0                        # index: gap that stays
        if s < capacity and fits.any():
            change = 2 * (count[:capacity - s + 1] - count[s:]) + 2
            change[0] = 1 - 2 * count[s]            # the sequence gets full and is no longer open
            left = int(np.where(fits, change, never).argmin())
            gap = left + s
            seq = where[gap].pop()
            count[gap] -= 1
        else:
            gap, seq = capacity, opened
            opened += 1
        sequence[i], offset[i], gap = seq, capacity - gap, gap - s
        if gap:
            count[gap] += 1
            where[gap].append(seq)
    return sequence, offset


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    Equal lengths are placed in order of id and piece, so the result does not
    depend on how rows arrive.  No rows give no rows.
    """
    ship_package(pieces.sparkSession)
    shards = max(1, round(pieces.count() / shard_rows))
    cols = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = place(rows["length"].to_numpy(np.int64), capacity)
        return rows.assign(sequence_id=(rows["shard"].to_numpy(np.int64) << 32) + sequence, offset=offset)[
            [*cols, "sequence_id", "offset"]]

    kind = pieces.schema[id_col].dataType.simpleString()
    return pieces.select(*cols, F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(shards)).alias("shard")) \
        .groupBy("shard").applyInPandas(
            run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_squares_packing(docs: DataFrame, path: str) -> DataFrame:
    return pack(stash(token_pieces(docs, path), "pieces"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are left, as pieces in sequences."""
    import public_tokenizers
    return op1_squares_packing(docs, public_tokenizers.path("word_bpe_49k.json"))
