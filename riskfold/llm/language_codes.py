"""Language identification by error-correcting output codes.

Each language has a codeword; one linear classifier per bit reads hashed byte
n-grams of the whole text.  Decoding sums, for every language, the logistic loss
of its codeword against the classifiers' margins, weighted by how reliable each
bit was in training; the nearest codeword wins.  A text whose two nearest
codewords are close is flagged ambiguous.

Training reads a bounded sample: about ``PER_LANGUAGE`` labelled texts of each
language, those with the smallest hash of the id.  Prediction is one narrow pass.
"""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import _offsets, ship_package, text_chunks

PER_LANGUAGE = 600
BUCKETS = 4096
#: Probability lead of the nearest codeword below which a text counts as ambiguous.
AMBIGUOUS = 0.05
#: Texts per dense block of features.
BLOCK = 1000
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)               # all but letters and bytes above 127 become a space
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(texts: pa.Array) -> np.ndarray:
    """Per text, the root of the share of each hashed byte bigram and trigram."""
    off = _offsets(texts)
    data = texts.buffers()[2] if len(texts) else None
    raw = _FOLD[np.frombuffer(data, np.uint8)[off[0]:off[-1]]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    out = np.zeros((len(texts), BUCKETS), np.float32)
    if len(raw) < 3:
        return out
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    x = raw.astype(np.uint32)
    for n, gram in ((2, x[:-1] << 8 | x[1:]), (3, x[:-2] << 16 | x[1:-1] << 8 | x[2:])):
        first = doc[:len(gram)]
        whole = (first == doc[n - 1:]) & ~((x[:len(gram)] == 32) & (x[1:len(gram) + 1] == 32))
        bucket = (gram * np.uint32(0x9E3779B1 if n == 2 else 0x85EBCA77)) >> np.uint32(20)
        out += np.bincount(first[whole] * BUCKETS + bucket[whole], minlength=out.size).reshape(out.shape)
    total = out.sum(1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def has_letter(texts: pa.Array) -> np.ndarray:
    plain = [t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()]
    return np.array(plain, bool)


def codewords(classes: int) -> np.ndarray:
    """One row of +-1 per class.  Up to six classes: every split into two sides
    once; more: columns of a fixed random code, redrawn until rows differ widely."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        cols = [(1, *rest) for rest in product((1, -1), repeat=classes - 1) if -1 in rest]
        return np.array(cols, float).T
    rng, best, bits = np.random.default_rng(1), (-1, None), 4 * int(np.ceil(np.log2(classes))) + 15
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        code = code[:, abs(code.sum(0)) < classes]
        gap = min((code[i] != code[j]).sum() for i in range(classes) for j in range(i))
        if gap > best[0]:
            best = (gap, code)
    return best[1]


class LanguageCodes:
    """Classifiers of the bits, their weights, and the code."""

    def __init__(self, names: list[str]):
        self.names, self.code = names, codewords(len(names))
        bits = self.code.shape[1] if names else 0
        self.weight, self.bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
        self.trust = np.ones(bits)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> LanguageCodes:
        """Logistic regression of all bits together (Adam); every language weighs the same."""
        if len(self.names) < 2:
            return self
        target = self.code[y].astype(np.float32)
        share = (1 / np.bincount(y, minlength=len(self.names)))[y].astype(np.float32)[:, None]
        share /= share.sum()
        params = [self.weight, self.bias]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for it in range(1, rounds + 1):
            margin = x @ self.weight + self.bias
            pull = share * target / (1 + np.exp(target * margin))
            for p, g, m, v in zip(params, (x.T @ pull - decay * self.weight, pull.sum(0)), mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.99 ** it)) + 1e-8)
        error = (share * (target * (x @ self.weight + self.bias) <= 0)).sum(0)
        self.trust = np.log((1 - error + 1e-3) / (error + 1e-3))
        self.trust = np.maximum(self.trust, 0.05) / np.maximum(self.trust, 0.05).sum()
        return self

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, probability, ambiguous) of each text."""
        n, letters = len(texts), has_letter(texts)
        best, sure, unclear = np.full(n, -1), np.zeros(n), np.ones(n, bool)
        if not self.names:
            return best, sure, unclear
        for at in range(0, n, BLOCK):
            rows = slice(at, min(n, at + BLOCK))
            margin = features(texts.slice(at, BLOCK)) @ self.weight + self.bias
            loss = (np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust).sum(2)
            p = np.exp(-(loss - loss.min(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            order = np.argsort(-p, 1, kind="stable")
            first = p[np.arange(len(p)), order[:, 0]]
            second = p[np.arange(len(p)), order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
            best[rows], sure[rows], unclear[rows] = order[:, 0], first, first - second < AMBIGUOUS
        best[~letters], sure[~letters], unclear[~letters] = -1, 0.0, True
        return best, sure, unclear


def held_out_expr(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE) -> LanguageCodes:
    """Fit on labelled rows that are not held out.  Only text and language are read
    as inputs; the id decides membership of the sample.  No labels: no languages."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")) \
        .filter(F.col("_l").isNotNull() & F.col("_t").isNotNull() & ~held_out_expr("_id"))
    counts = {r["_l"]: r["n"] for r in rows.groupBy("_l").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return LanguageCodes([])
    # a row is in the sample if the hash of its id falls under its language's share
    limit = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(int(min(1.0, per_language / counts[k]) * (1 << 20))))])
    number = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])
    picked = rows.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < limit[F.col("_l")]).select("_t", number[F.col("_l")].alias("y"))

    def run(batches):
        for batch in batches:
            for at, part in text_chunks(batch.column(0)):
                for b in range(0, len(part), BLOCK):
                    x = features(part.slice(b, BLOCK)).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(r.tobytes(), 1) for r in x], pa.binary()),
                                                      batch.column(1).slice(at + b, len(x))], ["x", "y"])

    got = sorted((bytes(r.x), r.y) for r in picked.mapInArrow(run, "x binary, y int").collect())
    x = np.stack([np.frombuffer(zlib.decompress(r), np.float16) for r, _ in got]).astype(np.float32) if got else np.zeros((0, BUCKETS), np.float32)
    return LanguageCodes(names).fit(x, np.array([y for _, y in got], int))


def predict(docs: DataFrame, model: LanguageCodes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous), one row per row of ``docs``.

    Null text, or one without any letter, is ``und`` with score 0.
    """
    ship_package(docs.sparkSession)
    names = np.array([*model.names, UNKNOWN])

    def run(batches):
        for batch in batches:
            for at, part in text_chunks(batch.column(2)):
                best, sure, unclear = model.predict(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array(names[best].tolist(), pa.string()),
                     pa.array(sure), pa.array(unclear)], [id_col, "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), held_out_expr(id_col).alias("held_out"), F.col(f"`{text_col}`")).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep(docs: DataFrame, model: LanguageCodes, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in a known language: neither ``und`` nor ambiguous."""
    ship_package(docs.sparkSession)
    at_text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at, part in text_chunks(batch.column(at_text)):
                best, _, unclear = model.predict(part)
                yield batch.slice(at, len(part)).filter(pa.array((best >= 0) & ~unclear))

    return docs.mapInArrow(run, docs.schema)


def op7_language_codes(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts in no known language go."""
    return keep(docs, train(docs))
