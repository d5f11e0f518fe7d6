"""Quality rules with line labels from a linear-chain conditional random field.

Every line gets a few categorical features (binned shares of letter kinds,
symbols, repeated words, length, copies).  A two-label chain (content or
boilerplate), trained on labelled documents, labels the lines of a text together
by Viterbi decoding; a text is kept when enough of its words stand in content
lines and the base counts pass.

Training reads a bounded sample of labelled rows (``SAMPLE`` labels, chosen by
hash of the id): lines of a low-quality document count as boilerplate, those of a
good one as content.  Scoring is one narrow pass; all counts come from numpy over
blocks of whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import Words, _offsets, _powers, mix64, ship_package, table, text_chunks, windows

#: Labelled rows that training reads at most (in expectation).
SAMPLE = 3000
#: Least share of words in content lines.
CONTENT_SHARE = 0.5

_CLASSES = ("white", "upper", "lower", "digit", "symbol", "stop", "other", "high")
_CLASS = np.full(256, _CLASSES.index("other"), np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 4
_CLASS[[ord(c) for c in ".,;:"]] = 5
_CLASS[128:] = 7
#: Bins of one feature: shares of a line at these cuts, besides "no such character".
_CUTS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.6])
_LENGTHS = np.array([1, 3, 6, 12, 25, 60, 150])
BINS = 9
FEATURES = ("upper", "digit", "symbol", "stop", "other", "high", "words", "word_size", "same_as_before", "repeated", "copy")


class Lines:
    """Counts and line features of a block of texts."""

    def __init__(self, texts: pa.Array):
        w = self.words = Words(texts)
        raw, off, rows = w.raw, w.off, w.rows
        exact = w.hashes(lower=False)
        # lines: a text has one more line than it has line ends
        breaks = np.flatnonzero(raw == 10)
        doc_of_break = np.searchsorted(off, breaks, "right") - 1
        self.start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
        self.doc = np.sort(np.concatenate([np.arange(rows), doc_of_break]), kind="stable")
        self.end = np.empty_like(self.start)
        if rows:
            self.end[:-1] = self.start[1:] - 1
            last = np.cumsum(np.bincount(self.doc, minlength=rows)) - 1
            self.end[last] = off[1:]
            self.first = np.concatenate([[0], last + 1])
        else:
            self.first = np.zeros(1, np.int64)
        n = len(self.start)
        self.w0, self.w1 = np.searchsorted(w.start, self.start), np.searchsorted(w.start, self.end)
        self.n_words = self.w1 - self.w0

        # copies of an earlier line of the same text
        up, down = _powers(len(raw))
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=run[1:])
        key = mix64((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.copy = earlier(self.doc, key) & (self.n_words > 0)

        # words inside five-word windows that a text holds at least twice
        shingle, at = windows(w, exact, 5)
        twice = at[shared(w.doc[at], shingle)]
        cover = np.zeros(len(exact) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 5, -1)
        self.repeated = np.cumsum(cover)[:-1] > 0

        kinds = _CLASS[raw]
        self.sums = {}
        for i, name in enumerate(_CLASSES[1:], 1):
            self.sums[name] = np.concatenate([[0], np.cumsum(kinds == i, dtype=np.int32)])
        points = np.concatenate([[0], np.cumsum((raw & 0xC0 != 0x80) & (kinds != 0), dtype=np.int32)])

        def per_doc(x: np.ndarray) -> np.ndarray:
            return (x[off[1:]] - x[off[:-1]]).astype(np.int64)

        again = np.concatenate([[0], np.cumsum(self.repeated, dtype=np.int64)])
        copies = np.concatenate([[0], np.cumsum(self.copy, dtype=np.int64)])
        self.base = {
            "n_words": w.count.astype(np.int64), "word_chars": per_doc(points), "n_symbols": per_doc(self.sums["symbol"]),
            "n_dup_lines": copies[self.first[1:]] - copies[self.first[:-1]],
            "n_repeat_words": again[w.first[1:]] - again[w.first[:-1]]}

        def per_line(x: np.ndarray) -> np.ndarray:
            return (x[self.end] - x[self.start]).astype(float)

        size = np.maximum(1.0, sum(per_line(x) for x in self.sums.values()))
        shares = [per_line(self.sums[k]) / size for k in FEATURES[:6]]
        same = np.concatenate([[False], exact[1:] == exact[:-1]])[:len(exact)]
        run_same = np.concatenate([[0], np.cumsum(same)])
        many = np.maximum(1, self.n_words)
        shares += [(run_same[self.w1] - run_same[self.w0]) / many, (again[self.w1] - again[self.w0]) / many]
        codes = [np.where(s > 0, 1 + np.searchsorted(_CUTS, s), 0) for s in shares]
        self.features = np.zeros((n, len(FEATURES)), np.int64)
        for k, c in zip((0, 1, 2, 3, 4, 5, 8, 9), codes, strict=True):
            self.features[:, k] = c
        self.features[:, 6] = np.searchsorted(_LENGTHS, self.n_words, "right")
        self.features[:, 7] = np.searchsorted(_LENGTHS, size / many, "right")
        self.features[:, 10] = self.copy


def shared(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where another entry has the same (doc, key)."""
    both = mix64(key ^ mix64(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    near = both[order][1:] == both[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][near]] = True
    out[order[:-1][near]] = True
    return out


def earlier(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where an entry before this one has the same (doc, key)."""
    both = mix64(key ^ mix64(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][both[order][1:] == both[order][:-1]]] = True
    return out


class Chain:
    """Two-label chain: label 1 is content.  ``weight[k, bin]`` is the score of content over boilerplate."""

    def __init__(self):
        self.weight = np.zeros((len(FEATURES), BINS))
        self.step = np.zeros((2, 2))
        self.bias = 0.0

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weight[np.arange(len(FEATURES)), features].sum(1) + self.bias

    def viterbi(self, scores: list[float]) -> list[int]:
        """Best labels of one text's lines, given the score of content over boilerplate."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, scores[0], []
        for e in scores[1:]:
            f0, f1 = b + s10 > a + s00, b + s11 > a + s01
            a, b = (b + s10 if f0 else a + s00), (b + s11 if f1 else a + s01) + e
            back.append((f0, f1))
        label = int(b >= a)
        out = [label]
        for f in reversed(back):
            label = int(f[label])
            out.append(label)
        return out[::-1]

    def fit(self, texts: list[tuple[np.ndarray, int]], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Chain:
        """``texts``: (features of all lines, label).  Conditional likelihood by
        forward and backward sums over all texts at once, Adam steps."""
        texts = [t for t in texts if len(t[0])]
        if len({y for _, y in texts}) < 2:
            self.bias = 1.0  # nothing to tell apart: all lines are content
            return self
        texts.sort(key=lambda t: -len(t[0]))
        size = np.array([len(f) for f, _ in texts])
        gold = np.array([y for _, y in texts])
        share = np.where(gold == 1, 0.5 / (gold == 1).sum(), 0.5 / (gold == 0).sum())
        alive = [int((size > t).sum()) for t in range(size[0])]          # texts with a line t
        flat = np.concatenate([np.stack([f[t] for f, _ in texts[:alive[t]]]) for t in range(size[0])])
        starts = np.concatenate([[0], np.cumsum(alive)])
        heavy = np.concatenate([share[:n] / np.sqrt(size[:n]) for n in alive])
        truth = np.concatenate([gold[:n] for n in alive])
        params = [self.weight, self.step, np.zeros(1)]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for it in range(1, rounds + 1):
            self.bias = float(params[2][0])
            score = self.emissions(flat)
            fore = np.zeros((len(flat), 2))
            for t in range(len(alive)):
                rows = slice(starts[t], starts[t + 1])
                if t:
                    prev = fore[starts[t - 1]:starts[t - 1] + alive[t]]
                    fore[rows] = np.logaddexp(prev[:, :1] + self.step[0], prev[:, 1:] + self.step[1])
                fore[rows, 1] += score[rows]
            back = np.zeros((len(flat), 2))
            expected = np.zeros((2, 2))
            for t in range(len(alive) - 2, -1, -1):
                n, here, there = alive[t + 1], starts[t], starts[t + 1]
                ahead = back[there:there + n].copy()
                ahead[:, 1] += score[there:there + n]
                full = self.step + ahead[:, None, :]
                back[here:here + n] = np.logaddexp(full[:, :, 0], full[:, :, 1])
                pair = fore[here:here + n, :, None] + full
                pair -= pair.max((1, 2), keepdims=True)
                pair = np.exp(pair)
                expected += (pair / pair.sum((1, 2), keepdims=True) * heavy[there:there + n, None, None]).sum(0)
            both = fore + back
            content = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
            wrong = heavy * (truth - content)
            slope = np.zeros_like(self.weight)
            for k in range(len(FEATURES)):
                slope[k] = np.bincount(flat[:, k], wrong, minlength=BINS)
            seen = np.zeros((2, 2))
            later = slice(starts[1], None)
            seen[1, 1], seen[0, 0] = (heavy[later] * truth[later]).sum(), (heavy[later] * (1 - truth[later])).sum()
            for p, g, m, v in zip(params, (slope, seen - expected, np.array([wrong.sum()])), mean, square, strict=True):
                g = g - decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9 ** it)) / (np.sqrt(v / (1 - 0.99 ** it)) + 1e-8)
        self.bias = float(params[2][0])
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE) -> Chain:
    """Fit on documents of ``labels`` (``label_col`` 0 or 1; others and null are ignored).

    At most about ``sample`` label rows are used: those with the smallest hash of
    the id, so the same rows on every run.  Without both labels the chain calls
    every line content.
    """
    ship_package(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    share = sample / max(1, known.count())
    picked = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_id")

    def run(batches):
        for batch in batches:
            for at, part in text_chunks(batch.column(0)):
                lines = Lines(part)
                cut = [lines.features[lines.first[i]:lines.first[i + 1]].astype(np.uint8).tobytes() for i in range(len(part))]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), batch.column(1).slice(at, len(part))], ["f", "y"])

    got = rows.select("_t", "_y").mapInArrow(run, "f binary, y int").collect()
    texts = sorted((bytes(r.f), r.y) for r in got)  # the order of rows does not matter
    return Chain().fit([(np.frombuffer(f, np.uint8).reshape(-1, len(FEATURES)).astype(np.int64), y) for f, y in texts])


def judge(texts: pa.Array, chain: Chain, share: float = CONTENT_SHARE) -> dict[str, np.ndarray]:
    """Base counts, content share and verdict of each text."""
    lines = Lines(texts)
    out = dict(lines.base)
    scores = chain.emissions(lines.features).tolist()
    size = lines.n_words.tolist()
    content = np.zeros(len(texts))
    for i in range(len(texts)):
        a, b = int(lines.first[i]), int(lines.first[i + 1])
        content[i] = sum(n for n, y in zip(size[a:b], chain.viterbi(scores[a:b]), strict=True) if y)
    out["content_share"] = content / np.maximum(1, out["n_words"])
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["content_share"] >= share)
    return out


def label_lines(text: str, chain: Chain) -> list[tuple[str, bool]]:
    """(line, is content) of one text."""
    lines = Lines(pa.array([text or ""]))
    return list(zip((text or "").split("\n"), map(bool, chain.viterbi(chain.emissions(lines.features).tolist())), strict=True))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts, base_failed, kept, content_share.

    Null text has no words and fails the base rule; an empty text likewise.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, part in text_chunks(batch.column(1)):
                got = judge(part, chain)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), *(pa.array(got[c].astype(np.int64)) for c in _COUNTS),
                     pa.array(got["base_failed"]), pa.array(got["kept"]), pa.array(got["content_share"])],
                    [id_col, *_COUNTS, "base_failed", "kept", "content_share"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(
        run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in _COUNTS)
        + ", base_failed boolean, kept boolean, content_share double")


def keep(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    ship_package(docs.sparkSession)
    at_text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at, part in text_chunks(batch.column(at_text)):
                yield batch.slice(at, len(part)).filter(pa.array(judge(part, chain)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op6_line_crf(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go."""
    return keep(docs, train(docs, table(spark, sf_dir, "labels")))
