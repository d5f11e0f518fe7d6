"""Language-model scoring with a weighted backoff automaton of order three.

Model: words with add-one unigrams at the root, and Dirichlet smoothing of each
longer history toward the next shorter one.  Automaton: the root has an arc for
every token; the start, each known word and each known pair of words is a state
with an arc for every token seen after it, weighted with the smoothed probability,
and a failure arc to the state of the next shorter history, weighted with the mass
that the state leaves to unseen tokens.  A text is read once from left to right:
the state is carried along, a token that has no arc takes failure arcs until one
of the states reached has it, and the log weights of all arcs taken add up.

The model is never gathered.  Texts are dealt by hash into parts of about
``PART_BYTES`` (and shuffled once, compressed); each part lists its distinct n-grams of orders one to three with
their training counts, sorted by hash, and sends them in packed blocks, one per
range of hashes that it has n-grams in, so there are never more blocks than rows
of a plain join on (part, n-gram).  The task of a range adds up equal n-grams of
all parts and answers each part, in the part's own order, with what the others
hold.  From the answers a part builds the states and arcs that its texts can reach,
some texts at a time, and walks them.  A frequent n-gram is one entry per part, so
none is hot.  N-grams are told apart by fingerprints: the upper bits of a 64-bit
hash, as many as number all n-grams that texts of this size can hold and ``SPARE_BITS``
more, so the chance that one is taken for another is the same at every size.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import Words, mix64, ship_package, text_chunks

PART_BYTES = 8 << 20
#: Weight of the shorter history against the counts of a one-word and of a two-word history.
MU = (200.0, 50.0)
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
#: Tokens that one piece of the automaton is built for (a longer single text goes alone).
PIECE_TOKENS = 200_000
ORDERS = ("one", "two", "three")
#: Bits of a fingerprint beyond those that number all n-grams: one in 2**SPARE_BITS meets another's.
SPARE_BITS = 24


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token of each text): words, then one end per text."""
    keys, sizes = [], []
    for _, part in text_chunks(texts):
        w = Words(part)
        out = np.full(len(w.start) + w.rows, END, np.uint64)
        out[np.arange(len(w.start)) + w.doc] = w.hashes()
        keys.append(out)
        sizes.append(w.count + 1)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def extend(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of all but its last token and of its last token."""
    return mix64(before * np.uint64(0x9FB21C651E98DF25) + mix64(keys))


def ngrams(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram, trigram, place of each trigram): a bigram ends at every token, the
    first of a text after the start; a trigram at every token but the first."""
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[first[:-1]] = START
    two = extend(before, keys)
    inner = np.ones(len(keys), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    return two, extend(two[at - 1], keys[at]), at


def ranges(sorted_keys: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Cuts of a sorted array of keys of so many bits into ``n`` equal ranges."""
    edges = np.array([(i << bits) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def pack(values: np.ndarray) -> bytes:
    """64-bit values, byte planes first, so that high bytes compress."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.data, codec="zstd", asbytes=True)


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def numbers(kind: str, values: np.ndarray) -> array:
    """Plain array of doubles (``d``) or whole numbers (``q``), quick to index one by one."""
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values, {"d": np.float64, "q": np.int64}[kind]).tobytes())
    return out


class Automaton:
    """States and arcs that the walks of a run of texts take.

    State 0 is the root, 1 the start; then one per distinct token, then one per
    distinct pair of tokens.  States are held times ``width``, so that state + token
    names an arc: the root's arcs are numbered like the tokens, ``arcs`` has those of
    all other states.  An arc has a log weight and a target; ``fail`` and
    ``fail_weight`` belong to states.  A one-word state's arc is built where it can be
    taken: at the start, or where a pair's state has none.
    """

    def __init__(self, keys, first, n1, n2, n3, at3, total: int, types: int, starts: int, mu=MU):
        """``keys``: token hashes; ``n1``, ``n2``: training counts of the token and of the
        bigram at each place; ``n3``: those of the trigrams, which end at the places ``at3``."""
        _, some, self.tokens = np.unique(keys, return_index=True, return_inverse=True)
        two, three, _ = ngrams(keys, first)
        _, some2, pair = np.unique(two, return_index=True, return_inverse=True)
        self.width = width = max(1, len(some))
        is_first = np.zeros(len(keys), bool)
        is_first[first[:-1]] = True
        history = np.ones(len(keys), np.int64)                      # state of the word before
        history[1:] = 2 + self.tokens[:-1]
        history[is_first] = 1
        count = np.full(len(keys), float(starts))                   # how often that word was seen
        count[1:] = n1[:-1]
        count[is_first] = starts
        ends = keys == END
        low = (n1 + 1.0) / (total + types + 1.0)
        mid = (n2 + mu[0] * low) / (count + mu[0])
        pair_state = np.where(ends, 0, 2 + width + pair)
        word_state = np.where(ends | (n1 == 0), 0, 2 + self.tokens)

        falls = is_first.copy()
        falls[at3[n3 == 0]] = True
        b = np.flatnonzero(falls & (n2 > 0))
        b = b[np.unique(pair[b], return_index=True)[1]]
        c = np.flatnonzero(n3 > 0)
        c = c[np.unique(three[c], return_index=True)[1]]
        t = at3[c]
        high = (n3[c] + mu[1] * mid[t]) / (n2[t - 1] + mu[1])
        state = np.concatenate([history[b], 2 + width + pair[t - 1]])
        token = np.concatenate([self.tokens[b], self.tokens[t]])
        self.arcs = dict(zip((state * width + token).tolist(), range(width, width + len(state)), strict=True))
        self.weight = numbers("d", np.log10(np.concatenate([low[some], mid[b], high])))
        self.target = numbers("q", np.concatenate([word_state[some], pair_state[b], pair_state[t]]) * width)
        self.fail = numbers("q", np.concatenate([[0, 0], np.zeros(len(some), np.int64), 2 + self.tokens[some2]]) * width)
        self.fail_weight = numbers("d", np.concatenate([
            [0.0, np.log10(mu[0] / (starts + mu[0]))], np.log10(mu[0] / (n1[some] + mu[0])),
            np.log10(mu[1] / (n2[some2] + mu[1]))]))

    def walk(self, begin: int, end: int) -> float:
        """Log probability of the text whose tokens are at ``begin`` to ``end``."""
        arc_of, width, weight, target, fail, fail_weight = \
            self.arcs.get, self.width, self.weight, self.target, self.fail, self.fail_weight
        state, score = width, 0.0
        for token in self.tokens[begin:end].tolist():
            arc = arc_of(state + token) if state else token
            while arc is None:
                score += fail_weight[state // width]
                state = fail[state // width]
                arc = arc_of(state + token) if state else token
            score += weight[arc]
            state = target[arc]
        return score


def walk_all(keys, first, n1, n2, n3, at3, total: int, types: int, starts: int, mu=MU,
             piece_tokens: int = PIECE_TOKENS) -> np.ndarray:
    """Score of every text, by one automaton for each run of texts of about ``piece_tokens``."""
    out = np.zeros(len(first) - 1)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(first, first[at] + piece_tokens, "right")) - 1)
        a, b = first[at], first[to]
        c, d = np.searchsorted(at3, [a, b])
        cut = first[at:to + 1] - a
        part = Automaton(keys[a:b], cut, n1[a:b], n2[a:b], n3[c:d], at3[c:d] - a, total, types, starts, mu)
        out[at:to] = [part.walk(x, y) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        at = to
    return out


def sizes_of(rows: DataFrame) -> tuple[int, int, int]:
    """(tokens, distinct tokens, texts) of the ``text`` column, by a grouped count.
    A task adds up its batches and sends what it has whenever that passes ``PART_BYTES``."""
    def run(batches):
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            if len(keys) * 8 > PART_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])
                keys, n = keys[:0], n[:0]
            more, m = np.unique(tokens(batch.column(0))[0], return_counts=True)
            keys, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, m]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = rows.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    end = int(END.view(np.int64))
    found = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("h") == end, F.col("n")))).first()
    return tuple(int(x or 0) for x in found)


def bundle(batches):
    """(id, text, train, part) batches as one row for each part: its texts end to end, compressed."""
    for batch in batches:
        batch = batch.take(pa.array(np.argsort(batch.column(3).to_numpy(), kind="stable")))
        part = batch.column(3).to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        data = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        off = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(part) + 1] if len(part) else np.zeros(1, np.int64)
        raw = data.buffers()[2]
        texts = [pa.compress(raw.slice(off[a], off[b] - off[a]), codec="zstd", asbytes=True) if off[b] > off[a] else b""
                 for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[cuts[:-1]], pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(0)),
             pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(2)),
             pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.diff(off))), pa.array(texts, pa.binary())],
            ["part", "ids", "train", "sizes", "texts"])


def flat(t: pa.Table, name: str) -> pa.Array:
    """All items of a list column, in order."""
    return pa.concat_arrays([c.flatten() for c in t.column(name).chunks])


def unbundle(t: pa.Table) -> pa.Array:
    """Texts of bundled rows, in the order of ``flat``."""
    sizes = flat(t, "sizes").to_numpy(zero_copy_only=False)
    raw = [pa.decompress(z.as_py(), decompressed_size=int(sum(n.as_py())), codec="zstd", asbytes=True) if z.as_py() else b""
           for z, n in zip(t.column("texts"), t.column("sizes"), strict=True)]
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(off.tobytes()), pa.py_buffer(b"".join(raw)))


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", mu=MU,
          part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a boolean column: rows that the model learns from.  Null or empty
    text is one end token.  Repeated rows count as often as they occur; they are
    dealt to parts by their place in the table, so ``docs`` should be a stored table.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), train.alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    total, types, starts = sizes_of(rows.filter("train"))
    parts = max(1, -(-size // part_bytes))
    # three n-grams end at a token, and no text is longer than its bytes and one
    bits = min(64, math.ceil(math.log2(3 * (size + 1) + 1)) + SPARE_BITS)
    drop = np.uint64(64 - bits)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))

    kind = docs.schema[id_col].dataType.simpleString()
    rows = rows.mapInArrow(bundle, f"part int, ids array<{kind}>, train array<boolean>, sizes array<long>, texts binary")

    def listing(t: pa.Table):
        """Tokens of a part: (hashes, firsts, is the text trained on, places of trigrams,
        and by order the distinct n-grams, the place of each in that list, own training counts)."""
        keys, first = tokens(unbundle(t))
        learn = flat(t, "train").to_numpy(zero_copy_only=False).astype(bool)
        two, three, at = ngrams(keys, first)
        weight = np.repeat(learn, np.diff(first))
        grams = []
        for values, w in ((keys, weight), (two, weight), (three, weight[at])):
            every, place = np.unique(values >> drop, return_inverse=True)
            grams.append((every, place, np.bincount(place[w], minlength=len(every))))
        return keys, first, learn, at, grams

    def send(t: pa.Table) -> pa.Table:
        *_, grams = listing(t)
        cuts = [ranges(keys, parts, bits) for keys, _, _ in grams]
        used = np.flatnonzero(sum(np.diff(c) for c in cuts))
        out = {"range": used.astype(np.int32), "part": np.full(len(used), t.column("part")[0].as_py(), np.int32)}
        for name, (keys, _, n), cut in zip(ORDERS, grams, cuts, strict=True):
            out[f"{name}_key"] = [pack_keys(keys[cut[r]:cut[r + 1]]) for r in used]
            out[f"{name}_n"] = [pack(n[cut[r]:cut[r + 1]]) for r in used]
        return pa.table(out)

    blocks = rows.groupBy("part").applyInArrow(
        send, "range int, part int, " + ", ".join(f"{o}_key binary, {o}_n binary" for o in ORDERS))

    def add_up(t: pa.Table) -> pa.Table:
        out = {"range": t.column("range"), "part": t.column("part")}
        for name in ORDERS:
            keys = [unpack_keys(k.as_py()) for k in t.column(f"{name}_key")]
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.concatenate([unpack(k.as_py()) for k in t.column(f"{name}_n")])
            others = np.bincount(place, n, len(every)).astype(np.int64)[place] - n
            out[f"{name}_sum"] = [pack(x) for x in np.split(others, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table(out)

    answers = blocks.groupBy("range").applyInArrow(
        add_up, "range int, part int, " + ", ".join(f"{o}_sum binary" for o in ORDERS))

    def read(t: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("range")
        keys, first, learn, at, grams = listing(t)
        n1, n2, n3 = ((own + np.concatenate([unpack(x.as_py()) for x in told.column(f"{name}_sum")]))[place]
                      for name, (_, place, own) in zip(ORDERS, grams, strict=True))
        return pa.table({
            id_col: flat(t, "ids"), "held_out": ~learn, "n_tokens": np.diff(first),
            "n_known": np.add.reduceat((n1 > 0).astype(np.int64), first[:-1]),
            "train_tokens": np.full(len(learn), total),
            "base_score": np.add.reduceat(np.log10((n1 + 1.0) / (total + types + 1.0)), first[:-1]),
            "score": walk_all(keys, first, n1, n2, n3, at, total, types, starts, mu)})

    return rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(
        read, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_backoff_automaton(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return score(docs, ~held_out)
