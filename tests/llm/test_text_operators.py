"""Packing, BPE, quality rules, language ID, language model and line dedup
against brute force, and on nulls, empty tables, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskfold.llm import backoff_lm, bpe, language_codes, line_crf, line_runs, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(PATH)


#: Letters that NFC splits into letter and mark.
SPLIT = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not unicodedata.normalize("NFC", chr(c)).isalpha()]


def odd_texts():
    rng = random.Random(4)
    letters = "aAbBsSİΣßéÉé’,.!$ \t\n\x0b\x1c\x85\xa0 0۵²中文कि😀<|>_-\x01"
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "the ", "don't, ", "the's "]
    out = [None, "", " ", "\n", "a", "The the THE", "x" * 70_000, "the cat " * 20_000, "same", "same"]
    for _ in range(300):
        out.append("".join(rng.choice(letters) if rng.random() < .8 else rng.choice(bits) for _ in range(rng.randint(0, 50))))
    return out + [c + "\u0915" for c in SPLIT] + [f"a{c}, {c}! {c}{c}b" for c in SPLIT]


def test_pieces_of_any_letter_equal_library(tool):
    own = packing.PieceIds(PATH)
    texts = [t for c in map(chr, range(0x80, 0x110000)) if c.isalpha() for t in (c, f"{c}a.")]
    assert len(SPLIT) > 50
    for t, got in zip(texts, own.ids([t.encode() for t in texts])):
        assert list(array("I", got)) == tool.encode(t, add_special_tokens=False).ids, t
    for t in odd_texts():
        assert list(array("I", own.ids([(t or "").encode()])[0])) == tool.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts with repeated rows and columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else "de", i % 3, i) for i, t in enumerate(odd_texts())]
    rows += [rows[5], (None, "null id", "en", 0, 0), (900, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part int, h1 long") \
        .withColumn("row", F.lit("r")).withColumn("id", F.lit(7)).withColumn("ids", F.lit("x")).withColumn("y", F.lit(1))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_bpe_equals_library(tool):
    own = bpe.WordBpe(PATH)
    for t in odd_texts():
        want = tool.encode(t or "", add_special_tokens=False).ids
        assert own.encode_bytes((t or "").encode()).tolist() == want == own.encode(t or "")
        assert own.decode(want) == tool.decode(want, skip_special_tokens=False)


def test_bpe_long_words_take_the_heap(tool):
    own, rng = bpe.WordBpe(PATH), random.Random(1)
    for n in (bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1, 700):
        word = "".join(rng.choice("aehtnrs") for _ in range(n))
        assert own.encode(word) == tool.encode(word, add_special_tokens=False).ids


def test_op2_digests(spark, docs, nothing, tool):
    got = bpe.op2_bpe_codec(docs, PATH).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        ids = tool.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert bpe.op2_bpe_codec(nothing, PATH).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert set(docs.columns) <= set(back.columns) and back.count() == docs.count()


def check_packing(pieces, capacity):
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op1_packs_all_pieces(docs, nothing, tool):
    got = packing.op1_squares_packing(docs, PATH).collect()
    check_packing(got, 2048)
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*tool.encode(r.text or "", add_special_tokens=False).ids, 0], np.uint32)
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert packing.op1_squares_packing(nothing, PATH).count() == 0


def test_placing_is_near_the_bound():
    lengths = np.sort(np.random.default_rng(2).integers(1, 1500, 4000))[::-1]
    sequence, offset = packing.place(lengths, 2048)
    assert sequence.max() + 1 <= 1.01 * math.ceil(lengths.sum() / 2048)
    assert packing.place(np.array([2048, 2048, 1, 2047]), 2048)[0].tolist() == [0, 1, 2, 2]


def crf_counts(text):
    w = WORDS.findall(text or "")
    seen, twice, lines = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)), set(), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i:i + 5])] > 1:
            twice.update(range(i, i + 5))
    copies = 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            copies += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, len(twice)


def test_op6_counts_and_verdict(spark, docs, nothing):
    rng = random.Random(3)
    texts = odd_texts() + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    chain = line_crf.Chain()
    chain.bias = 1.0
    got = line_crf.judge(pa.array(texts, pa.string()), chain)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, t in enumerate(texts):
        want = crf_counts(t)
        assert tuple(int(got[k][i]) for k in names) == want
        assert bool(got["base_failed"][i]) == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert line_crf.score(docs, line_crf.train(docs, labels)).count() == docs.count()
    assert line_crf.keep(nothing, chain).columns == nothing.columns


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(5)
    for _ in range(50):
        chain, scores = line_crf.Chain(), rng.normal(size=rng.integers(1, 7))
        chain.step = rng.normal(size=(2, 2))

        def value(y):
            return sum(s for s, k in zip(scores, y) if k) + sum(chain.step[a, b] for a, b in zip(y, y[1:]))

        ways = [[n >> i & 1 for i in range(len(scores))] for n in range(1 << len(scores))]
        assert value(chain.viterbi(scores.tolist())) == pytest.approx(max(map(value, ways)))


def test_crf_on_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = line_crf.score(docs, line_crf.train(docs, labels)).join(labels, "doc_id").toPandas()
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() >= 0.95
    assert (~got[got.quality == 0].kept).mean() >= 0.8
    assert line_crf.label_lines("a\n\nb", line_crf.Chain())[1][0] == ""


def test_op7_languages(spark, docs, nothing):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_codes.op7_language_codes(table).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang == held.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    model = language_codes.LanguageCodes([])
    assert {r.lang_pred for r in language_codes.predict(docs, model).collect()} == {"und"}
    assert language_codes.predict(nothing, language_codes.train(nothing)).count() == 0
    best, sure, unclear = language_codes.train(table).predict(pa.array([None, "", "12 34 --", "a"], pa.string()))
    assert best[:3].tolist() == [-1, -1, -1] and sure[:3].tolist() == [0, 0, 0] and best[3] >= 0


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9):
        code = language_codes.codewords(n)
        assert len({tuple(r) for r in code}) == n
    four = language_codes.codewords(4)
    assert min((four[i] != four[j]).sum() for i in range(4) for j in range(i)) == 4


def test_op8_equals_brute_force(docs, nothing):
    rows = [r for r in docs.collect()]
    out = collections.defaultdict(list)
    for r in backoff_lm.score(docs, ~(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2),
                              part_bytes=50_000).collect():
        out[r.doc_id].append(r)
    tokens = [(r.doc_id, zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2,
               [*WORDS.findall((r.text or "").translate(LOWER)), None]) for r in rows]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for _, held, w in tokens:
        if not held:
            one.update(w)
            two.update(zip(["<start>"] + w, w))
            three.update(zip(["<start>"] + w, w, w[1:]))
    n, v, mu = sum(one.values()), len(one), backoff_lm.MU
    for i, held, w in tokens:
        low = [(one[x] + 1) / (n + v + 1) for x in w]
        mid = [(two[h, x] + mu[0] * p) / ((one[None] if h == "<start>" else one[h]) + mu[0])
               for h, x, p in zip(["<start>"] + w, w, low)]
        high = [(three[g, h, x] + mu[1] * p) / (two[g, h] + mu[1]) for g, h, x, p in zip(["<start>"] + w, w, w[1:], mid[1:])]
        full = sum(map(math.log10, mid[:1] + high))
        r = out[i][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, len(w), sum(one[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(map(math.log10, low)), rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(full, rel=1e-9, abs=1e-9)
    assert sum(map(len, out.values())) == len(rows)
    assert backoff_lm.op8_backoff_automaton(nothing).count() == 0


def test_automaton_states_and_arcs():
    """Texts ``a b``, ``a b``, ``a c`` are known; walks take the longest known history and its failures."""
    keys = {w: np.uint64(k + 1) for k, w in enumerate("abcx")} | {"": backoff_lm.END}
    known = [["a", "b", ""], ["a", "b", ""], ["a", "c", ""]]
    asked = [["a", "b", ""], ["x", "a", "c", "c", ""], [""]]
    grams = [collections.Counter(tuple((["<"] + t)[i:i + n]) for t in known for i in range(n == 1, len(t) + 2 - n)) for n in (1, 2, 3)]
    first = np.cumsum([0] + [len(t) for t in asked])
    n1, n2, n3 = (np.array([grams[n - 1][tuple((["<"] + t)[i + 2 - n:i + 2])] for t in asked for i in range(len(t)) if i + 2 >= n])
                  for n in (1, 2, 3))
    at3 = np.setdiff1d(np.arange(first[-1]), first[:-1])
    flat = np.array([keys[w] for t in asked for w in t], np.uint64)
    auto = backoff_lm.Automaton(flat, first, n1, n2, n3, at3, 9, 4, 3)
    m, k = backoff_lm.MU

    def low(w):
        return (grams[0][w,] + 1) / 14

    def end(n):
        return (n + m * low("")) / (n + m)

    fall = m / (3 + m)                                   # the start is left without an arc
    b = (2 + m * low("b")) / (3 + m)
    c = (1 + m * low("c")) / (3 + m)
    first_text = (3 + m * low("a")) / (3 + m) * (2 + k * b) / (3 + k) * (2 + k * end(2)) / (2 + k)
    second = fall * low("x") * low("a") * c * (k / (1 + k)) * (m / (1 + m)) * low("c") * end(1)
    got = [auto.walk(x, y) for x, y in zip(first[:-1], first[1:])]
    assert got == pytest.approx([math.log10(p) for p in (first_text, second, fall * low(""))])
    whole = [backoff_lm.walk_all(flat, first, n1, n2, n3, at3, 9, 4, 3, piece_tokens=p).tolist() for p in (1, 4, 100)]
    assert whole == [pytest.approx(got)] * 3


def dedup(rows, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(LOWER)

    docs = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key(line)].add(i)
    owner = {k: max(d) for k, d in docs.items() if len(k) >= min_chars and len(d) >= min_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if owner.get(key(x), i) == i)) for i, t in rows]


def test_op9_equals_brute_force(spark, nothing):
    rng = random.Random(8)
    pool = ["  Éa" + "Long Line %d " % i * 6 + "\t" for i in range(6)] + ["short"] * 3 + [""]
    rows = [(i, "\n".join(rng.choice([str.upper, str, str.strip])(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("h1", F.lit("c"))
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        got = {r.id: "\n".join(r.kept) for r in line_runs.dedup_lines(df, batches=batches, fanout=fanout).select("row.doc_id", "kept")
               .withColumnRenamed("doc_id", "id").collect()}
        assert got == dict(dedup(rows))
    assert line_runs.op9_line_dedup(nothing).count() == 0
    staged = line_runs.stage(spark, df.withColumn("n_chars", F.length("text").cast("long")), SF)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in staged.collect())


def test_op9_odd_rows(docs):
    assert line_runs.op9_line_dedup(docs).count() == docs.count()


def test_codec_equals_library_on_every_code_point(tool):
    own = bpe.WordBpe(PATH)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for shape in ("{} a{}b {}1.{}a",):
        for at in range(0, len(letters), 1 << 15):
            some = [shape.replace("{}", c) for c in letters[at:at + (1 << 15)]]
            wrong = [t for t, e in zip(some, tool.encode_batch(some, add_special_tokens=False)) if own.encode(t) != e.ids]
            assert not wrong
