"""Spelling variants, periodic runs and sharding against brute force, and on
nulls, empty tables, ties, repeated rows and clashing columns."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskfold.llm import period_runs, shard_schedule, spelling_variants

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "w") for i, t in rows], "doc_id long, text string, n int, uid int, word string")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    pool = ["house", "hause", "mouse", "houses", "hous", "straße", "strase", "Éclat", "éclat", "naïve", "aaaaa", "aaaaaa", "x" * 30_000, "lines×ok"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(1, None), (2, ""), (3, " \n\t"), (None, "house house house mouse"), (7, "same words"), (7, "same words")] + [(9, "hot copy house")] * 50
    rows += [(400 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 200)))) for i in range(60)]
    rows += [(500 + i, "the cat " * rng.randint(1, 40) + "sat " * rng.randint(0, 30)) for i in range(30)]
    return table(spark, rows)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- spelling variants -----------------------------------------------------------------


def brute_words(rows):
    tally = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            tally[run] += 1
    return {w: n for w, n in tally.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute_variants(words):
    near = collections.defaultdict(list)
    by = collections.defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    for length, some in by.items():
        for i, a in enumerate(some):
            for b in [*some[i + 1:], *by.get(length + 1, [])]:
                if one_edit(a, b):
                    near[a].append(b)
                    near[b].append(a)
    form = {}
    for w, n in words.items():
        if near[w]:
            top = min(near[w], key=lambda x: (-words[x], x))
            if words[top] >= 2 * n:
                form[w] = top
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("which", ["odd", "real"])
def test_variants_equal_brute_force(which, request, monkeypatch):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_variants(brute_words(rows))
    got = [tuple(r) for r in spelling_variants.op11_bloom_neighbours(docs).collect()]
    assert len(got) == len(want) and set(got) == want
    if which == "odd":   # many pieces, many passes: the same result
        monkeypatch.setattr(spelling_variants, "PIECE_WORDS", 3)
        monkeypatch.setattr(spelling_variants, "PASS_BYTES", 2000)
        assert {tuple(r) for r in spelling_variants.op11_bloom_neighbours(docs).collect()} == want


def test_variants_follow_long_chains(spark):
    words = [("w" + "a" * i + "b" * (40 - i), 3 * 2 ** i) for i in range(41)]
    got = {r.word: r for r in spelling_variants.variant_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r.root for r in got.values()} == {words[-1][0]}
    assert got[words[0][0]].form == words[1][0]
    with pytest.raises(ValueError):
        spelling_variants.variant_groups(spark.createDataFrame(words, "word string, n long"), factor=1)


def test_variants_of_nothing(spark):
    assert spelling_variants.op11_bloom_neighbours(table(spark, [])).count() == 0
    got = spelling_variants.variant_groups(spark.createDataFrame([(None, 3), ("solo", 1)], "word string, n long")).collect()
    assert [tuple(r) for r in got] == [("solo", None, "solo", 1, 0, None)]


def test_filter_holds_every_key_and_little_else():
    rng = np.random.default_rng(3)
    keys, others = (rng.integers(0, 1 << 64, 20_000, dtype=np.uint64) for _ in range(2))
    f = spelling_variants.BlockedBloom.of(keys)
    assert f.holds(keys).all() and f.holds(others).mean() < 0.01


# -- periodic runs -----------------------------------------------------------------------


def brute_runs(words):
    """Every maximal stretch, period by period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, x in enumerate(same):
            if x and start is None:
                start = i
            elif not x and start is not None:
                if i - start + q >= max(12, 2 * q):
                    best.setdefault((start, i + q), q)
                start = None
    return sorted((s, q, e - s) for (s, e), q in best.items())


def tiled_runs(words):
    """The same by tiles, without Spark."""
    known, found = {}, collections.defaultdict(list)
    for t in period_runs.active_tiles(np.array([known.setdefault(w, len(known)) for w in words], np.int64)):
        ids, bounds = (np.frombuffer(t[k], np.uint32).tolist() for k in ("ids", "bounds"))
        for q, s, e in period_runs.solve_tile(ids, bounds, t["low"], t["high"]):
            found[q].append((s + t["first"], e + t["first"]))
    best = {}
    for q in sorted(found):
        merged = []
        for s, e in sorted(found[q]):
            if merged and s + q <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for s, e in merged:
            if e - s >= max(12, 2 * q):
                best.setdefault((s, e), q)
    return sorted((s, q, e - s) for (s, e), q in best.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.integers(1, 9)), max_size=12), st.integers(1, 40))
def test_tiles_find_the_runs_of_repetitive_texts(parts, tile):
    words = [w for part, times in parts for w in part * times]
    kept, period_runs.TILE = period_runs.TILE, tile
    try:
        assert tiled_runs(words) == brute_runs(words)
    finally:
        period_runs.TILE = kept


def digest(doc, text):
    words = WORDS.findall(text or "")
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        g, n, old = h // 10, len(words), list(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, q, length in runs for i in range(s + q, s + length)}
    top = min(((-length, s, q) for s, q, length in runs), default=None)
    head = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{length},{q}\n" for s, q, length in runs), " ".join(w for i, w in enumerate(words) if i not in drop))]
    return (doc, len(runs), *head, *sha)


@pytest.mark.parametrize("which", ["odd", "real"])
def test_runs_equal_brute_force(which, request):
    docs = request.getfixturevalue(which)
    if which == "real":   # quadratic brute force: texts of ordinary length
        docs = docs.filter(F.octet_length("text") < 20_000)
    want = collections.Counter(digest(r.doc_id, r.text) for r in docs.collect())
    assert any(k[1] for k in want)
    got = period_runs.op12_tiled_periods(docs)
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_long_runs_are_stitched_across_tiles(spark):
    rng = random.Random(2)
    piece = [f"w{rng.randint(0, 500)}" for _ in range(3001)]
    rows = [(1, " ".join(["a"] * 20_000)), (2, " ".join(piece * 7 + ["x"])), (3, " ".join(["a b"] * 9000 + ["c"] + ["d e f"] * 5000))]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in period_runs.periodic_runs(table(spark, rows)).collect()}
    assert got[1] == [(0, 1, 20_000)]
    assert (0, 3001, 7 * 3001) in got[2]
    assert got[3] == [(0, 2, 18_000), (18_001, 3, 15_000)]


def test_runs_of_nothing(spark):
    assert period_runs.op12_tiled_periods(table(spark, [])).count() == 0


# -- sharding ----------------------------------------------------------------------------


def brute_shards(rows, shards=16):
    """Plain schedule of all groups through one heap."""
    sizes = collections.Counter()
    for _, t in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    heap, out = [(0, s) for s in range(shards)], {}
    for t in sorted(sizes, key=lambda t: (-sizes[t], hashlib.sha256(t.encode()).digest())):
        load, s = heapq.heappop(heap)
        out[t] = s
        heapq.heappush(heap, (load + sizes[t], s))
    return out


@pytest.mark.parametrize("which", ["odd", "real"])
@pytest.mark.parametrize("items", [1 << 30, 64])
def test_shards(which, items, request, monkeypatch):
    docs = request.getfixturevalue(which)
    monkeypatch.setattr(shard_schedule, "ITEMS", items)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = shard_schedule.op13_longest_first(docs).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    load, slots, group = collections.Counter(), collections.defaultdict(list), {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert group.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if items > 64:   # every group is an item of its own here
        want = brute_shards(rows)
        assert group == {(len(t.encode()) + 1, zlib.crc32(t.encode())): s for t, s in want.items()}
    if which == "real":
        assert max(load.values()) <= 1.35 * min(load.values())


def test_a_hot_group_fills_its_shard_alone(spark):
    rows = [(1, "hot " * 50)] * 4000 + [(i, f"text {i}") for i in range(2000)]
    got = shard_schedule.shard_documents(table(spark, rows)).groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("s"), F.count("*").alias("n")).collect()
    cold = sorted(r.b for r in got)[:-1]
    assert all(r.s == r.n - 1 for r in got) and cold[-1] - cold[0] < 60


def test_shards_of_nothing(spark):
    assert shard_schedule.op13_longest_first(table(spark, [])).count() == 0
