"""Embedding near-duplicates by a robust-pruned flat graph.

Distinct vectors are dealt to their ``OVERLAP`` nearest of ``K`` centroids.  Each
shard builds a graph of its vectors: nearest and some far candidates, thinned by
robust pruning, with reverse edges.  The adjacency lists of a vector's shards are
united into the index.  Every vector is then a query: in its ``ROUTES`` nearest
shards, a greedy search from the shard's medoid (and from the query's own node,
which the index holds) finds its surroundings, and every node in range is expanded
until no new one turns up.  Links are verified in double precision.

Recall is audited: a bounded sample of vectors is counted by brute force against
all vectors in blocks.  Each linked vector has its own recall, vectors linked with
each other in the sample count as one group, and the mean over groups has to reach
``TARGET``; the sample grows until ``ENOUGH`` groups have links.  A lower recall
repeats the search with a wider beam and more routes, and after the widest search
all pairs of blocks are compared exactly.

Centroids come from a bounded sample (``SAMPLE`` vectors by hash).  A shard with more than ``BLOCK`` vectors is cut
into blocks by hash; its queries then visit each of its blocks.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import components, ship_package, stash

THRESHOLD = 0.9
SAMPLE = 20_000
SHARD, BLOCK, MAX_SHARDS = 1500, 8192, 4096
OVERLAP, ROUTES = 3, 2
DEGREE, NEAR, FAR, ALPHA, BEAM = 24, 40, 8, 1.2, 24
AUDIT, AUDIT_MOST, ENOUGH, TARGET = 256, 8192, 64, 0.95
EXACT_BLOCK = 4096
LOG = logging.getLogger(__name__)


def unit_rows(vectors: DataFrame, kind: str) -> DataFrame:
    """(id, v): unit vectors in double precision as bytes; v is null for vectors
    that are null, empty, zero, or hold null or non-finite components."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = None
                if x and None not in x:
                    a = np.array(x, np.float64)
                    top = np.abs(a).max()
                    if np.isfinite(a).all() and top > 0:
                        a = a / top                      # keeps the norm of huge or tiny vectors finite
                        v = (a / np.sqrt((a * a).sum())).tobytes()
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "v"])

    return vectors.mapInArrow(run, f"id {kind}, v binary")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of the sample from evenly spaced starts."""
    sample = sample[np.lexsort(sample.T[::-1])]
    mid = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ mid.T).argmax(1)
        for c in range(k):
            mean = sample[own == c].sum(0)
            norm = np.sqrt((mean * mean).sum())
            if norm > 0:
                mid[c] = mean / norm
    return mid


def robust_prune(x: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each node: candidates come nearest first, and one is passed
    over if a chosen neighbour is nearer to it, by ``alpha``, than the node is."""
    out = []
    for at in range(0, len(x), 256):
        cand = near[at:at + 256]
        vec = x[cand]
        away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", vec, x[at:at + 256])))
        order = np.argsort(away, 1, kind="stable")
        cand, away = np.take_along_axis(cand, order, 1), np.take_along_axis(away, order, 1)
        vec = x[cand]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1))))
        alive = cand != np.arange(at, at + len(cand))[:, None]
        chosen, count = np.zeros_like(alive), np.zeros(len(cand), int)
        for j in range(cand.shape[1]):
            take = alive[:, j] & (count < degree)
            chosen[take, j] = True
            count += take
            alive &= ~(take[:, None] & (alpha * between[:, j] <= away))
        out += [c[m] for c, m in zip(cand, chosen, strict=True)]
    return out


def build(x: np.ndarray) -> list[np.ndarray]:
    """Graph of one block of unit vectors: pruned neighbours and reverse edges."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    near = []
    k = min(NEAR + 1, n)
    for at in range(0, n, 1024):
        near.append(np.argpartition(-(x[at:at + 1024] @ x.T), k - 1, 1)[:, :k])
    far = np.random.default_rng(n).integers(0, n, (n, FAR))
    pruned = robust_prune(x.astype(np.float32), np.concatenate([np.concatenate(near), far], 1))
    source = np.repeat(np.arange(n), [len(p) for p in pruned])
    target = np.concatenate(pruned)
    edges = np.unique(np.stack([np.concatenate([source, target]), np.concatenate([target, source])]), axis=1)
    cut = np.searchsorted(edges[0], np.arange(n + 1))
    lists = [edges[1][a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return [p if len(p) <= 2 * DEGREE else p[np.argsort(-(x[p] @ x[i]), kind="stable")[:2 * DEGREE]] for i, p in enumerate(lists)]


def range_search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, own: np.ndarray, beam: int,
                 least: float) -> list[np.ndarray]:
    """Nodes within ``least`` of each query.  ``own``: the query's node in this block, or -1."""
    n = len(x)
    width = max(1, max(map(len, lists), default=1))
    graph = np.full((n, width), -1)
    for i, p in enumerate(lists):
        graph[i, :len(p)] = p
    x32, mean = x.astype(np.float32), x.sum(0)
    medoid = int((x @ mean).argmax())
    found: list[np.ndarray] = []
    slack = least - 1e-4
    for at in range(0, len(queries), 512):
        q, mine = queries[at:at + 512].astype(np.float32), own[at:at + 512]
        b = len(q)
        rows = np.arange(b)
        visited = np.zeros((b, n), bool)
        ids = np.stack([np.full(b, medoid), np.where(mine >= 0, mine, medoid)], 1)
        sims = np.einsum("brd,bd->br", x32[ids], q)
        sims[:, 1] = np.where(ids[:, 1] == ids[:, 0], -2, sims[:, 1])
        visited[rows, ids[:, 0]] = visited[rows, ids[:, 1]] = True
        open_ = sims > -2
        hits = [(np.nonzero(sims >= slack)[0], ids[sims >= slack])]
        while open_.any():
            pick = np.where(open_, sims, -3).argmax(1)
            live = open_[rows, pick]
            open_[rows, pick] = False
            nb = np.where(live[:, None], graph[ids[rows, pick]], -1)
            fresh = (nb >= 0) & ~visited[rows[:, None], nb]
            visited[np.nonzero(fresh)[0], nb[fresh]] = True
            s = np.full(nb.shape, -2, np.float32)
            r, c = np.nonzero(fresh)
            s[r, c] = np.einsum("ed,ed->e", x32[nb[r, c]], q[r])
            hit = s >= slack
            if hit.any():
                hits.append((np.nonzero(hit)[0], nb[hit]))
            ids, sims = np.concatenate([ids, nb], 1), np.concatenate([sims, s], 1)
            open_ = np.concatenate([open_, fresh], 1)
            if ids.shape[1] > beam:
                top = np.argpartition(-sims, beam - 1, 1)[:, :beam]
                ids, sims, open_ = (np.take_along_axis(y, top, 1) for y in (ids, sims, open_))
        who, node = np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])
        order = np.argsort(who, kind="stable")
        who, node = who[order], node[order]
        for i in range(b):
            a, z = np.searchsorted(who, [i, i + 1])
            inside = np.unique(node[a:z])
            edge = inside
            seen = visited[i]
            while len(edge):                             # range expansion
                nb = graph[edge].ravel()
                nb = np.unique(nb[nb >= 0])
                nb = nb[~seen[nb]]
                seen[nb] = True
                edge = nb[x32[nb] @ q[i] >= slack]
                inside = np.concatenate([inside, edge])
            found.append(inside[x[inside] @ queries[at + i] >= least] if len(inside) else inside)
    return found


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = THRESHOLD):
    """(rows, nodes, pairs): ``rows`` (id, v) of the input, ``nodes`` (rep, copies, v) of the distinct
    vectors, ``pairs`` (a, b) of linked distinct vectors, a < b."""
    spark = vectors.sparkSession
    ship_package(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = stash(unit_rows(vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("e")), kind), "units")
    usual = rows.filter("v is not null and id is not null").groupBy(F.length("v").alias("size")).count().orderBy(
        F.desc("count"), "size").first()
    nodes = rows.filter(F.length("v") == (usual["size"] if usual else -1)).filter("id is not null") \
        .groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    nodes = stash(nodes.select("rep", "copies", "v"), "vectors")
    n = nodes.count()
    empty = spark.createDataFrame([], f"a {kind}, b {kind}")
    if n < 2:
        return rows, nodes, empty
    k = int(min(MAX_SHARDS, max(1, round(n / SHARD))))
    unit = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    sample = nodes.filter(unit < int(min(1.0, SAMPLE / n) * (1 << 30))).select("v").collect()
    sample = np.frombuffer(b"".join(bytes(r.v) for r in sample), np.float64).reshape(-1, usual["size"] // 8) if sample else None
    mid = centroids(sample, min(k, len(sample))) if sample is not None else np.ones((1, usual["size"] // 8))

    def deal(batches):
        for batch in batches:
            x = matrix(batch.column(2))
            near = np.argsort(-(x @ mid.T), 1, kind="stable")[:, :OVERLAP]
            width = near.shape[1]
            take = np.repeat(np.arange(len(x)), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take)), batch.column(2).take(pa.array(take)), pa.array(near.ravel().astype(np.int32)),
                 pa.array(np.tile(np.arange(width, dtype=np.int32), len(x)))], ["rep", "v", "shard", "rank"])

    dealt = stash(nodes.select("rep", "copies", "v").mapInArrow(deal, f"rep {kind}, v binary, shard int, rank int"), "dealt")
    # number of blocks of each shard: at most MAX_SHARDS rows
    cuts = dealt.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.join(F.broadcast(cuts), "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def graph(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        ids = t.column("rep").combine_chunks()
        lists = build(matrix(t.column("v")))
        flat = ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
        ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
        return pa.table({"rep": ids, "out": pa.ListArray.from_arrays(ends, flat)})

    adjacency = dealt.select("shard", "block", "rep", "v").groupBy("shard", "block") \
        .applyInArrow(graph, f"rep {kind}, out array<{kind}>")
    # a node has at most OVERLAP lists of bounded length
    index = stash(adjacency.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out")), "index")

    def run(routes: int, beam: int) -> DataFrame:
        held = dealt.select("shard", "block", "rep", "v").join(index, "rep").withColumn("ask", F.lit(False))
        asked = dealt.filter(F.col("rank") < routes).select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "v",
            F.lit(None).cast(f"array<{kind}>").alias("out"), F.lit(True).alias("ask"))

        def search(t: pa.Table) -> pa.Table:
            ask = t.column("ask").to_numpy()
            here = t.filter(pa.array(~ask)).sort_by("rep")
            q = t.filter(pa.array(ask)).sort_by("rep")
            ids = here.column("rep").to_pylist()
            place = {r: i for i, r in enumerate(ids)}
            lists = [np.array([place[o] for o in out if o in place], np.int64) for out in here.column("out").to_pylist()]
            who = q.column("rep").to_pylist()
            if not ids or not who:
                return pa.table({"a": t.column("rep").slice(0, 0), "b": t.column("rep").slice(0, 0)})
            got = range_search(matrix(here.column("v")), lists, matrix(q.column("v")),
                               np.array([place.get(r, -1) for r in who]), beam, least)
            left = np.repeat(np.arange(len(who)), [len(g) for g in got])
            pair = pa.table({"a": q.column("rep").combine_chunks().take(pa.array(left)),
                             "b": here.column("rep").combine_chunks().take(pa.array(np.concatenate([np.zeros(0, np.int64), *got])))})
            return pair

        hits = held.unionByName(asked).groupBy("shard", "block").applyInArrow(search, f"a {kind}, b {kind}")
        return stash(hits.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    audit, proven = audited(nodes, least, kind, n)
    # too few linked groups to judge by: the widest search at once
    routes, beam = (ROUTES, BEAM) if proven else (OVERLAP, 8 * BEAM)
    while True:
        pairs = run(routes, beam)
        share = recall(pairs, audit, kind)
        if share >= TARGET:
            return rows, nodes, pairs
        if routes >= OVERLAP and beam >= 8 * BEAM:
            LOG.warning("recall %.3f after the widest search: all pairs of blocks are compared", share)
            return rows, nodes, exact_pairs(nodes, least, kind, n)
        routes, beam = OVERLAP, 2 * beam


def audit_counts(nodes: DataFrame, least: float, kind: str, size: int) -> list[tuple]:
    """(rep, group, n) of the linked vectors of a sample of ``size``: the number of distinct vectors
    linked with each, by brute force, and the first of the sample that it is linked with."""
    sample = sorted(((r.rep, bytes(r.v)) for r in nodes.orderBy(F.xxhash64("rep"), "rep").limit(size).collect()))
    ids, x = [r for r, _ in sample], np.frombuffer(b"".join(v for _, v in sample), np.float64).reshape(len(sample), -1)
    step = max(1, (1 << 22) // len(ids))

    def run(batches):
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            y = matrix(batch.column(0))
            for at in range(0, len(y), step):
                total += (x @ y[at:at + step].T >= least).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int32()), pa.array(total)], ["i", "n"])

    counted = nodes.select("v").mapInArrow(run, "i int, n long").groupBy("i").agg((F.sum("n") - 1).alias("n"))
    linked = sorted((r.i, r.n) for r in counted.collect() if r.n > 0)
    x = x[[i for i, _ in linked]]
    group = np.full(len(linked), -1)
    for i in range(len(linked)):
        if group[i] < 0:
            group[(group < 0) & (x @ x[i] >= least)] = i
            group[i] = i
    return [(ids[i], int(g), n) for (i, n), g in zip(linked, group, strict=True)]


def audited(nodes: DataFrame, least: float, kind: str, n: int) -> tuple[list[tuple], bool]:
    """The audit, and whether it can be judged by: it has ``ENOUGH`` groups or holds all vectors."""
    size = AUDIT
    while True:
        audit = audit_counts(nodes, least, kind, size)
        proven = size >= n or len({g for _, g, _ in audit}) >= ENOUGH
        if proven or size >= AUDIT_MOST:
            return audit, proven
        size = min(4 * size, AUDIT_MOST)


def recall(pairs: DataFrame, audit: list[tuple], kind: str) -> float:
    """Mean over the audit's groups of their vectors' mean recall; 1 where nothing is linked."""
    if not audit:
        return 1.0
    who = pairs.sparkSession.createDataFrame([(r,) for r, _, _ in audit], f"rep {kind}")
    have = {r.rep: r["count"] for r in pairs.select(F.explode(F.array("a", "b")).alias("rep")).join(F.broadcast(who), "rep")
            .groupBy("rep").count().collect()}
    groups: dict[int, list[float]] = {}
    for r, g, n in audit:
        groups.setdefault(g, []).append(min(1.0, have.get(r, 0) / n))
    return float(np.mean([np.mean(x) for x in groups.values()]))


def exact_pairs(nodes: DataFrame, least: float, kind: str, n: int) -> DataFrame:
    """All linked pairs (a, b), a < b, by brute force; each pair of blocks is one task."""
    blocks = max(1, -(-n // EXACT_BLOCK))
    own = nodes.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "v")

    def compare(t: pa.Table) -> pa.Table:
        i, j, block = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("block").to_numpy()
        left, right = t.filter(pa.array(block == i)), t.filter(pa.array(block == j))
        x, y = matrix(left.column("v")), matrix(right.column("v"))
        at_x, at_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(x) if len(y) else 0, 512):
            r, c = np.nonzero(x[at:at + 512] @ y.T >= least)
            r += at
            keep = r < c if i == j else slice(None)
            at_x.append(r[keep])
            at_y.append(c[keep])
        return pa.table({"a": left.column("rep").take(pa.array(np.concatenate(at_x))),
                         "b": right.column("rep").take(pa.array(np.concatenate(at_y)))})

    found = sent.groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}")
    return stash(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "exact")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors that are null, empty, zero, hold null or non-finite components, or
    whose length is not the table's most frequent one link with nothing, and
    neither do rows with a null id.
    """
    rows, nodes, pairs = links(vectors, id_col, vec_col, least)
    size = nodes.select("rep", "copies")
    near = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("o")),
                                          F.struct(F.col("b").alias("rep"), F.col("a").alias("o")))).alias("p")).select("p.*")
    n_near = near.join(size.toDF("o", "c"), "o").groupBy("rep").agg(F.sum("c").alias("near"))
    roots = components(pairs).toDF("rep", "root")
    known = nodes.join(n_near, "rep", "left").join(roots, "rep", "left").select(
        "v", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("component"))
    own = rows.join(known, "v", "left")
    valid = F.col("component").isNotNull() & F.col("id").isNotNull()
    return own.select(F.col("id").alias(id_col), F.when(valid, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      F.when(valid, F.col("component")).otherwise(F.col("id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op4_flat_graph(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
