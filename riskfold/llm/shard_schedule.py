"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) go, by falling size, to the least
loaded shard, taken from a heap.  Groups larger than 1/65536 of all bytes are items
of their own, so there are fewer than 65536 of them; the smaller groups are dealt
by hash into bundles of about that size, at most 65536.  The heap therefore sees a
bounded number of items at every input size, and where no group is smaller than
that share the schedule is the plain one over all groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from riskfold.llm.common import stash

ITEMS = 1 << 16        # a group of more than 1 / ITEMS of all bytes is scheduled alone
SLOT_BUCKETS = 1024    # parts of a shard that are numbered side by side


def longest_first(sizes: list[tuple], shards: int) -> list[int]:
    """Shard of each item ``(size, name)``: largest first (ties by name), each to the least loaded shard (ties to the lowest)."""
    out = [0] * len(sizes)
    heap = [(0, s) for s in range(shards)]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], sizes[i][1])):
        load, s = heap[0]
        out[i] = s
        heapq.heapreplace(heap, (load + sizes[i][0], s))
    return out


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``size``: UTF-8 bytes of the text plus 1.  A null text is an empty one, and both are
    one group.  Repeated rows each get a slot; a null id is kept; ties between groups go by
    their digest.  The law is ``bytes``: sizes of shards are as equal as whole groups
    allow, so a group above the mean share fills its shard alone.  Slots count from 0
    without gaps in each shard.  ``grown_shard`` is null under this law.  Further columns
    are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
                       (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # equal rows are one row with a multiplicity: copies of a hot row never meet in a task
    rows = stash(rows.groupBy("doc_id", "digest", "size", "text_crc32").agg(F.count("*").alias("copies")), "shard-rows")
    groups = stash(rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") * ITEMS > total
    small = groups.filter(~large).agg(F.sum("bytes")).first()[0] or 0
    bundles = max(1, -(-small * ITEMS // max(1, total)))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles))

    alone = [(r["bytes"], r["digest"]) for r in groups.filter(large).collect()]                       # fewer than ITEMS
    packed = [(r["bytes"], r["bundle"]) for r in groups.filter(~large).groupBy(bundle.alias("bundle"))
              .agg(F.sum("bytes").alias("bytes")).collect()]                                           # at most ITEMS
    names = [(n, b"a" + bytes(d)) for n, d in alone] + [(n, b"b" + b.to_bytes(8, "big")) for n, b in packed]
    where = longest_first(names, shards)
    of_group = spark.createDataFrame([(bytearray(d), s) for (_, d), s in zip(alone, where)], "digest binary, own int")
    of_bundle = spark.createDataFrame([(b, s) for (_, b), s in zip(packed, where[len(alone):])], "bundle long, shared int")

    placed = rows.join(F.broadcast(of_group), "digest", "left").withColumn("bundle", bundle) \
        .join(F.broadcast(of_bundle), "bundle", "left").withColumn("shard", F.coalesce("own", "shared")) \
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SLOT_BUCKETS)))
    placed = stash(placed.select("doc_id", "digest", "size", "text_crc32", "copies", "shard", "bucket"), "shard-placed")
    counts = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))                         # shards x SLOT_BUCKETS rows
    first = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "digest")
    numbered = placed.withColumn("to", F.sum("copies").over(inside)).join(F.broadcast(first), ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence(F.col("first") + F.col("to") - F.col("copies"), F.col("first") + F.col("to") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op13_longest_first(docs: DataFrame) -> DataFrame:
    return shard_documents(docs)
