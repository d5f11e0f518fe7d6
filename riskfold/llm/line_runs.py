"""Line dedup over levelled sorted runs of line hashes (DataFrame operations only).

A line that is long enough and occurs in enough documents is kept in one
document, the one with the largest id, and removed from all others.  Documents
arrive in batches of falling ids.  The keys already owned live in *runs*: sorted
tables of (hash, owner), grouped in levels.  A new batch merge-anti-joins the
runs, and the keys that no run holds become a new run of level 0; when a level
has ``fanout`` runs they are merged into one run of the next level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import ASCII_UPPER, stash

_TRIM = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    plain = F.btrim(line, F.lit(_TRIM))
    # lower() changes A-Z only when the text is pure ASCII, and is then the faster form
    return F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)) \
        .otherwise(F.translate(plain, ASCII_UPPER, ASCII_UPPER.lower()))


def key_hash(key: Column) -> Column:
    """128 bits as two independent 64-bit hashes."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Runs of owned keys: ``levels[i]`` is a list of sorted tables (h1, h2, owner)."""

    def __init__(self, spark, fanout: int = 2):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def held(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h1, h2, owner), one row per key.  Adds the keys not yet held."""
        fresh = batch
        for run in (r for level in self.levels for r in level):
            fresh = fresh.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(fresh, 0))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            merged = self._write(reduce(DataFrame.unionByName, self.levels[at]), at + 1)
            self.levels[at] = []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(merged)
            at += 1

    def _write(self, rows: DataFrame, level: int) -> DataFrame:
        return stash(rows.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"), f"run{level}")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Remove repeated lines; returns ``docs`` as struct ``row``, with ``lines``
    (array, before dropping) and ``kept`` (array of the lines that stay).

    Null or empty text is one empty line.  Short lines are never dropped.  A key's
    documents are counted by distinct id, so repeated rows of one document count
    once, and rows of the owning id all keep the line.  Rows with a null id count
    as one document that owns a line only when no other document holds it.
    Any further columns stay inside ``row``, whatever their names.
    """
    spark = docs.sparkSession
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    lines = base.select(F.col(f"row.`{id_col}`").alias("id"), F.explode(F.split(text, "\n")).alias("line")) \
        .filter(F.octet_length("line") >= min_chars).select("id", line_key(F.col("line")).alias("key")) \
        .filter(F.char_length("key") >= min_chars).select("id", key_hash(F.col("key")).alias("k"))
    uses = stash(lines.select("id", "k.*").groupBy("h1", "h2", "id").agg(F.count("*").alias("n")).drop("n"), "uses")
    often = uses.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    # written first, so that the join has a shuffle of its own on both sides and a hot line can be split
    often = stash(often.select("h1", "h2"), "often")
    held = stash(uses.join(often, ["h1", "h2"]), "held")

    cuts = held.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    runs = LineRuns(spark, fanout)
    tops = [None, *cuts]
    for top, low in zip(tops, [*cuts, None], strict=True):
        part = held
        if top is not None:
            part = part.filter((F.col("id") <= top) | F.col("id").isNull() if low is None else F.col("id") <= top)
        if low is not None:
            part = part.filter(F.col("id") > low)
        runs.add(part.groupBy("h1", "h2").agg(F.max("id").alias("owner")))

    drops = held.join(runs.held(), ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("owner"))) \
        .groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    joined = base.alias("b").join(drops, F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")), "left")
    split = joined.select("row", "drops", F.split(text, "\n").alias("lines"))

    def stays(line: Column) -> Column:
        key = line_key(line)
        return ~((F.octet_length(line) >= min_chars) & (F.char_length(key) >= min_chars)
                 & F.array_contains(F.col("drops"), key_hash(key)))

    return split.select("row", "lines", F.when(F.col("drops").isNull(), F.col("lines"))
                        .otherwise(F.filter("lines", stays)).alias("kept"))


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs)
    return out.select("row.doc_id", F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
                      F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated lines; ``n_chars`` follows the text."""
    out = dedup_lines(docs)
    changed = F.size("kept") < F.size("lines")
    new = {"text": F.array_join("kept", "\n"), "n_chars": F.char_length(F.array_join("kept", "\n")).cast("long")}
    return out.select(*[F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`")
                        for c in docs.columns])


OP9_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.owner AS gone
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
