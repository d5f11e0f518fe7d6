"""URL filter: rules first, then naive Bayes over segmented names.

A rule decides the urls it fits.  For the rest, host and path are cut into names;
a unigram Viterbi pass splits each distinct name into words (``casinowin`` into
``casino`` and ``win``) by word counts of the pages' own text; multinomial naive
Bayes adds up the words' log odds.  It is trained on all urls: those with a word
of the seed list count as unwanted, all others as wanted, so words that keep
company with seed words count against a url as well.  The labels do not judge
themselves: seed words are left out of the counts and carry fixed odds instead (what
is known about them beforehand), and a url's own words are taken out of its class
before it is judged, so its company counts as it occurs in other urls.  (Rules are a
site's policy on whole domains and languages; they are no training labels.)

Names are split once for each distinct name, and urls are judged once for each
distinct url, so hot names and urls are single rows; a word's counts are summed in
tasks before they shuffle, and the joins on words and urls have equi-keys that the
skew join splits.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfold.llm.common import ASCII_UPPER, ship_package, stash

#: Fixed values of the query: (verdict, rule).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Words that mark a training url as unwanted; they also enter the unigram counts once.
SEEDS = """ads adserver adult affiliate bet bets betting casino cialis escort gambling jackpot loan loans lottery malware
    phishing pills poker porn pornhub roulette sex slots spam spyware sweepstakes track tracker tracking viagra warez webcam
    xxx""".split()
#: Log odds of block over allow that a seed word carries.
SEED_ODDS = 4.0
#: Longest word that a name is split into, in characters.
MAX_WORD = 24


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty where there is no ``://`` or the url is null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty as for the host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls.  A rule is
    ``host/path``; it fits the host and its subdomains where the path starts with
    the rule's path.  The rule list is a small parameter."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def names(kind: str, text: Column) -> Column:
    """Names of a host or path as ``kind:name``: runs of letters; a run of digits is ``#``."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{N}+"), F.lit(0))
    return F.transform(runs, lambda r: F.concat(F.lit(kind + ":"), F.when(r.rlike(r"^\p{N}"), F.lit("#")).otherwise(ascii_lower(r))))


def split_name(name: str, counts: dict[str, int], total: int) -> list[str]:
    """Most probable words of a name under a unigram model.  A string never seen
    as a word has probability 10 / (total * 10**length)."""
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        top, at = -math.inf, end - 1
        for start in range(max(0, end - MAX_WORD), end):
            c = counts.get(name[start:end])
            p = best[start] + (math.log10(c / total) if c else 1 - math.log10(total) - (end - start))
            if p > top:
                top, at = p, start
        best.append(top)
        back.append(at)
    words, end = [], len(name)
    while end:
        words.append(name[back[end]:end])
        end = back[end]
    return words[::-1]


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n): words, runs of letters, of all pages' text outside tags."""
    text = F.lower(F.regexp_replace(F.col(f"`{html_col}`"), r"<[^>]*>", " "))
    return pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")) \
        .filter((F.col("word") != "") & (F.char_length("word") <= MAX_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def segment(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names ``kind:name`` by the unigram counts."""
    ship_package(found.sparkSession)
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    plain = found.select("name", F.substring_index("name", ":", -1).alias("s"))
    parts = plain.select("name", "s", F.explode_outer(F.filter(F.sequence(F.lit(1), F.char_length("s")), lambda i: i >= 1)).alias("i")) \
        .select("name", F.explode_outer(F.transform(
            F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.char_length("s") - F.col("i") + 1)),
            lambda k: F.substring(F.col("s"), F.col("i"), k))).alias("word"))
    known = parts.distinct().join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    rows = plain.join(known, "name", "left").select("name", "s", "known")

    def run(batches):
        for batch in batches:
            words = []
            for s, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words.append(["#"] if s == "#" else split_name(s, {k["word"]: k["n"] for k in known or ()}, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return rows.mapInArrow(run, "name string, words array<string>")


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, odds), one row per row of ``pages``.

    ``odds`` is the method's log odds of allow over block, null where a rule
    decides.  Odds of 0 or more allow.  Null urls, and urls without names, are
    judged by the classes' shares alone.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = stash(base.groupBy("url").agg(F.count("*").alias("n")).select("url", "n", host.alias("host"), path.alias("path"))
                 .select("*", rule.alias("rule"), verdict.alias("verdict")), "urls")
    held = urls.select("url", "n", "verdict", F.explode(F.concat(names("h", F.col("host")), names("p", F.col("path")))).alias("name"))
    counts = word_counts(pages, html_col).unionByName(spark.createDataFrame([(w, 1) for w in seeds], "word string, n long")) \
        .groupBy("word").agg(F.sum("n").alias("n"))
    words = stash(segment(held.select("name").distinct(), stash(counts, "counts")), "words")

    # tokens of urls: (url, n, verdict, word, c), words as kind:word
    spread = words.select("name", F.explode("words").alias("w")) \
        .select("name", F.concat(F.substring_index("name", ":", 1), F.lit(":"), F.col("w")).alias("word"))
    tokens = stash(held.join(spread, "name").groupBy("url", "word").agg(
        F.first("n").alias("n"), F.first("verdict").alias("verdict"), F.count("*").alias("c")), "tokens")
    # classes: a url with a seed word is unwanted; seed words take no part in the counts
    seed = F.substring_index("word", ":", -1).isin(*seeds)
    classed = tokens.groupBy("url").agg(F.max(seed).alias("bad"), F.sum(F.when(seed, 0).otherwise(F.col("c"))).alias("size"))
    known = stash(tokens.join(classed, "url"), "classed")
    company, bad = known.filter(~seed), F.col("bad")
    weight = F.col("n") * F.col("c")
    per_word = stash(company.groupBy("word").agg(F.sum(F.when(bad, 0).otherwise(weight)).alias("allow"),
                                                 F.sum(F.when(bad, weight).otherwise(0)).alias("block")), "odds")
    a, b, v = (x or 0 for x in per_word.agg(F.sum("allow"), F.sum("block"), F.count("*")).first())
    n_bad = classed.filter("bad").join(urls, "url").agg(F.sum("n")).first()[0] or 0
    n_all = urls.agg(F.sum("n")).first()[0] or 0
    prior = math.log((n_all - n_bad + 1) / (n_bad + 1))

    def share(count, total, own):
        """Log share of a word in a class, without what the url itself brought to it."""
        return F.log((F.col(count) - F.when(own, weight).otherwise(0) + 1.0)
                     / (F.lit(float(total + v + 1)) - F.when(own, F.col("n") * F.col("size")).otherwise(0)))

    open_ = F.col("verdict").isNull()
    by_company = company.filter(open_).join(per_word, "word") \
        .select("url", (F.col("c") * (share("allow", a, ~bad) - share("block", b, bad))).alias("odds"))
    by_seed = known.filter(open_ & seed).select("url", (F.col("c") * F.lit(-SEED_ODDS)).alias("odds"))
    open_urls = by_company.unionByName(by_seed).groupBy("url").agg(F.sum("odds").alias("odds"))
    scored = urls.join(open_urls.withColumnRenamed("url", "_u"), F.col("url").eqNullSafe(F.col("_u")), "left") \
        .select(F.col("url").alias("_u"), "host", "path", "rule", "verdict",
                F.when(F.col("verdict").isNull(), F.coalesce("odds", F.lit(0.0)) + prior).alias("odds"))
    return base.join(scored, F.col("url").eqNullSafe(F.col("_u"))).select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("odds") >= 0, "allow").otherwise("block")).alias("verdict"), "odds")


def op3_host_words(pages: DataFrame) -> DataFrame:
    return judge(pages)
