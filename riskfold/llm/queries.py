"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers

from riskfold.llm import (backoff_lm, bpe, jaccard_join, language_codes, line_crf, line_runs, packing, period_runs, shard_schedule,
                          site_templates, spelling_variants, url_filter, vector_graph)
from riskfold.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def op1_squares_packing(spark, sf_dir):
    return packing.op1_squares_packing(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_bpe_codec(spark, sf_dir):
    return bpe.op2_bpe_codec(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_host_words(spark, sf_dir):
    return url_filter.op3_host_words(table(spark, sf_dir, "pages"))


def op4_flat_graph(spark, sf_dir):
    return vector_graph.op4_flat_graph(table(spark, sf_dir, "embeddings"))


def op5_order_filters(spark, sf_dir):
    return jaccard_join.op5_order_filters(table(spark, sf_dir, "documents"))


def op6_line_crf(spark, sf_dir):
    return line_crf.op6_line_crf(spark, table(spark, sf_dir, "documents"), sf_dir)


def op7_language_codes(spark, sf_dir):
    return language_codes.op7_language_codes(table(spark, sf_dir, "documents"))


def op8_backoff_automaton(spark, sf_dir):
    return backoff_lm.op8_backoff_automaton(table(spark, sf_dir, "documents"))


def op9_line_runs(spark, sf_dir):
    return line_runs.op9_line_dedup(table(spark, sf_dir, "documents"))


def op10_site_templates(spark, sf_dir):
    return site_templates.op10_site_templates(table(spark, sf_dir, "pages"))


def op11_bloom_neighbours(spark, sf_dir):
    return spelling_variants.op11_bloom_neighbours(table(spark, sf_dir, "documents"))


def op12_tiled_periods(spark, sf_dir):
    return period_runs.op12_tiled_periods(table(spark, sf_dir, "documents"))


def op13_longest_first(spark, sf_dir):
    return shard_schedule.op13_longest_first(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_squares_packing, op2_bpe_codec, op3_host_words, op4_flat_graph, op5_order_filters, op6_line_crf, op7_language_codes,
    op8_backoff_automaton, op9_line_runs, op10_site_templates, op11_bloom_neighbours, op12_tiled_periods, op13_longest_first)}
ORACLE = {"op9_line_runs": line_runs.OP9_SQL}
