"""Corpus preparation as a chain of operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  Quality rules and language
ID drop the documents they reject, line dedup shortens texts, the near-duplicate
stage keeps one document of each group, and packing returns pieces in sequences.
"""

from __future__ import annotations

from riskfold.llm import jaccard_join, language_codes, line_crf, line_runs, packing
from riskfold.llm.common import stash, table

STAGES = [
    ("quality rules", line_crf.stage),
    ("language ID", language_codes.stage),
    ("line dedup", line_runs.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("best-fit packing", packing.stage),
]
#: Trained classifiers and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
