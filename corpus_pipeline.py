"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents.

Defined cases, in every stage: a null text counts as empty (it isn't toxic, equals the empty text, has
no words and thus isn't mixed); a null doc_id or source is a value like any other, except that a
labelled document needs an id; texts are read whole; rows that repeat a doc_id are documents each, in
the mix too (but for those equal in id and text, on which its cut falls); other columns, whatever their names, are carried up to the last stage; an
empty table, or one without labels, goes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe_automaton, exact_dedup, fair_mix, near_dedup, toxicity
from siltstone.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of these documents, doesn't reject."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar texts, the row with the smallest doc_id."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as many times, none to twice, as their source's share of the mix takes them."""
    return fair_mix.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of the mix."""
    return bpe_automaton.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: SQL expresses neither the classifier nor the near-duplicate classes nor the tokens; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", docs if i else None)
    return STAGES[-1][1](spark, docs, sf_dir)
