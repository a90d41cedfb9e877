"""The registered queries of this package, each with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe_automaton, exact_dedup, fair_mix, fair_packing, hilbert_shards, importance_draw, near_dedup, pane_revisions, quality, token_store, toxicity, url_graph, vector_search
from .common import table


def op1_fair_mix(spark, sf_dir):
    rows = fair_mix.plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_url_graph(spark, sf_dir):
    return url_graph.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_token_store(spark, sf_dir):
    return token_store.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_hilbert_shards(spark, sf_dir):
    return hilbert_shards.shards(table(spark, sf_dir, "documents")).drop("curve")


def op5_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe_automaton(spark, sf_dir):
    return bpe_automaton.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_vector_search(spark, sf_dir):
    return vector_search.search(table(spark, sf_dir, "embeddings"))


def op8_near_dedup(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def op11_fair_packing(spark, sf_dir):
    return fair_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_pane_revisions(spark, sf_dir):
    return pane_revisions.revisions(table(spark, sf_dir, "clicks"))


def op13_importance_draw(spark, sf_dir):
    return importance_draw.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_fair_mix, op2_url_graph, op3_token_store, op4_hilbert_shards, op5_toxicity, op6_bpe_automaton, op7_vector_search, op8_near_dedup, op9_quality, op10_exact_dedup, op11_fair_packing, op12_pane_revisions, op13_importance_draw)}

ORACLES = {"op1_fair_mix": fair_mix.SQL, "op2_url_graph": url_graph.SQL, "op4_hilbert_shards": hilbert_shards.SQL, "op10_exact_dedup": exact_dedup.SQL, "op12_pane_revisions": pane_revisions.SQL, "op13_importance_draw": importance_draw.SQL}
