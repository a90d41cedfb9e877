"""The pipeline's stages, each against a plain version on what the stage before it kept."""

import zlib
from collections import Counter

import corpus_pipeline

from siltstone.llm.common import table
from tests.llm.test_ops import classes_by_force

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR).cache()
        rows, before = out.collect(), docs.collect()
        if name != "encode":
            assert out.columns == columns
            known = {r["doc_id"]: r["text"] for r in before}
            assert all(known[r["doc_id"]] == r["text"] for r in rows)
        if name == "exact_dedup":
            last = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                last[zlib.crc32((r["text"] or "").lower().encode()), len(r["text"] or "")] = r["doc_id"]
            assert {r["doc_id"] for r in rows} == set(last.values())
        if name == "near_dedup":
            assert {r["doc_id"] for r in rows} == {first for _, first, _ in classes_by_force(docs)}
        if name == "mix":
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
        kept.append(len(rows))
        docs = out
    assert kept[0] < 200 and kept[1] < kept[0] and kept[4] == kept[3]
    assert corpus_pipeline.run(spark, DIR).count() == kept[-1]
