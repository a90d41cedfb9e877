"""Vectors from an outside model: the hook, its checks, and the check of a stored index."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gates import duplicates, together, violation
from .retrieval import bank_scores, bm25, dense, dot, tfidf

ROLES = ("query", "document")


class Embedder(Protocol):
    """identity names model and settings; embed returns for each text (place in the batch, vector), in any order."""

    identity: str

    def embed(self, texts: Sequence[str], role: str) -> Sequence[tuple[int, Sequence[float]]]: ...


def unit_vectors(reply: Sequence[tuple[int, Sequence[float]]], n: int, size: int | None = None) -> list[list[float]]:
    """The reply's vectors in the order of their places, each of length 1; rejects what isn't one finite vector of one size for each place."""
    if len(reply) != n:
        raise ValueError("the reply's count isn't the input's")
    out: list = [None] * n
    for place, vector in reply:
        if type(place) is not int or not 0 <= place < n or out[place] is not None:
            raise ValueError("places in the reply are missing, repeated or invalid")
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in vector):
            raise ValueError("a vector holds something else than finite numbers")
        norm = math.sqrt(sum(x * x for x in vector))
        if not norm:
            raise ValueError("a vector is zero")
        if size is not None and len(vector) != size:
            raise ValueError("vectors differ in size")
        size = len(vector)
        out[place] = [x / norm for x in vector]
    return out


def embedded(texts: DataFrame, embedder: Embedder, role: str, batch: int = 64) -> DataFrame:
    """doc_id, text_sha256, embedder, vector.  Texts must not be empty; a task's vectors must have one size."""
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}")
    identity = embedder.identity

    def run(batches):
        size = None
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                given = part.column("text").to_pylist()
                if any(not t or not t.strip() for t in given):
                    raise ValueError("an empty text has no vector")
                vectors = unit_vectors(embedder.embed(given, role), len(given), size)
                size = len(vectors[0])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_sha256"), pa.array(vectors, pa.list_(pa.float64()))], ["doc_id", "text_sha256", "vector"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("text_sha256"))
    return rows.mapInArrow(run, "doc_id long, text_sha256 string, vector array<double>").select("doc_id", "text_sha256", F.lit(identity).alias("embedder"), "vector")


def index_problems(index: DataFrame, texts: DataFrame, identity: str, size: int) -> DataFrame:
    """rule, entity_id, detail: an index must hold just the texts, once each, unchanged, as unit vectors of one size from one embedder."""
    c = F.col
    both = index.join(texts.select("doc_id", F.sha2("text", 256).alias("_sha")), "doc_id", "full_outer")
    there = c("vector").isNotNull()
    rules = {
        "not_indexed": ~there,
        "unknown_text": there & c("_sha").isNull(),
        "stale": there & (c("text_sha256") != c("_sha")),
        "embedder": there & (c("embedder") != identity),
        "size": there & (F.size("vector") != size),
        "not_unit": there & ~F.coalesce(F.abs(dot(c("vector"), c("vector")) - 1) <= 1e-6, F.lit(False)),
    }
    again = violation(duplicates(index, "doc_id"), "indexed_twice", c("doc_id"), c("n"))
    return together(*[violation(both.where(rule), name, c("doc_id"), c("embedder")) for name, rule in rules.items()], again)


# Ways to answer by retrieval: a table of functions that nothing changes at run time.
STRATEGIES: dict[str, Callable] = {"bm25": bm25, "tfidf": tfidf, "dense": dense, "bank": bank_scores}


def retrieve(method: str, queries: DataFrame, records: DataFrame, strategies: dict[str, Callable] | None = None, **options) -> DataFrame:
    """Ranks by a named method; strategies adds to the known ones, or replaces them, for this call only."""
    known = STRATEGIES | (strategies or {})
    if method not in known:
        raise ValueError(f"unknown method {method!r}: one of {sorted(known)}")
    return known[method](queries, records, **options)
