"""Target-distribution importance resampling over hashed n-grams, with a ring of running CRC states.

A document is scanned once.  For each of its words the ring holds a CRC-32 state for each of the last
n starts; a state is extended by a space and the word, so that it is the CRC of the run from its
start to here, and the run's bucket is emitted, without any run being put together as a string.  The
buckets of each document are written once (two bytes each); counts of buckets over all documents and
over the target's texts give each bucket's gain, and a document's weight is the mean of its gains.
Documents are drawn without replacement by weight plus Gumbel noise, made from a hash of the id.

Counts, weights and draws cover all documents.  The driver sees the counts, a number for each bucket,
and a row count for each range of the final order, which one range partitioning makes.

Defined cases: null and empty texts have no words, no features, weight 0; a null doc_id hashes as
`7:null` and comes last among ties; rows that repeat a doc_id are documents each, with the same
noise, and tie by n_features; an empty table gives no rows, an empty target equal counts; other
columns are ignored by `weighed`, carried by `drawn`.
"""

from __future__ import annotations

import math
from array import array
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sql_pieces
from .common import cut, partitions, pieces

N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, "7"
#: Digits, letters and all that isn't ASCII are words, in lower case; the rest of ASCII separates them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def ring(text: bytes, n: int = N) -> tuple[array, int]:
    """The CRCs of all runs of 1 to n consecutive words of a UTF-8 text, by their last word, and the number of words."""
    found, states, words = array("I"), [], text.translate(_FOLD).split()
    kept = n - 1
    for word in words:
        more = b" " + word
        states = [crc32(more, state) for state in states[-kept:]] if kept else []
        states.append(crc32(word))
        found.extend(states)
    return found, len(words)


def scanned(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets (binary, little-endian, two bytes each, or four for more than 65,536 buckets)."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for batch in pieces(batches):
            words, features, packed = [], [], []
            for text in batch.column("text").to_pylist():
                crcs, n_words = ring(text or b"", n)
                words.append(n_words)
                features.append(len(crcs))
                packed.append((np.frombuffer(crcs, np.uint32) % buckets).astype(kind).tobytes() if crcs else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the rows of scanned(); each task sends one row for each bucket that it saw."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        seen = np.zeros(buckets, np.int64)
        for batch in pieces(batches):
            for packed in batch.column("buckets"):
                seen += np.bincount(np.frombuffer(packed.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    found = rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, 1000 times the logarithm of its share in the target over its share in the corpus, floored; shares are smoothed by one."""
    m, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + m) / ((s + 1.0) * (all_t + m)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document; target has a column text."""
    rows = cut(scanned(docs, n, buckets), "draw-buckets")
    target = scanned(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets)
    gain, kind = gains(counts(rows, buckets), counts(target, buckets)), "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for batch in pieces(batches):
            features = batch.column("n_features").to_numpy()
            sums = np.array([int(gain[np.frombuffer(b.as_buffer(), kind)].sum()) for b in batch.column("buckets")], np.int64)
            weights = np.where(features > 0, sums // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return cut(rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long"), "draw-weights", rows)


def noise(seed: str = SEED) -> Column:
    """Gumbel noise times 1000, floored, from a hash of the seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, n: int = N, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of each document."""
    spark = docs.sparkSession
    rows = weighed(docs, target, n, buckets).withColumn("score", F.col("weight") + noise(seed))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    fit = rows.where(F.col("n_words") >= least_words).select("doc_id", "n_features", "weight", "score")
    ranged = fit.repartitionByRange(partitions(spark), *order, F.rand(7)).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "draw-ranged")
    part = F.shiftright("_at", 33)
    found = sorted(tuple(r) for r in ranged.groupBy(part.alias("part")).agg(F.count("*")).collect())  # a row for each range
    upto = list(accumulate((c for _, c in found), initial=0))
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(found, upto)] or [(0, 0)], "_part long, _base long")
    rank = F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    ranked = ranged.join(F.broadcast(base), part == F.col("_part")).select("doc_id", "n_features", "weight", "score", F.when(rank <= upto[-1] * percent // 100, rank).alias("rank"))
    rest = rows.where(F.col("n_words") < least_words)
    return ranked.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of docs whose doc_id is drawn, whole; a row that repeats a drawn id goes with it."""
    ids = draw(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")


def _sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD}')"
    return f"""
WITH {sql_pieces.crc_table()},
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
df AS MATERIALIZED (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
k AS MATERIALIZED (SELECT f, {sql_pieces.crc32("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc_steps),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), m AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
         ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m USING (r)
), y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT doc_id, n_features, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS fit, y.weight, y.score FROM y WHERE words >= {LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= fit * {PERCENT} // 100 THEN rank::BIGINT END AS rank FROM z
UNION ALL SELECT doc_id, n_features::BIGINT, weight::BIGINT, score::BIGINT, NULL FROM y WHERE words < {LEAST_WORDS}
"""


SQL = _sql()
