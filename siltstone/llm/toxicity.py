"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

Features are hashed n-grams of 3 to 6 characters of the lower-cased text, spaces included, present
or absent.  Over all labelled texts that aren't held out, each has a log ratio of its shares among toxic
and clean ones; the features that tell most (by likelihood ratio, at most KEPT) go, each times its log
ratio, into a logistic regression on all these texts.  Their kept features lie in a table, and each step of the
fit goes through all of it; a step's sums are whole numbers, so that no order of rows changes them.
Up to FEW texts 600 steps are made; more texts have the same loss minimised by L-BFGS, whose steps end when the
loss is flat: 600 steps over a table would take more than all the rest, and stop further from the least loss.
Only hashed counts and sums reach the driver, and the table itself where it has at most HELD texts.

Defined cases: null and empty texts get the score of a text without features; rows without labels
are scored like any other; with no labels, or those of one class only, every score is that
class's smoothed share; every text is read whole; other columns are ignored by `score` and carried
along by `clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, pieces
from .labelled import held_out, logistic, minimised, sigmoid, training

SIZES = (3, 4, 5, 6)
BITS = 18
KEPT = 8192
LEAST_GAIN = 7.0  #: likelihood gain, in nats, below which a feature of 2**18 may well be chance
TOXIC_AT = 0.5
FEW = 10_000  #: texts up to which a fit makes 600 steps, whatever the loss
HELD = 10_000  #: texts up to which the driver makes the steps, on a few hundred bytes of each
TASK_TEXTS = 4_096  #: texts that a task of a step goes through, about
UNIT = 2.0**32  #: a step's sums count in parts of this of a text's error
_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams, repeats included."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    out, h = [], chars
    for n in range(2, SIZES[-1] + 1):
        if len(chars) < n:
            break
        h = h[:-1] * _STEP + chars[n - 1 :]
        if n in SIZES:
            out.append(((h + np.uint32(n)) * _SPREAD) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _counts(batches):
    toxic, clean = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in pieces(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            (toxic if label else clean)[np.unique(grams(text))] += 1
    seen = np.flatnonzero(toxic + clean)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(toxic[seen], pa.int64()), pa.array(clean[seen], pa.int64())], ["gram", "toxic", "clean"])


def errors(batches, w: np.ndarray) -> np.ndarray:
    """For each kept feature, and last for all texts, the summed error of the texts with it, in parts of UNIT, as whole numbers.  w: weights, and the bias."""
    k = len(w) - 1
    out = np.zeros(k + 1, np.int64)
    for batch in batches:
        for row in zip(*[batch.column(c) for c in ("sizes", "at", "toxic")]):
            sizes, at, y = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int32, np.uint16, np.uint8)))
            at, of = at.astype(np.int64), np.repeat(np.arange(len(y)), sizes)
            error = np.rint((sigmoid(np.bincount(of, w[at], len(y)) + w[k]) - y) * UNIT)  # sums of a block's 256 are exact in doubles
            out[:k] += np.bincount(at, error[of], k).astype(np.int64)
            out[k] += int(error.sum())
    return out


def descended(table: DataFrame, w: np.ndarray) -> np.ndarray:
    """errors() over a table, a job; each task sends one sum for each weight."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([errors(batches, w).tobytes()], pa.binary())], ["sums"])

    return np.sum([np.frombuffer(r["sums"], np.int64) for r in table.mapInArrow(run, "sums binary").collect()], axis=0)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The weight of each hashed n-gram (most are 0), and the bias."""
    train = training(docs, labels, "toxic")
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    weights = np.zeros(1 << BITS, np.float32)
    bias = float(np.log((pos + 0.5) / (neg + 1.5)))  # without labels a text passes
    if not pos or not neg:
        return weights, bias
    # At most 2**BITS rows, by construction.
    rows = train.mapInArrow(_counts, "gram long, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("q")).toPandas()
    p, q = (rows["p"].to_numpy() + 1) / (pos + 2), (rows["q"].to_numpy() + 1) / (neg + 2)
    ratio = np.log(p / q)
    share = (rows["p"].to_numpy() + rows["q"].to_numpy() + 2) / (pos + neg + 4)

    def gain(part, total):
        return total * (part * np.log(part / share) + (1 - part) * np.log((1 - part) / (1 - share)))

    told = gain(p, pos) + gain(q, neg)
    best = np.argsort(-told, kind="stable")[: min(KEPT, int((told > LEAST_GAIN).sum()))]
    best = best[np.argsort(rows["gram"].to_numpy()[best])]
    kept, scale = rows["gram"].to_numpy()[best], ratio[best]
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def features(batches):
        for batch in pieces(batches):
            found = [np.unique(x[x >= 0]).astype(np.uint16) for x in (place[grams(t)] for t in batch.column("text").to_pylist())]
            packed = np.array([len(x) for x in found], np.int32), np.concatenate([np.zeros(0, np.uint16), *found]), batch.column("label").to_numpy().astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in packed], ["sizes", "at", "toxic"])

    n, k = pos + neg, len(kept)
    table = cut(train.mapInArrow(features, "sizes binary, at binary, toxic binary"), "features")
    held = table.toArrow().to_batches() if n <= HELD else None
    table = table.coalesce(-(-n // TASK_TEXTS))

    def slope(w):
        scaled = np.append(w[:k] * scale, w[k])
        sums = errors(held, scaled) if held is not None else descended(table, scaled)
        return sums / (UNIT * n) * np.append(scale, 1.0)

    w = logistic(slope, k + 1, steps=600, penalty=1e-5) if n <= FEW else minimised(slope, k + 1, penalty=1e-5)
    weights[kept] = w[:k] * scale
    return weights, float(w[k])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """row (a struct of all columns of docs, whatever their names) and score."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers

    def run(batches):
        w = shared.value
        on = w != 0
        for batch in pieces(batches):
            row = batch.column("row")
            out = []
            for text in pc.struct_field(row, "text").to_pylist():
                found = grams(text) if text else ()
                out.append(float(sigmoid(w[np.unique(found[on[found]])].sum(dtype=np.float64) + bias)) if len(found) else float(sigmoid(bias)))
            yield pa.RecordBatch.from_arrays([row, pa.array(out, pa.float64())], ["row", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.mapInArrow(run, StructType([packed.schema["row"], StructField("score", DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't toxic, with all their columns."""
    return score(docs, fit(docs, labels)).where(F.col("score") < TOXIC_AT).select("row.*")
