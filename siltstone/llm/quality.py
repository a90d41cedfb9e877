"""Quality: scores learnt from preference pairs (Bradley-Terry), cut at a quantile.

A document is described by shares that hold for any language: capitals, symbols, digits, repeated
words, lines and word pairs, the most frequent word, word lengths, and its length.  Each is coded by
which of its training quantiles it passes.  A pair is a good and a bad labelled document; the
score is a weighted sum of codes, fitted by logistic loss on the difference within pairs.  The cut
is the score's quantile at the share of bad documents among the labelled, and lies at 0.3 of the reported
score, a logistic curve of the distance from the cut.

All labelled rows but those held out are learnt from: quantiles and cut are exact order statistics
of them all.  Of up to PAIRS / MET rows PAIRS pairs are drawn; of more, each row meets MET drawn rows
of the other class, so that each takes part.  Pairs lie in a table, and each step of the fit goes
through all of it; a step's sums are whole numbers, so that no order of rows changes them.

Defined cases: null and empty texts have all-zero shares and are scored by them; with no labels, or
those of one class only, all texts get that class's smoothed share; every text is read whole;
other columns are ignored.
"""

from __future__ import annotations

import operator
import unicodedata
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, pieces, small
from .labelled import held_out, known, logistic, order_statistics, sigmoid

CUT_AT = 0.3
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99)
PAIRS = 40_000  #: at least
MET = 4  #: drawn rows of the other class that each row meets, where that makes more pairs
BLOCK = 8_192  #: pairs in a row of their table
FILE_PAIRS = 65_536  #: pairs in a file of it
UNIT = 2.0**32  #: a step's sums count in parts of this of a pair's slope
MEASURES = ("upper", "letters", "digits", "marks", "signs", "breaks", "again", "distinct", "top", "pairs", "lines", "length", "words", "log")


LEVELS, TRIPLES = len(QUANTILES) + 1, -(-len(MEASURES) // 3)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point below 0x3000: 0 other letter, 1 capital, 2 digit, 3 stop or comma, 4 other sign, 5 white space."""
    out = np.zeros(0x3000, np.uint8)
    for i in range(len(out)):
        kind = unicodedata.category(chr(i))
        out[i] = 1 if kind == "Lu" else 0 if kind[0] in "LM" else 2 if kind[0] == "N" else 3 if chr(i) in ".,;:'\"-" else 5 if chr(i).isspace() else 4
    return out


def measures(text: str) -> list[float]:
    if not text:
        return [0.0] * len(MEASURES)
    kinds = _kinds()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = np.bincount(kinds[np.minimum(codes, len(kinds) - 1)], minlength=6).tolist()
    solid = max(1, len(codes) - n[5])
    words = text.split()
    m = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x]
    return [
        n[1] / solid, (n[0] + n[1]) / solid, n[2] / solid, n[3] / solid, n[4] / solid, n[5] / len(codes),
        sum(map(operator.eq, words, words[1:])) / m, len(counts) / m, max(counts.values(), default=0) / m, pairs / max(1, len(words) - 1),
        len(set(lines)) / max(1, len(lines)), solid / m, n[4] / m, float(np.log1p(len(words))),
    ]


def _listed(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, len(MEASURES), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))


def _unlisted(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(MEASURES))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and x, the measures, of each document, as a table."""

    def run(batches):
        for batch in pieces(batches):
            x = np.array([measures(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), _listed(x)], ["doc_id", "text_hash", "x"])

    text = F.coalesce("text", F.lit("")).alias("text")
    return cut(docs.select("doc_id", text).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, x array<double>"), "measures")


def digits(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of its quantiles each measure passes, LEVELS-ary numbers of three measures.  x: rows of measures; edges: measures by quantiles."""
    out = np.zeros((len(x), TRIPLES * 3), np.uint16)
    out[:, : len(MEASURES)] = (x[:, :, None] > edges[None]).sum(axis=2)
    return (out.reshape(-1, TRIPLES, 3) * np.array([LEVELS**2, LEVELS, 1], np.uint16)).sum(axis=2, dtype=np.uint16)


def weighed(digit: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The score of each column of digit: the sum of the weights of the quantiles passed, in the same order for each."""
    upto = np.zeros((TRIPLES * 3, LEVELS))
    upto[: len(MEASURES), 1:] = w.reshape(len(MEASURES), -1).cumsum(axis=1)
    out = np.zeros(digit.shape[1])
    for (a, b, c), number in zip(upto.reshape(TRIPLES, 3, LEVELS), digit):
        out += (a[:, None, None] + b[:, None] + c).reshape(-1)[number]
    return out


def slopes(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The summed slope of the loss over pairs of columns, for each weight, in parts of UNIT, as whole numbers."""
    out = np.zeros((TRIPLES, LEVELS**3), np.int64)
    for at in range(0, good.shape[1], BLOCK):  # sums of a block are exact in doubles
        g, b = good[:, at : at + BLOCK], bad[:, at : at + BLOCK]
        pull = np.rint(sigmoid(weighed(b, w) - weighed(g, w)) * UNIT)
        for i in range(TRIPLES):
            out[i] += (np.bincount(b[i], pull, LEVELS**3) - np.bincount(g[i], pull, LEVELS**3)).astype(np.int64)
    cube = out.reshape(TRIPLES, LEVELS, LEVELS, LEVELS)
    each = np.stack([cube.sum(axis=(2, 3)), cube.sum(axis=(1, 3)), cube.sum(axis=(1, 2))], axis=1).reshape(-1, LEVELS)[: len(MEASURES)]
    return each[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:].reshape(-1)


def training(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label, x of all labelled documents that aren't held out, as a table; of several texts of one doc_id, the one whose hash is lowest."""
    asked = cut(known(labels, "quality"), "labels")
    found = rows.where(~held_out(F.col("doc_id"))).join(small(asked), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct("text_hash", "x")).alias("t"))
    return cut(found.select("doc_id", "label", "t.x"), "train", asked)


def placed(train: DataFrame, edges: np.ndarray) -> DataFrame:
    """label, rank (from 0 in its class, by doc_id), doc_id, digit (the bytes of digits()) of training rows, as a table."""

    def run(batches):
        for batch in batches:
            packed = [d.tobytes() for d in digits(_unlisted(batch.column("x")), edges)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "digit"])

    coded = train.mapInArrow(run, "doc_id long, label int, digit binary")
    ranged = coded.repartitionByRange(partitions(train.sparkSession), "label", "doc_id").sortWithinPartitions("label", "doc_id")
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "train-placed")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    # A row or two for each range partition.
    parts = sorted(tuple(r) for r in ranged.groupBy("label", "_part").agg(F.min("_at"), F.count("*")).collect())
    base = []
    for label in (0, 1):
        mine = [p for p in parts if p[0] == label]
        base += [(label, part, upto - first) for (_, part, first, _), upto in zip(mine, accumulate((n for *_, n in mine), initial=0))]
    base = train.sparkSession.createDataFrame(base, "label int, _part long, _base long")
    return ranged.join(F.broadcast(base), ["label", "_part"]).select("label", (F.col("_at") + F.col("_base")).alias("rank"), "doc_id", "digit")


def pairs(rows: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """good, bad: the digits of pairs in which each of the rows of placed() meets MET drawn ones of the other class."""
    own, other = rows.withColumn("_turn", F.explode(F.array(*[F.lit(k) for k in range(MET)]))), rows.select((1 - F.col("label")).alias("label"), F.col("rank").alias("_drawn"), F.col("digit").alias("_other"))
    own = own.withColumn("_drawn", F.pmod(F.xxhash64("doc_id", "_turn"), F.when(F.col("label") == 1, n_bad).otherwise(n_good)))
    met = own.join(small(other, n_good + n_bad), ["label", "_drawn"])
    good = F.col("label") == 1
    return met.select(F.when(good, F.col("digit")).otherwise(F.col("_other")).alias("good"), F.when(good, F.col("_other")).otherwise(F.col("digit")).alias("bad"))


def blocks(met: DataFrame, count: int) -> DataFrame:
    """The pairs, BLOCK of them in a row, number by number, as a table of files of about FILE_PAIRS."""

    def packed(column: pa.Array) -> bytes:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TRIPLES).T.tobytes()

    def run(batches):
        for batch in pieces(batches, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([packed(batch.column(c))], pa.binary()) for c in ("good", "bad")], ["good", "bad"])

    return cut(met.coalesce(-(-count // FILE_PAIRS)).mapInArrow(run, "good binary, bad binary"), "pairs")


def descended(table: DataFrame, w: np.ndarray) -> np.ndarray:
    """slopes() over all rows of blocks(), a job; each task sends one sum."""

    def run(batches):
        out = np.zeros(len(w), np.int64)
        for batch in batches:
            for row in zip(batch.column("good"), batch.column("bad")):
                out += slopes(*[np.frombuffer(x.as_buffer(), np.uint16).reshape(TRIPLES, -1) for x in row], w)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    return np.sum([np.frombuffer(r["sums"], np.int64) for r in table.mapInArrow(run, "sums binary").collect()], axis=0)


def quantiles(train: DataFrame, n: int) -> np.ndarray:
    """The quantiles of each measure over all training rows, between neighbours in proportion: measures by quantiles."""
    at = [(n - 1) * q for q in QUANTILES]
    ranks = [(m, min(int(p) + i, n - 1)) for m in range(len(MEASURES)) for p in at for i in (0, 1)]
    found = order_statistics(train.select(F.posexplode("x").alias("m", "v")), ranks)
    return np.array([[np.quantile([found[m, int(p)], found[m, min(int(p) + 1, n - 1)]], p - int(p)) for p in at] for m in range(len(MEASURES))])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    return fit_measured(measured(docs), labels)


def fit_measured(rows: DataFrame, labels: DataFrame) -> dict:
    """The model, from rows of measured() and labels."""
    train = training(rows, labels)
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_good, n_bad = sizes.get(1, 0), sizes.get(0, 0)
    n = n_good + n_bad
    if not n_good or not n_bad:
        return {"flat": (n_good + 1) / (n + 2)}
    edges = quantiles(train, n)
    coded = placed(train, edges)
    if MET * n <= PAIRS:
        got = coded.orderBy("label", "rank").toArrow()  # PAIRS / MET rows at most
        digit = np.frombuffer(b"".join(got.column("digit").to_pylist()), np.uint16).reshape(n, -1).T
        pick, count = np.random.default_rng(17), PAIRS
        good, bad = digit[:, n_bad + pick.choice(n_good, PAIRS)], digit[:, pick.choice(n_bad, PAIRS)]
        total = lambda w: slopes(good, bad, w)
    else:
        count = MET * n
        table = blocks(pairs(coded, n_good, n_bad), count)
        total = lambda w: descended(table, w)

    w = logistic(lambda w: total(w) / (UNIT * count), edges.size, penalty=1e-3)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int32)), pa.array(weighed(digits(_unlisted(batch.column("x")), edges).T, w))], ["m", "v"])

    s = order_statistics(train.select("x").mapInArrow(run, "m int, v double"), [(0, n_bad - 1), (0, n_bad)])
    return {"edges": edges, "w": w, "cut": (s[0, n_bad - 1] + s[0, n_bad]) / 2}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score."""
    return score_measured(measured(docs), model)


def score_measured(rows: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of rows of measured()."""
    base = float(np.log(CUT_AT / (1 - CUT_AT)))

    def run(batches):
        for batch in batches:
            out = np.full(batch.num_rows, model.get("flat", 0.0))
            if "flat" not in model:
                out = sigmoid(weighed(digits(_unlisted(batch.column("x")), model["edges"]).T, model["w"]) - model["cut"] + base)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = measured(docs)
    scored = score_measured(rows, fit_measured(rows, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT_AT).cast("int").alias("predicted"))
