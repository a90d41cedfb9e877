"""What the trained classifiers share: held-out rows, labels, training texts, order statistics, the descents."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, small

def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's digits is divisible by 5 (a null id counts as no digits)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label of all documents to learn from; of several labels of one document the largest counts."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def training(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, label of all documents to learn from, as a table.

    Of several texts of one doc_id the one counts whose hash is lowest.  Labels without a document take no part.
    """
    asked = cut(known(labels, label), "labels")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_out(F.col("doc_id"))).join(small(asked), "doc_id")
    found = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return cut(found.select("doc_id", "t.text", "label"), "train", asked)


def order_statistics(values: DataFrame, ranks: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """{(m, rank): v} for the ranks asked for, from 0, among all values of m.  values: m int, v double, not null.

    Equal values are counted first, then one range partitioning and its partial sums tell where a rank lies.
    """
    spark = values.sparkSession
    counts = values.groupBy("m", "v").agg(F.count("*").alias("n"))
    ranged = cut(counts.repartitionByRange(partitions(spark), "m", "v").withColumn("part", F.spark_partition_id()), "values")
    sums: dict[int, list] = {}
    for m, part, n in sorted(tuple(r) for r in ranged.groupBy("m", "part").agg(F.sum("n").alias("n")).collect()):  # a row or two for each range
        sums.setdefault(m, []).append((part, n))
    asked = []
    for m, rank in sorted(set(ranks)):
        before = list(accumulate((n for _, n in sums[m]), initial=0))
        i = next(i for i in range(len(sums[m])) if before[i + 1] > rank)
        asked.append((m, sums[m][i][0], rank, rank - before[i]))
    wanted = F.broadcast(spark.createDataFrame(asked, "m int, part int, rank long, offset long"))
    upto = ranged.join(wanted.select("m", "part").distinct(), ["m", "part"]).withColumn("upto", F.sum("n").over(Window.partitionBy("m", "part").orderBy("v")))
    found = upto.join(wanted, ["m", "part"]).where((F.col("upto") > F.col("offset")) & (F.col("upto") - F.col("n") <= F.col("offset")))
    return {(r["m"], r["rank"]): r["v"] for r in found.select("m", "rank", "v").collect()}


def logistic(margins, size: int, steps: int = 300, rate: float = 0.05, penalty: float = 1e-4):
    """Weights that minimise a mean logistic loss.  margins(w) gives the loss's slope for weights w."""
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        slope = margins(w) + penalty * w
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def minimised(slopes, size: int, penalty: float = 1e-4, tolerance: float = 1e-6, most: int = 600, memory: int = 10):
    """Weights that minimise a mean logistic loss, by L-BFGS from 0.  slopes(w) gives the loss's slope for weights w.

    It ends when the norm of the slope, with the penalty's, is at most tolerance, or else after `most` calls of
    slopes().  The loss is convex, so that slopes alone tell how far to go along a direction.
    """
    w, calls, past = np.zeros(size), 1, []  # past: moves, and what they changed in the slope
    slope = slopes(w)
    while np.linalg.norm(slope) > tolerance:
        way, taken = -slope, []
        for move, turn in reversed(past):
            taken.append(move @ way / (move @ turn))
            way = way - taken[-1] * turn
        way = way * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(slope))
        for (move, turn), share in zip(past, reversed(taken)):
            way = way + move * (share - turn @ way / (move @ turn))
        fall, low, high, far = slope @ way, 0.0, np.inf, 1.0
        while True:
            if calls == most:
                return w
            there, calls = slopes(w + far * way) + penalty * (w + far * way), calls + 1
            if 0.9 * fall <= there @ way <= -0.5 * fall:
                break
            low, high = (low, far) if there @ way > 0 else (far, high)
            far = 2 * far if high == np.inf else (low + high) / 2
        past = [*past, (far * way, there - slope)][-memory:]
        w, slope = w + far * way, there
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
