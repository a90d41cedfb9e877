"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, twice over (EPOCHS).  A document's virtual
finish time is the source's cumulative words up to its end, divided by the source's weight.  The mix
is the order of finish times over all sources, cut where the words reach the budget.  A source that
runs out leaves its share to the others, so the cut is at the level to which shares fill up.

Cumulative sums come from one range partitioning by (source, shuffle key): sums of its parts give
offsets, so a source that holds a third of all rows is dealt over many tasks.  The global order is
cut by counting words in 1024 ranges of virtual time, then within the range where the budget falls,
and so on (LEVELS times): each step sends at most 1024 sums to the driver.

Defined cases: a null text has no words and is never taken; a null source is a source of its own,
the last; rows that repeat a doc_id queue each alone, by a hash of their texts (`mix` takes rows that
are equal in id and text, and on which the cut falls, together); all-empty tables give zero
targets; ties in finish time go together; other columns are ignored by `plan` and carried by `mix`.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions, small

WEIGHTS = (3, 1, 2)
EPOCHS = 2
SHARE = 1.5
LEVELS, WIDTH = 3, 10  #: virtual time has 2**(LEVELS*WIDTH) cells
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def _queued(row: str = "") -> list:
    """The columns of the queue, from the columns of the documents or of a struct of them."""
    doc_id = F.coalesce(F.col(f"{row}doc_id").cast("string"), F.lit("null"))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), doc_id)), 1, 15), 16, 10).cast("long")
    size = F.regexp_count(F.coalesce(F.col(f"{row}text"), F.lit("")), F.lit(WORD)).cast("long")
    tie = F.conv(F.substring(F.md5(F.coalesce(F.col(f"{row}text"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return [F.col(f"{row}doc_id").alias("doc_id"), F.col(f"{row}source").alias("source"), size.alias("size"), key.alias("key"), tie.alias("tie")]


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes has a row for each source: source, source_size.  Adds weight and target.

    The level at which shares fill up: sources in the order in which they run out; the first whose
    share of what is left, by weight, is within its stock sets the level.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs)).withColumn("runs_out", F.col("cap") / F.col("weight"))
    order = Window.orderBy("runs_out", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("level", (F.sum("source_size").over(every) * share - before) / rest)
    t = t.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("runs_out"), F.col("level"))).over(every), F.max("runs_out").over(every)))
    return t.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, source, key, tie, size, source_size, target, copies (0 to 2)."""
    spark = docs.sparkSession
    queue = cut(docs.select(*_queued()), "mix-queue")
    goal = cut(targets(queue.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share), "mix-goal")
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    # Rows of one doc_id and text are dealt over partitions at random; which of them is which makes no difference.
    ranged = queue.repartitionByRange(partitions(spark), *order, F.rand(7)).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "mix-ranged")
    sums = ranged.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    offset = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As many rows as there are range partitions and sources together.
    offsets = cut(sums.withColumn("_base", offset).drop("_sum"), "mix-offsets")
    same = F.col("source").eqNullSafe(F.col("s"))
    inside = Window.partitionBy("_part", "source").orderBy("key", F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("_in", F.sum("size").over(inside))
    offsets = offsets.select(F.col("source").alias("s"), F.col("_part").alias("p"), "_base")
    rows = rows.join(small(offsets), same & (F.col("_part") == F.col("p"))).drop("s", "p")
    sources = goal.withColumnRenamed("source", "s")
    rows = rows.join(small(sources), same).drop("s")
    top = goal.agg(F.max(F.col("source_size") * float(EPOCHS) / F.col("weight"))).first()[0] or 1.0
    cells = 1 << LEVELS * WIDTH
    total = goal.agg(F.sum("source_size")).first()[0] or 0
    for epoch in range(EPOCHS):
        finish = (F.col("_base") + F.col("_in") + F.col("source_size") * epoch) / F.col("weight")
        rows = rows.withColumn(f"_cell{epoch}", F.floor(finish / F.lit(float(top)) * F.lit(float(cells))).cast("long"))
    rows = cut(rows.select("doc_id", "source", "key", "tie", "size", "source_size", "target", *[f"_cell{e}" for e in range(EPOCHS)]), "mix-timed")
    last = _cut_cell(rows, total * share)
    copies = sum((F.col(f"_cell{e}") < last).cast("int") for e in range(EPOCHS))
    return rows.select("doc_id", "source", "key", "tie", "size", "source_size", "target", copies.alias("copies"))


def _cut_cell(rows: DataFrame, budget: float) -> int:
    """The first cell of virtual time that the mix doesn't take."""
    items = rows.where("size > 0").select("size", F.explode(F.array(*[f"_cell{e}" for e in range(EPOCHS)])).alias("_cell"))
    prefix, taken = 0, 0
    for level in range(LEVELS - 1, -1, -1):
        shift = level * WIDTH
        within = items.where(F.shiftright("_cell", shift + WIDTH) == prefix) if level < LEVELS - 1 else items
        found = within.groupBy(F.shiftright("_cell", shift).alias("c")).agg(F.sum("size").alias("n")).orderBy("c").collect()
        if not found:
            return 0
        upto = list(accumulate((r["n"] for r in found), initial=taken))
        at = next((i for i, n in enumerate(upto[1:]) if n > budget), None)
        if at is None:
            return (found[-1]["c"] << shift) + (1 << shift)
        prefix, taken = found[at]["c"], upto[at]
    return prefix + (upto[at + 1] - budget < budget - taken)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, as many times as they are taken.

    Of each source and epoch the last key taken is enough to decide on a row, so texts aren't shuffled.
    """
    chosen = plan(docs, weights, share)
    upto = [F.max(F.when(F.col("copies") > e, F.struct("key", F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie"))).alias(f"_upto{e}") for e in range(EPOCHS)]
    last = cut(chosen.where("size > 0").groupBy("source").agg(*upto), "mix-last").withColumnRenamed("source", "_s")
    queued = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select("_row", *_queued("_row."))
    rows = queued.join(small(last), F.col("source").eqNullSafe(F.col("_s")))
    here = F.struct("key", F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie")
    copies = sum(F.coalesce(here <= F.col(f"_upto{e}"), F.lit(False)).cast("int") for e in range(EPOCHS))
    rows = rows.where("size > 0").withColumn("_n", copies).where("_n > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


SQL = rf"""
WITH q AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS tie
  FROM documents
), g AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM q GROUP BY source
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS runs_out FROM g
), l AS (
  SELECT *, ((sum(source_size) OVER () * 1.5::DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY runs_out, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY runs_out, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), s AS (
  SELECT source, source_size, weight,
         least(cap, weight * coalesce(min(CASE WHEN level <= runs_out THEN level END) OVER (), max(runs_out) OVER ())) AS target
  FROM l
), c AS (
  SELECT q.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, tie ROWS UNBOUNDED PRECEDING)::DOUBLE AS cum FROM q
), t AS (
  SELECT c.doc_id, c.size, s.source_size, s.target, e.epoch,
         floor((c.cum + s.source_size * e.epoch) / s.weight / (SELECT coalesce(nullif(max(runs_out), 0), 1) FROM r) * 1073741824.0::DOUBLE)::BIGINT AS cell
  FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source CROSS JOIN (VALUES (0), (1)) e(epoch)
), o AS (
  SELECT cell, sum(sum(size)) OVER (ORDER BY cell) AS upto, sum(size) AS n FROM t WHERE size > 0 GROUP BY cell
), b AS (
  SELECT cell + (upto - budget < budget - (upto - n))::BIGINT AS last
  FROM o, (SELECT sum(source_size) * 1.5::DOUBLE AS budget FROM s) WHERE upto > budget ORDER BY cell LIMIT 1
)
SELECT doc_id, size, source_size, target, (size * sum((cell < last)::INT))::BIGINT AS taken
FROM t, (SELECT coalesce(max(last), 9223372036854775807) AS last FROM b)
GROUP BY doc_id, size, source_size, target
"""
