"""Sharding along a Hilbert curve over quantised metadata.

Source, language and length are quantised to 2**BITS steps each, in their own order and by how many
rows they have, so that each step holds about as many; the cell's place on the Hilbert curve
orders all rows, and the order is cut into runs of equal counts.  A reader that wants one language
and one range of lengths then finds its rows in few shards, which keep their own ranges
(`shard_ranges`), for neighbouring places are neighbouring cells.

Only DataFrame functions are used.  The curve is a table of 2**(DIMS*BITS) places, built by rule and
looked up by cell.  Steps come from counts by value, ranks from one range partitioning (which splits
any hot cell, since doc_id follows the cell in the sort key) and from row counts of its partitions: no
window over the rows, and no more than a row for each partition or step reaches the driver.

Defined cases: a null source, language or text counts as empty; a null doc_id comes first in its
cell; rows that are equal in all of this are ordered by text and size, and repeats take adjacent
places; texts are read whole, of any length; an empty table gives no rows; fewer rows than shards
leave shards empty; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

SHARDS = 16
AXES = ("source", "lang", "size")
DIMS, BITS = len(AXES), 4


def curve_index(point: list[int], bits: int) -> int:
    """The place of a point on the Hilbert curve: Gray-code rotation from the highest bit down."""
    x, n = list(point), len(point)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(n):
            if x[i] & step:
                x[0] ^= low
            else:
                flip = (x[0] ^ x[i]) & low
                x[0] ^= flip
                x[i] ^= flip
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, step = 0, 1 << (bits - 1)
    while step > 1:
        if x[n - 1] & step:
            turn ^= step - 1
        step >>= 1
    x = [v ^ turn for v in x]
    place = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            place = place << 1 | v >> b & 1
    return place


@lru_cache
def places(dims: int = DIMS, bits: int = BITS) -> tuple[int, ...]:
    """The curve's place of each cell; cells are numbered with the first dimension highest."""
    low = (1 << bits) - 1
    return tuple(curve_index([cell >> bits * (dims - 1 - d) & low for d in range(dims)], bits) for cell in range(1 << dims * bits))


def steps(values: DataFrame, bits: int = BITS) -> list:
    """Of values (a column v): the first value of each step but the lowest.  A step has rows before it of total / 2**bits times its number."""
    n = 1 << bits
    counts = values.groupBy("v").agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(partitions(values.sparkSession), "v").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged, "shards-values")
    sums = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row for each partition
    total = sum(s for _, s in sums)
    offsets = dict(zip((p for p, _ in sums), accumulate((s for _, s in sums), initial=0)))
    base = F.element_at(F.create_map(*[F.lit(x) for pair in (offsets or {0: 0}).items() for x in pair]), F.col("part"))
    before = base + F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = ranged.select("v", F.floor(before * n / max(total, 1)).alias("step")).groupBy("step").agg(F.min("v").alias("v")).where("step > 0")
    return sorted((r["step"], r["v"]) for r in found.collect())  # fewer than 2**bits rows


def _step(value: Column, firsts: list) -> Column:
    """The step of a value: the number of the last one whose first value is not above it."""
    out = F.lit(0)
    for number, first in firsts:
        out = F.when(value >= F.lit(first), F.lit(number)).otherwise(out)
    return out.cast("int")


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "lang")]
    thin = cut(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *names), "shards-thin")
    cell = F.lit(0)
    for axis in AXES:
        cell = cell * (1 << BITS) + _step(F.col(axis), steps(thin.select(F.col(axis).alias("v"))))
    table = F.from_json(F.lit("[" + ",".join(map(str, places())) + "]"), "array<int>")
    thin = thin.select("doc_id", "size", "text_crc32", F.element_at(table, cell + 1).alias("curve"))
    key = [F.col("curve").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    ranged = thin.repartitionByRange(partitions(spark), *key, F.rand(7)).sortWithinPartitions(*key)
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "shards-ranged")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    # One count for each range partition: as many rows as the session has shuffle partitions.
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    base, total = {}, 0
    for part, n in counts:
        base[part] = total
        total += n
    before = spark.createDataFrame(list(base.items()) or [(0, 0)], "_part long, _base long")
    rank = F.col("_base") + F.col("_at")
    shard = F.expr(f"(_base + _at) * {n_shards} div {max(total, 1)}")
    first = F.expr(f"((_base + _at) * {n_shards} div {max(total, 1)} * {total} + {n_shards - 1}) div {n_shards}")
    return placed.join(F.broadcast(before), "_part").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (rank - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def shard_ranges(sharded: DataFrame, metadata: DataFrame) -> DataFrame:
    """What each shard holds, for pruning: ranges of size and sets of sources and languages."""
    rows = sharded.join(metadata.select("doc_id", "source", "lang"), "doc_id")
    return rows.groupBy("shard").agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.count("*").alias("rows"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("lang")).alias("langs"))


def _sql() -> str:
    axis = "(SELECT v, floor(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * {n} / sum(n) OVER ())::INT AS step FROM (SELECT {a} AS v, count(*) AS n FROM t GROUP BY ALL))"
    joins = " ".join(f"JOIN {axis.format(a=a, n=1 << BITS)} x_{a} ON t.{a} = x_{a}.v" for a in AXES)
    cell = " + ".join(f"coalesce(x_{a}.step, 0) * {1 << BITS * (DIMS - 1 - i)}" for i, a in enumerate(AXES))
    # CRC-32, a byte at a time: its table, and a fold over the text's bytes.
    shift = "b"
    for _ in range(8):
        shift = f"list_transform({shift}, lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)"
    hexed = "hex(encode(text))"
    values = f"list_transform(range(0, length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::UBIGINT)"
    crc = f"xor(list_reduce({values}, lambda acc, byte: xor(acc >> 8, crc[(xor(acc, byte) & 255)::INT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT"
    return f"""
WITH c AS MATERIALIZED (SELECT {shift} AS crc FROM (SELECT list_transform(range(0, 256), lambda i: i::UBIGINT) AS b)),
t AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE {crc} END AS text_crc32
  FROM documents, c
), p AS (SELECT t.*, [{",".join(map(str, places()))}][{cell} + 1] AS curve FROM t {joins}
), r AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS total FROM p
), s AS (SELECT *, (pos * {SHARDS} // total)::INT AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY pos) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""


SQL = _sql()
