"""Exact duplicates by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Only DataFrame functions are used.  The full hash of a text is computed only if another text has
its length and its prefix hash; only the digest column that `classes` returns asks for every row's.
Each level groups with map-side partial aggregation, so a group that holds a third of all rows is no
burden; joins back to the rows are broadcast behind a count of the table, or else shuffle joins,
whose hot keys AQE splits and whose rows without a partner Catalyst's Bloom filter drops on large inputs.

Defined cases: a null text equals the empty one; texts are equal when identical after lower-casing
A-Z, and are read whole, however long; of equal texts the row with the largest doc_id stays (null is
below every id); of rows that share text and that largest doc_id, one stays; an empty table gives an
empty result; other columns, whatever their names, are ignored by `classes` and carried along by `keep_one`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small

PREFIX = 64  #: characters of the prefix that the second level hashes


def _keyed(docs: DataFrame, *carried) -> DataFrame:
    """Length and prefix hash of each text.  Lower-casing A-Z leaves the length in bytes as it is."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*carried, F.octet_length(text).alias("_len"), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX))).alias("_ph"))


def _sha() -> Column:
    return F.unhex(F.sha2(ascii_lower(F.col("text")), 256))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys _len, _ph that several texts have; and for each text that several rows share a row _sha, keep_id, group_size, _top (rows that have keep_id)."""
    thin = cut(_keyed(docs), "exact-thin")
    lengths = thin.groupBy("_len").count().where("count > 1").select("_len")
    alike = thin.join(small(cut(lengths, "exact-len")), "_len", "left_semi")
    keys = small(cut(alike.groupBy("_len", "_ph").count().where("count > 1").select("_len", "_ph"), "exact-keys", thin))
    survivors = _keyed(docs, "doc_id", "text").join(keys, ["_len", "_ph"], "left_semi").select("doc_id", _sha().alias("_sha"))
    by_id = survivors.groupBy("_sha", "doc_id").agg(F.count("*").alias("n"))
    found = by_id.groupBy("_sha").agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("group_size")).where("group_size > 1")
    return keys, cut(found.select("_sha", F.col("top.doc_id").alias("keep_id"), "group_size", F.col("top.n").alias("_top")), "exact-groups")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    _, found = groups(docs)
    tied = F.coalesce(F.col("_top") > 1, F.lit(False)) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = docs.select("doc_id", _sha().alias("_sha")).join(small(found), "_sha", "left").where(~tied)
    alone = F.col("group_size").isNull()
    plain = rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
    repeated = found.where("_top > 1").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_top"))).alias("i"))
    again = repeated.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("i") == 1).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
    return plain.unionByName(again)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keys, found = groups(docs)
    mine = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    mine = _keyed(mine, "doc_id", "text", "_row").join(keys.withColumn("_alike", F.lit(True)), ["_len", "_ph"], "left")
    rows = mine.select("doc_id", "_row", F.when(F.col("_alike"), _sha()).alias("_sha")).join(small(found), "_sha", "left")
    stays = F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    tied = F.coalesce(F.col("_top") > 1, F.lit(False))
    return rows.where(stays & ~tied).select("_row.*").unionByName(rows.where(stays & tied).dropDuplicates(["_sha"]).select("_row.*"))


SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       text_sha256
FROM t
"""
