"""Checks as data: each gives rows (rule, entity_id, detail); a gate fails if there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Violations(Exception):
    """The gate's first rows."""


def violation(rows: DataFrame, rule: str, entity: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity_id"), detail.cast("string").alias("detail"))


def together(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def gate(found: DataFrame) -> None:
    first = found.limit(5).collect()
    if first:
        raise Violations("; ".join(f"{r['rule']} {r['entity_id']}: {r['detail']}" for r in first))


def orphans(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return left.join(right.select(on).distinct(), on, "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unequal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one and not in the other, with repeats: empty if the bags are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def membership(template: DataFrame, answers: DataFrame, on: str) -> DataFrame:
    """on, problem: missing, extra or duplicate ids."""
    t = template.groupBy(on).agg(F.count("*").alias("a"))
    s = answers.groupBy(on).agg(F.count("*").alias("b"))
    both = t.join(s, on, "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("b") > 1, "duplicate")
    return both.select(on, problem.alias("problem")).where("problem is not null")


def bad_spans(passages: DataFrame, articles: DataFrame) -> DataFrame:
    """Passages whose article is missing, or whose text isn't what its span holds."""
    joined = passages.join(articles.select("doc_id", F.col("text").alias("article")), "doc_id", "left")
    same = F.col("article").substr(F.col("start") + 1, F.col("end") - F.col("start")) == F.col("body")
    return joined.where(F.col("article").isNull() | ~same).drop("article")


def unrepresented(articles: DataFrame, passages: DataFrame) -> DataFrame:
    return articles.join(passages.select("doc_id").distinct(), "doc_id", "left_anti")
