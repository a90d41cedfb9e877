"""Summaries that keep pending, missing and excluded apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import small
from .tables import kept


#: Values of a group that one task may hold to sort them.
HELD = 100_000
CELLS = 1024


def selected(rows: DataFrame, group: str, value: str, ranks: DataFrame, held: int = HELD) -> DataFrame:
    """group, name, value of the order statistics that ranks (group, name, rank from 1) asks for, exactly, in bounded memory.

    Each pass cuts the range that holds a rank into cells, counts the values of each cell by partial
    sums, and goes on in the cell where the rank falls; a range with at most `held` values is sorted.
    Rows aren't shuffled, and no more than CELLS counts or `held` values of a group meet in a task.
    Nulls and NaN have no rank.
    """
    v = F.col(value).cast("double")
    rows = rows.select(F.col(group).alias("_g"), v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    ends = rows.groupBy("_g").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("n"))
    asked = ranks.select(F.col(group).alias("g"), "name", "rank")
    open_ = kept(asked.join(ends, F.col("g").eqNullSafe(F.col("_g"))).drop("_g"), "ranks")
    done = []
    while True:
        done.append(open_.where("low = high").select("g", "name", F.col("low").alias("value")))
        few = open_.where((F.col("low") < F.col("high")) & (F.col("n") <= held))
        inside = rows.join(small(few), F.col("_g").eqNullSafe(F.col("g")) & F.col("_v").between(F.col("low"), F.col("high")))
        done.append(inside.groupBy("g", "name", "rank").agg(F.sort_array(F.collect_list("_v")).alias("all")).select("g", "name", F.get("all", (F.col("rank") - 1).cast("int")).alias("value")))
        many = open_.where((F.col("low") < F.col("high")) & (F.col("n") > held))
        if many.isEmpty():
            return reduce(DataFrame.unionByName, done).select(F.col("g").alias(group), "name", "value")
        met = rows.join(small(many), F.col("_g").eqNullSafe(F.col("g")) & F.col("_v").between(F.col("low"), F.col("high")))
        part = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves: the range itself may not be finite
        met = met.withColumn("cell", F.least(F.lit(CELLS - 1), F.floor(part * CELLS).cast("int")))
        cells = met.groupBy("g", "name", "rank", "cell").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy("cell"))
        cells = cells.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        open_ = kept(cells.select("g", "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "low", "high", "n"), "ranks")


def latency(runs: DataFrame, group: str, value: str, held: int = HELD) -> DataFrame:
    """Sum, mean, median, nearest-rank 95th percentile and maximum; nulls for a group without values.

    The median of an even number is the mean of the middle two.  Order statistics come from selected().
    """
    v = F.col(value)
    sums = kept(runs.groupBy(group).agg(F.count(v).alias("n"), F.round(F.sum(v), 6).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("most")), "latency")
    n = F.col("n")
    asked = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in (("low", F.floor((n + 1) / 2)), ("high", F.floor(n / 2) + 1), ("p95", F.ceil(n * 95 / 100)))])
    ranks = sums.where("n > 0").select(group, F.explode(asked).alias("a")).select(group, "a.*")
    found = selected(runs, group, value, ranks, held)
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    found = found.groupBy(F.col(group).alias("_g")).agg(F.round((of("low") + of("high")) / 2, 6).alias("median"), of("p95").alias("p95"))
    return sums.join(found, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "n", "total", "mean", "median", "p95", "most")


def bounds(items: DataFrame, groups: list[list[str]], columns: list[str]) -> DataFrame:
    """By grouping set: items, graded, pending, excluded, lower, upper, whole.

    items: points (null: pending), max_points, selected.  Pending items may still give all their
    points; excluded ones count in the whole, never in the bounds.
    """
    chosen = F.col("selected")
    known = F.sum(F.when(chosen & F.col("points").isNotNull(), F.col("points")).otherwise(0))
    hoped = F.sum(F.when(chosen & F.col("points").isNull(), F.col("max_points")).otherwise(0))
    sets = [[F.col(c) for c in g] for g in groups]
    return items.groupingSets(sets, *columns).agg(F.count("*").alias("items"), F.count_if(chosen & F.col("points").isNotNull()).alias("graded"), F.count_if(chosen & F.col("points").isNull()).alias("pending"), F.count_if(~chosen).alias("excluded"), known.cast("long").alias("lower"), (known + hoped).cast("long").alias("upper"), F.sum("max_points").cast("long").alias("whole"))


def target_status(missing: Column, pending: Column, bad_format: Column, lower: Column, target: Column) -> Column:
    return F.when(target.isNull(), "no_target").when(missing > 0, "run_incomplete").when(pending > 0, "grading_incomplete").when(bad_format > 0, "invalid_submission_format").when(lower >= target, "target_reached").otherwise("below_target")


def tokens_used(runs: DataFrame, group: str, used: Column, calls: Column) -> DataFrame:
    """known (null if none reported), reported calls, unknown calls."""
    return runs.groupBy(group).agg(F.sum(used).cast("long").alias("known"), F.count(used).alias("reported"), (F.greatest(F.sum(calls), F.count("*")) - F.count(used)).cast("long").alias("unknown"))


def suite(papers: DataFrame) -> DataFrame:
    """One row: totals, bounds, and a percentage only if every paper is complete.  papers: lower, upper, whole, pending."""
    done = F.bool_and(F.col("pending") == 0)
    return papers.agg(F.count("*").alias("papers"), F.sum("lower").cast("long").alias("lower"), F.sum("upper").cast("long").alias("upper"), F.sum("whole").cast("long").alias("whole"), done.alias("complete"), F.when(done, F.round(F.sum("lower") * 100.0 / F.sum("whole"), 4)).alias("percent"))
