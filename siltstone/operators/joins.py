"""Choosing joins by counted sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table is small enough to be broadcast (at under 100 bytes a row).
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS, bound: DataFrame | None = None) -> DataFrame:
    """Marks df for broadcast if it has at most `most` rows; else Spark shuffles, and AQE splits hot keys.

    bound: a table with as many rows as df at least, that is cheaper to count.
    """
    return F.broadcast(df) if (df if bound is None else bound).limit(most + 1).count() <= most else df


#: Rows that a task takes of a table whose rows are dealt by a counted size.
TASK_ROWS = 250_000


def spread(df: DataFrame) -> DataFrame:
    """df dealt over the session's partitions where its files give fewer tasks than there are cores, as one file of one row group does."""
    tasks = df.select(F.spark_partition_id().alias("task")).distinct().count()
    spark = df.sparkSession
    return df if tasks >= spark.sparkContext.defaultParallelism else df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def deals(*tables: DataFrame) -> int:
    """How many partitions keep a task's share of the largest of these tables within TASK_ROWS: a task's memory doesn't grow with them."""
    spark = tables[0].sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), *(-(-df.count() // TASK_ROWS) for df in tables))


def overlap_join(left: DataFrame, right: DataFrame, low: str, high: str, start: str, end: str, slack: int = 0, width: int = 64) -> DataFrame:
    """Pairs of rows whose closed intervals of integers, [low, high] and [start, end], overlap within the slack.

    Each interval, the right one widened by the slack, is dealt to the cells of `width` that it touches;
    cells are joined on their number, the intervals are held against each other exactly, and a pair is
    taken in the first cell that both touch, so that none is doubled and no distinct is needed.
    Rows with a null bound, or whose bounds are the wrong way round, overlap with nothing.
    """
    cell = lambda c, by: F.floor((c + by) / F.lit(width)).cast("long")
    a = left.where(F.col(low) <= F.col(high)).withColumn("_from", cell(F.col(low), 0)).withColumn("_cell", F.explode(F.sequence("_from", cell(F.col(high), 0))))
    b = right.where(F.col(start) <= F.col(end)).withColumn("_begin", cell(F.col(start), -slack)).withColumn("_cell", F.explode(F.sequence("_begin", cell(F.col(end), slack))))
    both = a.join(b, "_cell").where((F.col(low) <= F.col(end) + slack) & (F.col(high) >= F.col(start) - slack) & (F.col("_cell") == F.greatest("_from", "_begin")))
    return both.drop("_cell", "_from", "_begin")
