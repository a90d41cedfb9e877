"""An append-only journal of results, as a stream that survives interruption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def journal(spark: SparkSession, inbox: str, schema: StructType, out: str, state: str, on_rows: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends each result file that arrives in `inbox` to `out` once; `state` holds what is done.  on_rows sees each batch before it is written."""
    arriving = spark.readStream.schema(schema).json(inbox)

    def write(batch: DataFrame, epoch: int) -> None:
        if on_rows:
            on_rows(batch, epoch)
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a repeated epoch replaces itself

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_latency(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and mean values by hour and type over a stream of events; late rows within the watermark count.  `ts` without a zone is read as UTC."""
    from pyspark.sql import functions as F

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
