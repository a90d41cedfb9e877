"""Tables that end a lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; set here only where the session has none, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_siltstone_core_dir", None) or "file://" + tempfile.mkdtemp(prefix="siltstone-core-")
        spark.sparkContext._siltstone_core_dir = found
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: lost executors cost no recomputation, and plans stay short."""
    path = f"{shared_dir(df.sparkSession)}/siltstone-{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
