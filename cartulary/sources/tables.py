"""Reading parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPLIT_BYTES = 128 * 1024 * 1024


def spread(frame: DataFrame) -> DataFrame:
    """Round-robin a source that is smaller than one split per core, and leave any larger one alone.

    A small file is a single row group, hence a single task; the planner's size estimate decides, so a large
    table is never shuffled here.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return frame.repartition(cores) if int(str(size)) < SPLIT_BYTES * cores else frame


def read_table(spark: SparkSession, folder: str, name: str, *, heavy: bool = False) -> DataFrame:
    """``heavy`` marks tables whose rows carry long texts, so that per-row work deserves every core."""
    frame = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return spread(frame) if heavy else frame
