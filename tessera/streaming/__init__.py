"""The keyed algebra on streams: a folder of Parquet files read as it grows, counted by event time and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def windowed(df: DataFrame, time: str, size: str, by: list[str], late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Aggregates by tumbling windows of event time and keys; rows later than ``late`` are dropped and their state let go."""
    watched = df.withWatermark(time, late)
    grouped = watched.groupBy(F.window(time, size).alias("w"), *by).agg(*(v.alias(k) for k, v in aggregates.items()))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *aggregates)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Works through all that is there, in as many batches as the source gives, and stops."""
    df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
