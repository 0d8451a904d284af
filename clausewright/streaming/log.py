"""The append-only query log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright import schema


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New JSONL files below path; lines of both shapes, broken lines as rows of nulls."""
    return spark.readStream.schema(schema.LOG).option("maxFilesPerTrigger", files_per_batch).json(path)


def status_counts(log: DataFrame, at: str = "timestamp", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Requests per window, city and status; rows later than `late` are left out once their window is closed."""
    t = F.try_to_timestamp(F.col(at)).alias("at")
    return log.select(t, "city", F.coalesce("status", F.lit("ok")).alias("status")).withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "city", "status").agg(F.count("*").alias("n"))


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; a second run goes on behind it."""
    df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
