"""Views and aggregates over streams of resources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from carex.plans.views import view_rows


def stream_of(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    """New parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def stream_view(stream: DataFrame, view: dict, out: str, checkpoint: str) -> StreamingQuery:
    """The rows of a view over all that has arrived, appended exactly once."""
    flow = view_rows(stream, view)
    return flow.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, keys: list[str], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and window of time; state is dropped once the watermark has passed a window."""
    timed = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    counts = timed.groupBy(F.window("__at", size), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")
