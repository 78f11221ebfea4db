"""The grouped rate as a stream; an extension, the batch form being the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, *, time_col: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by window and type: total, wins (value above 50) and rate. On a stream, state is kept until ``late`` has passed."""
    timed = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    timed = timed.withWatermark(time_col, late) if events.isStreaming else timed
    out = timed.groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count("*").alias("total"), F.sum((F.col("value") > 50).cast("long")).alias("wins"))
    return out.select(F.col("w.start").alias("start"), "event_type", "total", "wins", F.round(F.col("wins") / F.col("total"), 4).alias("rate"))


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream makes of the data that is there now, as a table in memory."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
