"""Incremental ingestion of daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions.common import canonical_ticker


def read_bars(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """New Parquet files of a folder as a stream, tickers in canonical form."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ticker", canonical_ticker("ticker"))


def append_bars(bars: DataFrame, ingested: str, out: str, checkpoint: str, lateness: str = "10 days") -> StreamingQuery:
    """Append bars to a Parquet folder partitioned by date; a bar delivered again unchanged within ``lateness`` is dropped. Ends when the input is drained."""
    at = bars.withColumn(ingested, F.col(ingested).cast("timestamp")).withWatermark(ingested, lateness)
    fresh = at.dropDuplicatesWithinWatermark(["date", "ticker", "open", "high", "low", "close", "volume"])
    return fresh.writeStream.format("parquet").partitionBy("date").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_activity(bars: DataFrame, ingested: str, lateness: str = "2 days") -> DataFrame:
    """Bars and volume by day of ingestion, in windows closed by the watermark."""
    at = bars.withColumn(ingested, F.col(ingested).cast("timestamp")).withWatermark(ingested, lateness)
    return at.groupBy(F.window(ingested, "1 day")).agg(F.count("*").alias("bars"), F.sum("volume").alias("volume")).select(F.col("window.start").cast("date").alias("day"), "bars", "volume")
