"""Streaming forms: sequenced messages land as files and are read as streams; windows are on event time, state is Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_messages(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 10) -> DataFrame:
    """A stream of a folder's Parquet files; files_per_trigger bounds a micro-batch, nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_copies(packets: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Of redundant feeds the first copy of each number; packets have ts, channel and packet_seq."""
    return packets.withWatermark("ts", late).dropDuplicatesWithinWatermark(["channel", "packet_seq"])


def cadence(events: DataFrame, width: str = "250 milliseconds", late: str = "1 second") -> DataFrame:
    """The last value of each level in each window; events have ts, seq, security_id, side, price, action and qty."""
    keyed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "security_id", "side", "price")
    return keyed.agg(F.max_by(F.struct("action", "qty", "seq"), "seq").alias("v")).select(F.col("window.start").alias("start"), "security_id", "side", "price", "v.*")


def bars(trades: DataFrame, width: str = "1 second", late: str = "5 seconds") -> DataFrame:
    """Candles of windows on event time, without continuity or fills (those need the candle before)."""
    keyed = trades.withWatermark("ts", late).groupBy(F.window("ts", width), "security_id")
    out = keyed.agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("qty").alias("volume"))
    return out.select("security_id", F.col("window.start").alias("time"), "open", "high", "low", "close", "volume")
