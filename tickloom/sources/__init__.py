"""Sources: typed market tables, and the driver's tables that stand in for them.

events are messages: user_id is the security, event_id the arrival order, value the price (4 places) and props.k the
quantity; the event type says what the message does to an order. part are instruments, orders definitions, lineitem
trades of a part, conversations news in parts, and documents packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What each event type does to an order. Fixed values.
ACTIONS = {"click": "new", "view": "change", "error": "delete", "signup": "mass_delete", "purchase": "trade"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, security_id, kind, price, qty, second, ts_us)."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("security_id"), F.col("event_type").alias("kind"), F.floor(F.col("value") * 10000).cast("bigint").alias("price"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("qty"), F.floor(micros / 1000000).cast("bigint").alias("second"), micros.alias("ts_us"),
    )


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    """messages with rpt_seq, one counter for each security, after some were lost (3 in 100)."""
    from pyspark.sql import Window

    rows = messages(spark, folder).withColumn("rpt_seq", F.row_number().over(Window.partitionBy("security_id").orderBy("seq")).cast("bigint"))
    return rows.where(F.pmod(F.col("seq") * 7919, F.lit(100)) >= 3)


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, security_id, side, order_id, action, price, qty): ten orders on each book, bids even and asks odd; every eleventh message has no price."""
    rows = messages(spark, folder)
    action = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))[F.col("kind")]
    order = F.pmod("qty", F.lit(10))
    side = F.when((action == "mass_delete") & (F.pmod("seq", F.lit(3)) == 0), F.lit(None)).when(F.pmod("qty", F.lit(2)) == 0, "bid").otherwise("ask")
    price = F.when(F.pmod("seq", F.lit(11)) != 0, F.floor(F.col("price") / 100000) * 100000)
    return rows.select("seq", "security_id", side.alias("side"), order.alias("order_id"), action.alias("action"), price.alias("price"), "qty")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, security_id, trade_id, price, qty, second, condition, sub_type): all messages as prints."""
    rows = messages(spark, folder)
    sub_type = F.when(F.pmod("seq", F.lit(13)) == 0, "leg").when(F.pmod("seq", F.lit(13)) == 1, "cross")
    return rows.select("seq", "security_id", F.pmod("seq", F.lit(5000)).alias("trade_id"), "price", "qty", "second", F.pmod("seq", F.lit(8)).cast("int").alias("condition"), sub_type.alias("sub_type"))


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """(channel, ts, size): documents as packets, a millisecond and a half apart in each block of a hundred."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("lang").alias("channel"), (F.col("doc_id") * 15 + F.floor(F.col("doc_id") / 100) * 4000).cast("bigint").alias("ts"), F.pmod("n_chars", F.lit(2000)).alias("size"))


def feeds(spark: SparkSession, path: str) -> DataFrame:
    """(channel, group, feed, address, port) of multicast configurations in JSON: {"channels": [{"id", "groups": [{"name", "feeds": [{"role", "address", "port"}]}]}]}. What has another shape gives nulls."""
    feed = "struct<role:string,address:string,port:int>"
    shape = f"channels array<struct<id:string,groups:array<struct<name:string,feeds:array<{feed}>>>>>"
    channels = spark.read.schema(shape).json(path, multiLine=True).select(F.explode_outer("channels").alias("c"))
    groups = channels.select(F.col("c.id").alias("channel"), F.explode_outer("c.groups").alias("g"))
    return groups.select("channel", F.col("g.name").alias("group"), F.explode_outer("g.feeds").alias("f")).select("channel", "group", F.col("f.role").alias("feed"), "f.address", "f.port")


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows (buckets, histograms) as CSV files with a header, for spreadsheets."""
    rows.write.mode("overwrite").option("header", True).csv(path)
