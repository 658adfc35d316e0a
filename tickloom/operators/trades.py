"""Trades and candles. Prices are whole mantissas; late means late in arrival order, not against a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import floor_bucket, has_flag
from tickloom.operators import scan

OUT_OF_SEQUENCE = 1


def reportable(trades: DataFrame) -> DataFrame:
    """Without trades out of sequence, and without those of a strategy's legs."""
    return trades.where(~has_flag(F.col("condition"), OUT_OF_SEQUENCE) & (F.col("sub_type").isNull() | (F.col("sub_type") != "leg")))


def recent(trades: DataFrame, n: int) -> DataFrame:
    last = Window.partitionBy("security_id").orderBy(F.desc("seq"))
    return trades.withColumn("n", F.row_number().over(last)).where(F.col("n") <= n)


def without_busted(trades: DataFrame, busts: DataFrame) -> DataFrame:
    """Trades that no later bust names. A bust that comes before its trade does nothing."""
    last = busts.groupBy("security_id", "trade_id").agg(F.max("seq").alias("__bust"))
    return trades.join(last, ["security_id", "trade_id"], "left").where("__bust is null or __bust < seq").drop("__bust")


def last_trade(trades: DataFrame) -> DataFrame:
    return trades.groupBy("security_id").agg(F.max_by(F.struct("price", "qty", "seq"), "seq").alias("t")).select("security_id", "t.price", "t.qty", "t.seq")


def in_time(trades: DataFrame, width: int) -> DataFrame:
    """Trades with time, their bucket; without those in an earlier bucket than a trade before them. avg, if there is none, is the price."""
    trades = trades.withColumn("time", floor_bucket(F.col("second"), width))
    if "avg" not in trades.columns:
        trades = trades.withColumn("avg", F.col("price"))
    return scan.prefix(trades, "security_id", ["seq"], {"high_time": ("max", F.col("time"))}, inclusive=False).where("high_time is null or time >= high_time").drop("high_time")


def candles(trades: DataFrame, width: int = 1) -> DataFrame:
    """(security_id, time, open, high, low, close, volume, avg): a trade in an earlier bucket than one before it is late and ignored.

    A candle opens at the previous close, and its high and low include that. avg: of the last trade, if trades have one,
    else its price. The late filter, the aggregate and the continuity need rows by security, so they share one exchange.
    """
    bars = in_time(trades, width).groupBy("security_id", "time").agg(F.min_by("price", "seq").alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("qty").alias("volume"), F.max_by("avg", "seq").alias("avg"))
    return continuous(bars)


def rebuilt(trades: DataFrame, busts: DataFrame, width: int = 1) -> DataFrame:
    """Candles after busts (seq, security_id, trade_id), with busted: how many trades of the candle were reversed.

    A candle is made again from the trades that are left; which are late is judged before the reversals, and avg stays. One
    without any is dropped if it is the security's last, else it stays as a flat one at the close before it, without
    volume; if there is none before it, at its own old close.
    """
    last = busts.groupBy("security_id", "trade_id").agg(F.max("seq").alias("__bust"))
    marked = in_time(trades, width).join(last, ["security_id", "trade_id"], "left").withColumn("__gone", F.coalesce(F.col("__bust") >= F.col("seq"), F.lit(False)))
    left = lambda c: F.when(~F.col("__gone"), F.col(c))
    bars = marked.groupBy("security_id", "time").agg(
        F.min_by("price", left("seq")).alias("first"), F.max(left("price")).alias("high"), F.min(left("price")).alias("low"), F.max_by("price", left("seq")).alias("close"), F.coalesce(F.sum(left("qty")), F.lit(0)).alias("volume"),
        F.max_by("avg", "seq").alias("avg"), F.max_by("price", "seq").alias("was"), F.count_if("__gone").alias("busted"), F.count_if(~F.col("__gone")).alias("left"),
    )
    own = Window.partitionBy("security_id").orderBy("time")
    bars = bars.withColumn("next", F.lead("time").over(own)).where("`left` > 0 or next is not null")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.withColumn("close", F.coalesce(F.last("close", ignorenulls=True).over(so_far), F.first("was").over(so_far)))
    flat = {c: F.coalesce(c, "close") for c in ("first", "high", "low")}
    kept = bars.withColumns(flat).withColumn("open", F.when(F.col("left") > 0, F.coalesce(F.lag("close").over(own), "first")).otherwise(F.col("close")))
    return kept.select("security_id", "time", "open", F.greatest("high", "open").alias("high"), F.least("low", "open").alias("low"), "close", "volume", "avg", "busted")


def continuous(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("security_id").orderBy("time"))
    bars = bars.withColumn("open", F.coalesce(before, F.col("first")))
    return bars.select("security_id", "time", "open", F.greatest("high", "open").alias("high"), F.least("low", "open").alias("low"), "close", "volume", "avg")


def fill_gaps(bars: DataFrame, width: int = 1, most: int = 60) -> DataFrame:
    """Flat candles without volume between two candles, most of them after each at most."""
    gap = (F.lead("time").over(Window.partitionBy("security_id").orderBy("time")) - F.col("time")) / width - 1
    filled = bars.withColumn("__gap", F.when(gap.isNotNull(), F.least(gap, F.lit(most))).otherwise(0).cast("int"))
    filled = filled.withColumn("__k", F.explode(F.sequence(F.lit(0), "__gap"))).drop("__gap")
    real = F.col("__k") == 0
    flat = {c: F.when(real, F.col(c)).otherwise(F.col("close")) for c in ("open", "high", "low")}
    return filled.withColumns({**flat, "volume": F.when(real, F.col("volume")).otherwise(0), "time": F.col("time") + F.col("__k") * width}).drop("__k")


def newest(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn("__n", F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("time")))).where(F.col("__n") <= n).drop("__n")


def resample(bars: DataFrame, width: int, most: int = 600) -> DataFrame:
    """Wider candles: merged high and low, summed volume, last avg, opened at the previous close, gaps filled."""
    wide = bars.withColumn("wide", floor_bucket(F.col("time"), width)).groupBy("security_id", F.col("wide")).agg(
        F.min_by("open", "time").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"), F.max_by("avg", "time").alias("avg")
    )
    return fill_gaps(continuous(wide.withColumnRenamed("wide", "time")), width, most)


def as_of(rows: DataFrame, facts: DataFrame, columns: list[str], key: str = "security_id", order: str = "seq") -> DataFrame:
    """rows with the latest non-null value of each column of facts by arrival (of an equal order, facts come first)."""
    names = [c for c in rows.columns if c not in (key, order)]
    left = rows.select(key, order, F.lit(1).alias("__kind"), F.struct(*names).alias("__row"), *(F.lit(None).cast(dict(facts.dtypes)[c]).alias(c) for c in columns))
    right = facts.select(key, order, F.lit(0).alias("__kind"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), *columns)
    both = scan.prefix(left.unionByName(right), key, [order, "__kind"], {c: ("last", F.col(c)) for c in columns})
    return both.where("__kind = 1").select(key, order, "__row.*", *columns)


def phase_gated(trades: DataFrame, status: DataFrame, open_status: int) -> DataFrame:
    """Trades while the security's status is open; an unknown status counts as open."""
    return as_of(trades, status, ["status"]).where(F.coalesce("status", F.lit(open_status)) == open_status)


def auction_print(condition: Column, status: Column, opening: int, phases: tuple[int, ...]) -> Column:
    return has_flag(condition, opening) | F.coalesce(status.isin(*phases), F.lit(False))


def aggressor(price: Column, bid: Column, ask: Column) -> Column:
    """1: the buyer (at the ask or above), -1: the seller, 0: neither is known."""
    return F.when(ask.isNotNull() & (price >= ask), 1).when(bid.isNotNull() & (price <= bid), -1).otherwise(0)


def last_price(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """The last trade of each security; of one without trades the close of its last candle, with quantity 0 and no seq."""
    close = bars.groupBy("security_id").agg(F.max_by("close", "time").alias("close"))
    found = last_trade(trades).join(close, "security_id", "full")
    return found.select("security_id", F.coalesce("price", "close").alias("price"), F.coalesce("qty", F.lit(0)).alias("qty"), "seq")


def display_bars(bars: DataFrame, width: int = 1, most: int = 600) -> DataFrame:
    """Candles as a chart shows them: opened at the previous close, gaps filled, avg of filled ones being their close."""
    shown = fill_gaps(continuous(bars.withColumnRenamed("open", "first")), width, most)
    return shown.withColumn("avg", F.when(F.col("volume") == 0, F.col("close")).otherwise(F.col("avg")))


def last_wide_bar(bars: DataFrame, width: int) -> DataFrame:
    """The newest wider candle of each security, from its own candles alone: avg is weighted by volume (rounded down; the close if there is none)."""
    wide = floor_bucket(F.col("time"), width)
    rows = bars.withColumns({"wide": wide, "__last": F.max(wide).over(Window.partitionBy("security_id"))}).where("wide = __last")
    exact = "decimal(38,0)"
    found = rows.groupBy("security_id", F.col("wide").alias("time")).agg(
        F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"), F.sum(F.col("avg").cast(exact) * F.col("volume").cast(exact)).alias("paid")
    )
    avg = F.when(F.col("volume") > 0, F.expr("paid div volume")).otherwise(F.col("close"))
    return found.withColumn("avg", avg.cast("bigint")).drop("paid")


def bars_at(bars: DataFrame, times: DataFrame, width: int) -> DataFrame:
    """The candle in whose bucket each (security_id, at) lies, if there is one."""
    return times.withColumn("time", floor_bucket(F.col("at"), width)).join(bars, ["security_id", "time"])


def with_last_trade(instruments: DataFrame, trades: DataFrame) -> DataFrame:
    """Instruments with last_price and last_qty."""
    last = last_trade(trades).select("security_id", F.col("price").alias("last_price"), F.col("qty").alias("last_qty"))
    return instruments.join(last, "security_id", "left")
