"""Rankings, monitors and traffic profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import floor_bucket
from tickloom.operators import scan

#: Upper bounds of the packet size histogram; larger ones count as -1. Fixed values.
SIZES = (80, 128, 192, 256, 384, 512, 768, 1024, 1500)


def ranking(values: DataFrame, value: str, n: int = 10, descending: bool = True) -> DataFrame:
    """The n largest positive values (or most negative), ties to the smaller id."""
    chosen = values.where(F.col(value) > 0 if descending else F.col(value) < 0)
    order = [F.desc(value) if descending else F.asc(value), F.asc("security_id")]
    top = chosen.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows


def recovery_progress(states: DataFrame) -> DataFrame:
    """Known and stale securities by kind, and in all (kind null)."""
    return states.groupingSets([["kind"], []], "kind").agg(F.countDistinct("security_id").alias("known"), F.countDistinct(F.when(F.col("stale"), F.col("security_id"))).alias("stale"))


#: Buckets of a histogram; the driver gets as many counts in a round.
BUCKETS = 1024


def nth(rows: DataFrame, column: str, rank: int) -> int | None:
    """The value of that rank (from 0) of a column of whole numbers, nulls left out; None beyond the last.

    Each round counts the values in BUCKETS ranges between two bounds, and goes on in the range that holds the rank: seven
    rounds at most for 64 bits, and no buffer but one histogram.
    """
    value = F.col(column).cast("decimal(38,0)")
    ends = rows.agg(F.min(value), F.max(value), F.count(column)).first()
    if rank < 0 or rank >= ends[2]:
        return None
    low, high = int(ends[0]), int(ends[1])
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        at = F.expr(f"(cast(`{column}` as decimal(38,0)) - cast('{low}' as decimal(38,0))) div cast('{width}' as decimal(38,0))")
        counts = rows.where(value.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)"))).groupBy(at.alias("at")).count().orderBy("at").collect()
        for r in counts:
            if rank < r["count"]:
                low, high = low + r["at"] * width, min(high, low + (r["at"] + 1) * width - 1)
                break
            rank -= r["count"]
    return low


def whole_median(rows: DataFrame, column: str) -> int | None:
    """The median of whole numbers, rounded down; of an even number of them, of the mean of the two in the middle."""
    n = rows.agg(F.count(column)).first()[0]
    if not n:
        return None
    low = nth(rows, column, (n - 1) // 2)
    return low if n % 2 else (low + nth(rows, column, n // 2)) // 2


def slow_clients(clients: DataFrame, budget: int, pressure: float, factor: int, floor: int) -> DataFrame:
    """Clients (client_id, pending_bytes) above factor * median and floor, if all together press on the budget. The median is whole, and exact."""
    total = clients.agg(F.sum("pending_bytes")).first()[0] or 0
    median = F.lit(whole_median(clients, "pending_bytes")).cast("long")
    limit = F.greatest(median * factor, F.lit(floor))
    return clients.where(F.lit(total >= pressure * budget) & (F.col("pending_bytes") > limit)).select("client_id", "pending_bytes", median.alias("median"))


def hysteresis(rows: DataFrame, key: str, value: str, high: float, low: float, order: str) -> DataFrame:
    """Adds engaged: from reaching high until falling to low."""
    event = F.when(F.col(value) >= high, True).when(F.col(value) <= low, False)
    found = scan.prefix(rows, key, [order], {"engaged": ("last", event)})
    return found.withColumn("engaged", F.coalesce("engaged", F.lit(False)))


def traffic_buckets(packets: DataFrame, width: int) -> DataFrame:
    """By channel and bucket (of ts): packets, bytes, smallest and largest. Empty buckets have no row."""
    bucket = floor_bucket(F.col("ts"), width).alias("bucket")
    return packets.groupBy("channel", bucket).agg(F.count("*").alias("pkts"), F.sum("size").alias("bytes"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))


def rolling_peak(buckets: DataFrame, width: int, window: int) -> DataFrame:
    """By channel the most packets in any window, idle time included."""
    rolling = Window.partitionBy("channel").orderBy("bucket").rangeBetween(-(window - width), 0)
    return buckets.withColumn("__n", F.sum("pkts").over(rolling)).groupBy("channel").agg(F.max("__n").alias("peak"))


def size_histogram(packets: DataFrame) -> DataFrame:
    """By channel and size bound the number of packets, zero where there are none."""
    bound = F.lit(-1)
    for size in reversed(SIZES):
        bound = F.when(F.col("size") <= size, size).otherwise(bound)
    found = packets.groupBy("channel", bound.alias("bin")).agg(F.count("*").alias("n"))
    bins = found.select("channel").distinct().select("channel", F.explode(F.array(*(F.lit(s) for s in (*SIZES, -1)))).alias("bin"))
    return bins.join(found, ["channel", "bin"], "left").select("channel", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def channel_summary(packets: DataFrame, width: int = 100, window: int = 1000) -> DataFrame:
    """By channel packets, bytes, duration (of ts, in milliseconds), packets a second over it (null if there is none), and the most packets of any bucket of width and of any window."""
    sums = packets.groupBy("channel").agg(F.count("*").alias("pkts"), F.sum("size").alias("bytes"), (F.max("ts") - F.min("ts")).alias("duration"))
    buckets = traffic_buckets(packets, width)
    peaks = buckets.groupBy("channel").agg(F.max("pkts").alias("peak_bucket")).join(rolling_peak(buckets, width, window).withColumnRenamed("peak", "peak_window"), "channel")
    return sums.withColumn("per_second", F.when(F.col("duration") > 0, F.floor(F.col("pkts") * 1000 / F.col("duration")))).join(peaks, "channel")


def compare_baselines(baselines: DataFrame, runs: DataFrame, keys: list[str], value: str, percent: float) -> DataFrame:
    """Each baseline with delta (percent) and verdict: PASS, FAIL (slower than the tolerance) or MISSING."""
    joined = baselines.join(runs.select(*keys, F.col(value).alias("__now")), keys, "left")
    joined = joined.withColumn("delta", (F.col("__now") - F.col(value)) * 100 / F.col(value))
    return joined.withColumn("verdict", F.when(F.col("__now").isNull(), "MISSING").when(F.col("delta") > percent, "FAIL").otherwise("PASS")).drop("__now")


def unhealthy(groups: DataFrame, now: int, limit: int) -> DataFrame:
    """Groups (name, state, last) that aren't streaming, or were quiet for longer than limit; why."""
    why = F.when(F.col("state") != "Streaming", "state").when(F.lit(now) - F.col("last") > limit, "quiet")
    return groups.withColumn("why", why).where("why is not null")


def heaviest(rows: DataFrame, key: str, part: str, n: int = 10, m: int = 8) -> DataFrame:
    """(key, total, rank, part, count, part_rank): the n keys with most rows, and of each the m parts (templates) with most; ties go to the smaller.

    Counts by (key, part) combine before the shuffle, and totals are made of them; only the n keys are joined back. Rows
    without a key aren't counted, a null part is one like others and comes first among equals.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key, part).agg(F.count("*").alias("count"))
    top = counts.groupBy(key).agg(F.sum("count").alias("total")).orderBy(F.desc("total"), key).limit(n)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), key)))  # n rows
    own = Window.partitionBy(key).orderBy(F.desc("count"), part)
    return counts.join(F.broadcast(top), key).withColumn("part_rank", F.row_number().over(own)).where(F.col("part_rank") <= m).select(key, "total", "rank", part, "count", "part_rank")
