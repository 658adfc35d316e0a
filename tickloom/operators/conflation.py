"""Conflated change streams: what is left of the events of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import has_flag
from tickloom.operators import jumps, scan


def orders(events: DataFrame, keys: list[str]) -> DataFrame:
    """By window and order (keys) the net change of events (seq, kind: Add, Update or Delete, price, qty).

    An order was there before unless its first event adds it, and is there after unless its last deletes it.
    """
    net = events.groupBy(*keys).agg(F.min_by("kind", "seq").alias("first"), F.max_by(F.struct("kind", "price", "qty"), "seq").alias("last"))
    before, after = F.col("first") != "Add", F.col("last.kind") != "Delete"
    kind = F.when(before & after, "Update").when(before, "Delete").when(after, "Add")
    return net.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", "last.price", "last.qty")


def trades(prints: DataFrame, keys: list[str]) -> DataFrame:
    """By window, security and price (keys): summed quantity, last trade id, all flags."""
    return prints.groupBy(*keys).agg(F.sum("qty").alias("qty"), F.max_by("trade_id", "seq").alias("trade_id"), F.bit_or("flags").alias("flags"))


def last_of(events: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """By window and key the last values; updates and deletes share a key."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*values), "seq").alias("v")).select(*keys, "v.*")


def after_clears(events: DataFrame, keys: list[str]) -> DataFrame:
    """Without what a clear in the same window (keys) makes void; clears themselves stay, and come first by emit_rank."""
    cleared = F.max(F.when(F.col("kind") == "Clear", F.col("seq"))).over(Window.partitionBy(*keys))
    rows = events.withColumn("__clear", cleared).where(F.col("__clear").isNull() | (F.col("seq") >= F.col("__clear"))).drop("__clear")
    return rows.withColumn("emit_rank", F.when(F.col("kind") == "Clear", 0).otherwise(1))


def route(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events (security_id, channel_bit) for each client that subscribed to the security with that bit set."""
    return events.join(subscriptions, "security_id").where(F.col("flags").bitwiseAND(F.col("channel_bit")) != 0)


def route_counts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """By client how many events route() gives it, and the first of them. Events are summed by security and bit before the join."""
    sums = events.groupBy("security_id", "channel_bit").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"))
    return route(sums, subscriptions).groupBy("client_id").agg(F.sum("events").alias("events"), F.min("first_seq").alias("first_seq"))


def changed_levels(changes: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels (security_id, side, price) that changes touch, once each, with what is left of them."""
    dirty = changes.where("action in ('new', 'change', 'delete') and price is not null").select("security_id", "side", "price").distinct()
    found = dirty.join(levels, ["security_id", "side", "price"], "left")
    return found.select("security_id", "side", "price", F.coalesce("total_qty", F.lit(0)).alias("total_qty"), F.col("total_qty").isNull().alias("deleted"))


def batches(events: DataFrame, keys: list[str]) -> DataFrame:
    """All changes of a window and book side, in order, as one list; nothing is merged."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "action", "price")))
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["seq"].cast("string"), x["action"], x["price"].cast("string"))), ",").alias("changes"))


def chunks(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Adds chunk, first and last of snapshot frames of size rows."""
    own = Window.partitionBy(key)
    rows = rows.withColumns({"__n": F.row_number().over(own.orderBy(order)) - 1, "__all": F.count("*").over(own)})
    rows = rows.withColumn("chunk", F.floor(F.col("__n") / size))
    return rows.withColumns({"first": F.col("chunk") == 0, "last": F.col("chunk") == F.floor((F.col("__all") - 1) / size)}).drop("__n", "__all")


def valid_flags(flags, allowed: int):
    """A request's flags: at least one, and none but those allowed."""
    return (flags != 0) & ~has_flag(flags, ~allowed)


#: Order in which one flush sends its kinds. Fixed values.
EMISSION = ("Clear", "Order", "Tier", "Trade", "Candle", "Stale", "Level")


def emission(kind: Column) -> Column:
    """Rank of a kind in a flush."""
    out = F.lit(len(EMISSION))
    for rank, name in enumerate(EMISSION):
        out = F.when(kind == name, rank).otherwise(out)
    return out


def tiers(events: DataFrame, keys: list[str]) -> DataFrame:
    """By window, security and side the last total of market orders: of events (seq, total_qty, order_count)."""
    return last_of(events, keys, ["total_qty", "order_count"])


def stale_flags(states: DataFrame, keys: list[str]) -> DataFrame:
    """By window and security the last flag of rows (seq, stale), and whether a heal in the window asks for a new snapshot."""
    return states.groupBy(*keys).agg(F.max_by("stale", "seq").alias("stale"), (F.bool_or("stale") & ~F.max_by("stale", "seq")).alias("snapshot"))


def anchored_windows(events: DataFrame, key: str, time: str, length: int, order: str = "seq", hot: int = scan.HOT) -> DataFrame:
    """events with opened: the time of the first event of their window. A window opens with the first event after the last one was flushed, and takes what comes less than length later (0: each event is its own).

    A window's start depends on the one before. Only an event later than all before it can open one; the next opens with the
    first that is length or more after it. An event that comes that long after all others opens one in any case; from these
    the openers between are found by jumps. What has no time, or goes back, belongs to the window that is open (null: none yet).
    """
    moment = F.col(time).cast("long")
    rows = scan.prefix(events, key, [order], {"__before": ("max", moment)}, inclusive=False, hot=hot).withColumn("__most", F.greatest("__before", moment))
    if length <= 0:
        return rows.withColumn("opened", F.col("__most")).drop("__before", "__most")
    later = jumps.settled(rows.where((F.col("__before").isNull() & moment.isNotNull()) | (moment > F.col("__before"))).select(F.col(key), moment.alias("place"), "__before"))
    points = later.select(key, "place", F.col("place").alias("value"))
    steps = jumps.first_after(later.select(key, "place", (F.col("place") + length).alias("due")), points, key, "due", "to", hot=hot)
    roots = later.where(F.col("__before").isNull() | (F.col("place") - F.col("__before") >= length))
    opened = jumps.reached(steps, roots, key).select(key, F.col("place").alias("__most"), F.col("place").alias("__opener"), F.lit(0).alias("__turn"))
    both = rows.withColumn("__turn", F.lit(1)).unionByName(opened, allowMissingColumns=True)
    found = scan.prefix(both, key, ["__most", "__turn"], {"opened": ("max", F.col("__opener"))}, hot=hot).where("__turn = 1")
    return found.select(*events.columns, "opened")


def snapshot_bundle(parts: dict[int, DataFrame], requests: DataFrame) -> DataFrame:
    """What requests (client_id, security_id, flags) get: (client_id, security_id, part, content), content being the row of a part as JSON. parts: by flag bit, each with a security_id."""
    every = None
    for bit, frame in parts.items():
        content = F.to_json(F.struct(*sorted(c for c in frame.columns if c != "security_id")))
        one = frame.select("security_id", F.lit(bit).alias("part"), content.alias("content"))
        every = one if every is None else every.unionByName(one)
    found = every.join(requests, "security_id").where(F.col("flags").bitwiseAND(F.col("part")) != 0)
    return found.select("client_id", "security_id", "part", "content")


def fragments(news: DataFrame, size: int) -> DataFrame:
    """Parts (news_id, part_number, part_count, text) of size characters of items (news_id, text); an empty text is one part."""
    count = F.greatest(F.lit(1), F.ceil(F.length("text") / size)).cast("int")
    rows = news.withColumn("part_count", count).withColumn("part_number", F.explode(F.sequence(F.lit(1), "part_count")))
    return rows.select("news_id", "part_number", "part_count", F.substring("text", (F.col("part_number") - 1) * size + 1, F.lit(size)).alias("text"))


def valid_cadence(interval, least: int = 100, allowed: tuple[int, ...] = (0, 100, 250, 500)):
    """Milliseconds of a client's cadence: none, or one of the tiers."""
    return interval.isin(*allowed) & ((interval == 0) | (interval >= least))
