"""Order books in batch. An order's key is (security, side, order id); a null price is a market order, with a tier of its own."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["security_id", "side", "order_id"]


def live_orders(events: DataFrame) -> DataFrame:
    """Orders that live after all events (seq, security_id, side, order_id, action, price, qty): the last event of each, unless it deletes.

    mass_delete clears its side (side null: both). One aggregate finds last events, another last clears; both combine
    before the shuffle, so neither a busy order nor a busy book is a hot key.
    """
    orders = events.where("action in ('new', 'change', 'delete')")
    last = orders.groupBy(*KEY).agg(F.max_by(F.struct("seq", "action", "price", "qty"), "seq").alias("e")).where("e.action <> 'delete'").select(*KEY, "e.seq", "e.price", "e.qty")
    clears = events.where("action = 'mass_delete'").select("security_id", "seq", F.explode(F.when(F.col("side").isin("bid", "ask"), F.array("side")).otherwise(F.array(F.lit("bid"), F.lit("ask")))).alias("side"))
    clears = clears.groupBy("security_id", "side").agg(F.max("seq").alias("cleared"))
    return last.join(clears, ["security_id", "side"], "left").where("cleared is null or seq > cleared").drop("cleared")


def price_levels(orders: DataFrame) -> DataFrame:
    return orders.where("price is not null").groupBy("security_id", "side", "price").agg(F.sum("qty").alias("total_qty"), F.count("*").alias("order_count"))


def market_tier(orders: DataFrame) -> DataFrame:
    return orders.where("price is null").groupBy("security_id", "side").agg(F.sum("qty").alias("total_qty"), F.count("*").alias("order_count"))


def top_of_book(levels: DataFrame) -> DataFrame:
    """Best bid and ask of each security that has either; a side without orders is 0, 0, 0."""
    best = lambda side, pick: pick(F.when(F.col("side") == side, F.struct("price", "total_qty", "order_count")), F.when(F.col("side") == side, F.col("price")))
    found = levels.groupBy("security_id").agg(best("bid", F.max_by).alias("b"), best("ask", F.min_by).alias("a"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    names = (("px", "price"), ("qty", "total_qty"), ("count", "order_count"))
    return found.select("security_id", *(zero(f"b.{c}").alias(f"bid_{n}") for n, c in names), *(zero(f"a.{c}").alias(f"ask_{n}") for n, c in names))


def depth(levels: DataFrame, n: int) -> DataFrame:
    """The n best levels of each side, best first."""
    best = Window.partitionBy("security_id", "side").orderBy(F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")))
    return levels.withColumn("level", F.row_number().over(best)).where(F.col("level") <= n)


def book_summary(orders: DataFrame) -> DataFrame:
    levels = price_levels(orders).groupBy("security_id").agg(F.max("total_qty").alias("max_qty"), F.count("*").alias("levels"), F.sum("order_count").alias("orders"))
    tier = market_tier(orders).groupBy("security_id").agg(F.sum("total_qty").alias("market_qty"))
    out = levels.join(tier, "security_id", "full")
    return out.select("security_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("max_qty", "levels", "orders", "market_qty")))


def orders_on_both_sides(orders: DataFrame) -> DataFrame:
    """Order ids that live on both sides of a book."""
    return orders.groupBy("security_id", "order_id").agg(F.countDistinct("side").alias("sides")).where("sides > 1").select("security_id", "order_id")


def tier_transitions(events: DataFrame) -> DataFrame:
    """By security: how often an order got a price, and how often it lost it."""
    last = Window.partitionBy(*KEY).orderBy("seq")
    moves = events.where("action in ('new', 'change', 'delete')").withColumns({"was": F.lag("price").over(last).isNull(), "did": F.lag("action").over(last)})
    moves = moves.where("did is not null and did <> 'delete' and action <> 'delete'")
    return moves.groupBy("security_id").agg(F.count_if(F.col("was") & F.col("price").isNotNull()).alias("to_priced"), F.count_if(~F.col("was") & F.col("price").isNull()).alias("to_market"))


class Crossing:
    """Live orders of one book: their best prices, and whether they cross."""

    def __init__(self):
        self.live: dict[tuple, int] = {}
        self.heaps: dict[str, list] = {"bid": [], "ask": []}
        self.count: dict[tuple, int] = {}
        self.state = "normal"

    def put(self, side: str, price: int, n: int) -> None:
        key = (side, price)
        left = self.count.get(key, 0) + n
        if left > 0:
            if key not in self.count:
                heapq.heappush(self.heaps[side], -price if side == "bid" else price)
            self.count[key] = left
        else:
            self.count[key] = 0  # best() takes it away, once it is on top

    def best(self, side: str) -> int | None:
        heap = self.heaps[side]
        while heap:
            price = -heap[0] if side == "bid" else heap[0]
            if self.count[side, price] > 0:
                return price
            heapq.heappop(heap)
            del self.count[side, price]
        return None

    def tidy(self) -> None:
        """Builds a heap again that holds mostly prices without orders, so that it follows the live orders and not the history."""
        for side, heap in self.heaps.items():
            if len(heap) > 1000 and len(heap) > 2 * len(self.live):
                self.heaps[side] = [p for p in heap if self.count[side, -p if side == "bid" else p] > 0]
                heapq.heapify(self.heaps[side])
                self.count = {k: n for k, n in self.count.items() if k[0] != side or n > 0}

    def step(self, side: str | None, order: int, action: str, price: int | None) -> tuple[int | None, int | None, str] | None:
        """Best bid, best ask and state after the event, if the state is another one."""
        if action == "mass_delete":
            for key in [k for k in self.live if side not in ("bid", "ask") or k[0] == side]:
                self.put(key[0], self.live.pop(key), -1)
        elif action in ("new", "change", "delete"):
            if (side, order) in self.live:
                self.put(side, self.live.pop((side, order)), -1)
            if action != "delete" and price is not None:
                self.live[side, order] = price
                self.put(side, price, 1)
        self.tidy()
        bid, ask = self.best("bid"), self.best("ask")
        now = "normal" if bid is None or ask is None or bid < ask else "locked" if bid == ask else "crossed"
        if now == self.state:
            return None
        self.state = now
        return bid, ask, now


def crossing_series(events: DataFrame, schema: str = "seq long, security_id long, bid_px long, ask_px long, state string") -> DataFrame:
    """Each change of a book's state after an event: crossed (bid above ask), locked (equal) or normal. An ordered state machine by security.

    Rows come sorted by security and seq, and only the live orders of one security are carried over batches.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, now = Crossing(), object()
        for batch in batches:
            rows = []
            for seq, security, side, order, action, price in zip(*(c.to_pylist() for c in batch.columns)):
                if security != now:
                    book, now = Crossing(), security
                found = book.step(side, order, action, price)
                if found:
                    rows.append((seq, security, *found))
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])

    events = events.select(F.col("seq").cast("long"), F.col("security_id").cast("long"), "side", "order_id", "action", F.col("price").cast("long"))
    return events.repartition("security_id").sortWithinPartitions("security_id", "seq").mapInArrow(run, schema)


def replica(events: DataFrame) -> DataFrame:
    """A client's copy of books from events as for live_orders, and snapshot: an add of a known order replaces it, a change to nothing deletes it, a snapshot (its orders follow as new) clears its side or both."""
    action = F.when((F.col("action") == "change") & (F.col("qty") <= 0), "delete").when(F.col("action") == "snapshot", "mass_delete").otherwise(F.col("action"))
    return live_orders(events.withColumn("action", action))


def after_reset(events: DataFrame, resets: DataFrame, channel: str) -> DataFrame:
    """Events after the last reset (seq) of their channel, which clears every book of it."""
    last = resets.groupBy(channel).agg(F.max("seq").alias("__reset"))
    return events.join(last, channel, "left").where("__reset is null or seq > __reset").drop("__reset")


def compare_ladders(a: DataFrame, b: DataFrame) -> DataFrame:
    """By security the levels (security_id, side, price, total_qty) that two ladders have in common, that differ in quantity, and that only one has."""
    key = ["security_id", "side", "price"]
    both = a.select(*key, F.col("total_qty").alias("x")).join(b.select(*key, F.col("total_qty").alias("y")), key, "full")
    return both.groupBy("security_id").agg(F.count_if(F.expr("x = y")).alias("same"), F.count_if(F.expr("x <> y")).alias("different"), F.count_if(F.expr("x is null or y is null")).alias("alone"))


def findings(orders: DataFrame) -> DataFrame:
    """By security what is wrong with live orders: orders without quantity, ids on both sides, and whether the best prices cross."""
    own = orders.groupBy("security_id", "order_id").agg(F.countDistinct("side").alias("sides"), F.count_if(F.expr("qty <= 0")).alias("empty"), F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"))
    return own.groupBy("security_id").agg(F.sum("empty").alias("empty"), F.count_if(F.expr("sides > 1")).alias("both_sides"), F.coalesce(F.max("bid") > F.min("ask"), F.lit(False)).alias("crossed"))


def level_deltas(events: DataFrame) -> DataFrame:
    """(seq, security_id, side, price, qty, orders): what each event adds to or takes from a price level. An order's state lives until the next event of it, or the next clear of its side."""
    rows = events.where("action in ('new', 'change', 'delete', 'mass_delete')")
    rows = rows.withColumn("side", F.explode(F.when(F.col("side").isin("bid", "ask"), F.array("side")).otherwise(F.array(F.lit("bid"), F.lit("ask")))))
    clear = F.min(F.when(F.col("action") == "mass_delete", F.col("seq"))).over(Window.partitionBy("security_id", "side").orderBy("seq").rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("clear", clear).where("action <> 'mass_delete'")
    rows = rows.withColumn("until", F.least("clear", F.lead("seq").over(Window.partitionBy(*KEY).orderBy("seq")))).where("action <> 'delete' and price is not null")
    one = lambda seq, sign: rows.select(F.col(seq).alias("seq"), "security_id", "side", "price", (sign * F.col("qty")).alias("qty"), F.lit(sign).alias("orders"))
    return one("seq", 1).unionByName(one("until", -1).where("seq is not null"))


def summed_levels(deltas: DataFrame) -> DataFrame:
    """Price levels that deltas add up to."""
    found = deltas.groupBy("security_id", "side", "price").agg(F.sum("qty").alias("total_qty"), F.sum("orders").alias("order_count"))
    return found.where("order_count > 0")
