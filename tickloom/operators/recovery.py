"""Loss and recovery of books: an ordered state machine for each security, in batch and as a stream's state.

A security starts unknown. In sequence it is healthy; a number that skips makes it stale, and from then on book messages
are held until a snapshot heals it that reaches at least the last number known to be lost; what is held after the snapshot
is replayed. So nothing is ever replayed over a hole. A first message that isn't number 1 shows a hole before it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.book import live_orders

RESULT = "seq long, security_id long, op string, outcome string, state string, drain_from long, drain_to long"
DETAILED = "seq long, security_id long, op string, rpt_seq long, outcome string, state string, drain_from long, drain_to long, unsafe long, tail long"
#: Outcomes after which nothing is held any more.
CLEARING = ("healed", "forced", "emptied", "reset")

#: Before the first row: no security, not even null.
_NONE = object()


#: What becomes of messages while a security isn't healthy. What is applied is independent of the book, but may still show that the book lost something.
POLICY = {"book": "hold", "statistic": "apply", "trade": "apply"}


class Book:
    """state: unknown, stale or healthy. seen: highest number of any kind; book: highest applied to the book; top: highest received for it; least: the number that a snapshot must reach; since: when it became stale; marks: highest applied of each kind that doesn't wait for the book."""

    def __init__(self, state: str = "unknown", seen: int = 0, book: int = 0, top: int = 0, least: int = 0, since: int | None = None, marks: dict[str, int] | None = None):
        self.state, self.seen, self.book, self.top, self.least, self.since, self.marks = state, seen, book, top, least, since, dict(marks or {})
        self.lacks: tuple[int | None, int | None] = (None, None)

    def kept(self) -> tuple:
        return self.state, self.seen, self.book, self.top, self.least, self.since, self.marks

    def step(self, op: str, number: int | None, time: int | None = None, policy: dict[str, str] = POLICY, timeout: int = 0) -> tuple[str, int | None, int | None]:
        """Outcome, and the range of held messages that a heal replays. lacks: of a forced heal how far the snapshot falls short of the last number lost, and of the last received."""
        self.lacks = (None, None)
        if op == "reset":
            self.__init__()
            return "reset", None, None
        if op == "mark_stale":
            if self.state == "healthy":
                self.state, self.least, self.since = "stale", self.top, time
            return "marked", None, None
        if op == "empty_snapshot" or op == "snapshot" and number is None:  # of an illiquid security: no orders, no number
            if self.state == "healthy":
                return "skipped", None, None
            self.seen = max(self.seen, self.top, self.least)
            self.state, self.book, self.top, self.least, self.since = "healthy", self.seen, self.seen, 0, None
            return "emptied", None, None
        if op == "snapshot":
            return self.heal(number, time, timeout)
        if number - self.seen > 1:
            if self.state == "healthy":
                self.state, self.since = "stale", time
            self.least = max(self.least, number - 1)
        self.seen = max(self.seen, number)
        way = policy.get(op, "hold")
        if way == "apply":
            new = number > self.marks.get(op, 0)
            self.marks[op] = max(number, self.marks.get(op, 0))
            return "applied" if new else "dropped", None, None
        self.top = max(self.top, number)
        if self.state != "healthy":
            return "dropped" if number <= self.book or way == "drop" else "held", None, None
        if number <= self.book:
            return "dropped", None, None
        self.book = number
        return "applied", None, None

    def heal(self, number: int, time: int | None, timeout: int) -> tuple[str, int | None, int | None]:
        if self.state == "healthy":
            return "skipped", None, None
        if number < self.least:
            overdue = timeout and self.state == "stale" and time is not None and self.since is not None and time - self.since > timeout
            if not overdue:
                return "rejected", None, None
            # what is held can't be joined to the snapshot: it goes, and the book goes on from the snapshot
            self.lacks = (self.least - number, max(0, self.top - number))
            self.state, self.book, self.top, self.least, self.since = "healthy", number, number, 0, None
            return "forced", None, None
        high = max(self.seen, number)
        self.state, self.book, self.top, self.seen, self.least, self.since = "healthy", high, high, high, 0, None
        return "healed", (number + 1 if high > number else None), (high if high > number else None)


def names_of(shape: str) -> list[str]:
    return [f.split()[0] for f in shape.split(", ")]


def replay(rows: DataFrame, policy: dict[str, str] = POLICY, timeout: int = 0) -> DataFrame:
    """detailed() without the numbers and what forced heals lack."""
    return detailed(rows, policy, timeout).select(*names_of(RESULT))


def detailed(rows: DataFrame, policy: dict[str, str] = POLICY, timeout: int = 0) -> DataFrame:
    """Each operation (seq, security_id, op: book, statistic, trade, snapshot, empty_snapshot, mark_stale or reset; rpt_seq, and ts_us if there is one) with what became of it.

    policy: for each other op hold, apply or drop, while a security isn't healthy; each op that is applied has a watermark of
    its own. timeout: microseconds of being stale after which a snapshot that comes too short is taken all the same (0:
    never); unsafe and tail are then what it lacks of the last number lost and of the last received. Rows come sorted by
    security and seq, and only the book of one security is carried over batches.
    """
    import pyarrow as pa

    kinds = (pa.string(), pa.string(), *[pa.int64()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, now = Book(), _NONE
        for batch in batches:
            seqs, securities, ops, numbers, times = (c.to_pylist() for c in batch.columns)
            out = []
            for security, op, number, time in zip(securities, ops, numbers, times):
                if security != now:
                    book, now = Book(), security
                outcome, low, high = book.step(op, number, time, policy, timeout)
                out.append((outcome, book.state, low, high, *book.lacks))
            columns = zip(*out) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(securities, pa.int64()), pa.array(ops, pa.string()), pa.array(numbers, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))], names_of(DETAILED))

    rows = rows.select(F.col("seq").cast("long"), F.col("security_id").cast("long"), F.col("op").cast("string"), F.col("rpt_seq").cast("long"), (F.col("ts_us") if "ts_us" in rows.columns else F.lit(None)).cast("long").alias("ts_us"))
    return rows.repartition("security_id").sortWithinPartitions("security_id", "seq").mapInArrow(run, DETAILED)


def replay_stream(rows: DataFrame) -> DataFrame:
    """The same for a stream, without times and policy: the state of each security is kept between micro-batches; rows of one batch go in order of seq. streaming.stateful.healed_stream has all of it."""
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *kept, marks = state.get if state.exists else (*Book().kept()[:6], "{}")
        book, out = Book(*kept, json.loads(marks)), []
        whole = pd.concat(list(parts)).sort_values("seq")
        for seq, op, number in zip(whole.seq, whole.op, whole.rpt_seq):
            number = int(number) if number == number else None
            outcome, low, high = book.step(op, number)
            out.append((seq, key[0], op, outcome, book.state, low, high))
        state.update((*book.kept()[:6], json.dumps(book.marks)))
        yield pd.DataFrame(out, columns=names_of(RESULT)).astype({"drain_from": "Int64", "drain_to": "Int64"})

    return rows.groupBy("security_id").applyInPandasWithState(run, RESULT, "state string, seen long, book long, top long, least long, since long, marks string", "append", GroupStateTimeout.NoTimeout)


def replayed(found: DataFrame) -> DataFrame:
    """(seq, security_id, op, rpt_seq, healed_by) of the held messages of detailed() that the next heal replays; healed_by is the seq of its snapshot. Of messages with the same number the first is."""
    later = Window.partitionBy("security_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    next_ = F.first(F.when(F.col("outcome").isin(*CLEARING), F.struct("seq", "outcome", "drain_from", "drain_to")), ignorenulls=True).over(later)
    held = found.withColumn("next", next_).where("outcome = 'held' and next.outcome = 'healed' and rpt_seq between next.drain_from and next.drain_to")
    first = Window.partitionBy("security_id", "next.seq", "rpt_seq").orderBy("seq")
    return held.withColumn("n", F.row_number().over(first)).where("n = 1").select("seq", "security_id", "op", "rpt_seq", F.col("next.seq").alias("healed_by"))


def assemble(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """headers (security_id, snapshot, bids, asks) with got_bids, got_asks and complete: whether the entries (security_id, snapshot, side) are as many as announced, on both sides."""
    got = entries.groupBy("security_id", "snapshot").agg(F.count_if(F.col("side") == "bid").alias("got_bids"), F.count_if(F.col("side") == "ask").alias("got_asks"))
    found = headers.join(got, ["security_id", "snapshot"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("got_bids", "got_asks")})
    return found.withColumn("complete", (F.col("got_bids") == F.col("bids")) & (F.col("got_asks") == F.col("asks")))


def heal_floors(snapshots: DataFrame) -> DataFrame:
    """Assembled snapshots (security_id, snapshot, rpt_seq, complete) with least: the highest number of those before it that were replaced while incomplete, which it must reach too; and usable."""
    before = Window.partitionBy("security_id").orderBy("snapshot").rowsBetween(Window.unboundedPreceding, -1)
    found = snapshots.withColumn("least", F.coalesce(F.max(F.when(~F.col("complete"), F.col("rpt_seq"))).over(before), F.lit(0)))
    return found.withColumn("usable", F.col("complete") & (F.col("rpt_seq") >= F.col("least")))


def last_lost(rows: DataFrame) -> DataFrame:
    """(security_id, lost, high): the highest number below the highest of rows (security_id, rpt_seq) that isn't among them (0: none), and that highest. Numbers start at 1."""
    own = Window.partitionBy("security_id").orderBy("rpt_seq")
    steps = rows.select("security_id", "rpt_seq").distinct().withColumn("before", F.coalesce(F.lag("rpt_seq").over(own), F.lit(0)))
    lost = F.max(F.when(F.col("rpt_seq") - F.col("before") > 1, F.col("rpt_seq") - 1))
    return steps.groupBy("security_id").agg(F.coalesce(lost, F.lit(0)).alias("lost"), F.max("rpt_seq").alias("high"))


def rebuild(snapshots: DataFrame, orders: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Books from their last usable snapshot and what came after it, and the securities that stay stale.

    snapshots (security_id, snapshot, rpt_seq); orders: their entries (security_id, snapshot, side, order_id, price, qty);
    events: what was received (as for live_orders, with rpt_seq). A security heals with the newest snapshot that reaches
    its last lost number; the book is the snapshot's orders with the events after its number. The second table is
    (security_id, lost, best), best being the highest number of any snapshot.
    """
    holes = last_lost(events)
    best = snapshots.groupBy("security_id").agg(F.max_by("snapshot", "rpt_seq").alias("snapshot"), F.max("rpt_seq").alias("best"))
    judged = holes.join(best, "security_id", "left")
    healed = judged.where("best >= lost").select("security_id", "snapshot", "best")
    shape = ["seq", "security_id", "side", "order_id", "action", "price", "qty"]
    base = orders.join(healed, ["security_id", "snapshot"]).select(F.lit(-1).cast("bigint").alias("seq"), "security_id", "side", "order_id", F.lit("new").alias("action"), "price", "qty")
    later = events.join(healed, "security_id").where("rpt_seq > best").select(*shape)
    return live_orders(base.unionByName(later)), judged.where("best is null or best < lost").select("security_id", "lost", "best")


def disagreeing(headers: DataFrame, orders: DataFrame) -> DataFrame:
    """Headers (security_id, bids, asks) of healthy securities whose live orders are not as many: to be rebuilt. A security without orders has 0."""
    got = orders.groupBy("security_id").agg(F.count_if(F.col("side") == "bid").alias("got_bids"), F.count_if(F.col("side") == "ask").alias("got_asks"))
    found = headers.join(got, "security_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("got_bids", "got_asks")})
    return found.where("bids <> got_bids or asks <> got_asks")
