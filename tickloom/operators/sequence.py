"""Sequence numbers: gaps, duplicates, epochs, coverage. State is per key, so every window is partitioned by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import scan


def classify_gaps(rows: DataFrame, key: str, number: str, order: str = "seq") -> DataFrame:
    """Adds expected and result: in, dup or gap. A gap is jumped over; numbers start at 1."""
    rows = scan.prefix(rows, key, [order], {"expected": ("max", F.col(number))}, inclusive=False)
    rows = rows.withColumn("expected", F.coalesce("expected", F.lit(0)) + 1)
    return rows.withColumn("result", F.when(F.col(number) == F.col("expected"), "in").when(F.col(number) < F.col("expected"), "dup").otherwise("gap"))


def first_copies(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of redundant feeds the copy that arrived first (all that arrived on either, however late)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def current_epoch(rows: DataFrame, key: str, version: str, order: str = "seq") -> DataFrame:
    """Drops version 0 and rows of a version lower than one seen before; adds epoch, the highest so far."""
    return scan.prefix(rows.where(F.col(version) > 0), key, [order], {"epoch": ("max", F.col(version))}).where(F.col(version) == F.col("epoch"))


def gap_statistics(rows: DataFrame, key: str, number: str, kind: str, order: str = "seq") -> DataFrame:
    """By kind of the message that showed the gap: gaps, missing numbers and keys; kind null is the total."""
    found = classify_gaps(rows, key, number, order).where("result = 'gap' and expected > 1").withColumn("missing", F.col(number) - F.col("expected"))
    return found.groupingSets([[kind], []], kind).agg(F.count("*").alias("gaps"), F.sum("missing").alias("missing"), F.countDistinct(key).alias("keys"))


def sequence_invariants(rows: DataFrame, key: str, number: str, kind: str, order: str = "seq") -> DataFrame:
    """By key: rows, numbers that go back, that stay, that skip, and steps between different kinds."""
    last = Window.partitionBy(key).orderBy(order)
    step = rows.withColumns({"__step": F.col(number) - F.lag(number).over(last), "__other": F.lag(kind).over(last) != F.col(kind)})
    return step.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("__step") < 0).alias("back"), F.count_if(F.col("__step") == 0).alias("same"), F.count_if(F.col("__step") > 1).alias("skipped"), F.count_if((F.col("__step") > 0) & F.col("__other")).alias("across_kinds")
    )


def packet_invariants(rows: DataFrame, packet: str, key: str, number: str, order: str = "seq") -> DataFrame:
    """By packet: messages, and those whose number isn't above that of the message before of the same key in the packet. Messages without a number are only counted."""
    last = Window.partitionBy(packet, key).orderBy(order)
    before = F.last(number, ignorenulls=True).over(last.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__back", F.col(number) <= before).groupBy(packet).agg(F.count("*").alias("n"), F.count_if("__back").alias("back"))


def missing_numbers(rows: DataFrame, bounds: DataFrame, key: str, number: str) -> DataFrame:
    """For each key of bounds (key, low, high): the numbers in (low, high] that rows don't have; a replay is complete if there are none."""
    bounds = bounds.where("high > low").select(key, "low", "high")
    inside = rows.select(key, number).join(bounds.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key")).where(f"{number} between low + 1 and high").select(key, number)
    ends = bounds.select(key, F.explode(F.array(F.col("low"), F.col("high") + 1)).alias(number))
    # only the gaps between neighbours become rows
    step = inside.unionByName(ends).distinct().withColumn("__next", F.lead(number).over(Window.partitionBy(key).orderBy(number))).where(f"__next - {number} > 1")
    return step.select(key, F.explode(F.sequence(F.col(number) + 1, F.col("__next") - 1)).alias(number))


def bootstrap_ready(rows: DataFrame, channel: str, key: str, total: str, order: str = "seq", limit: int | None = None) -> DataFrame:
    """(channel, ready): when the distinct keys seen reach the first total that was announced; with a limit, at the first row that is so much later than the channel's first, if that comes before."""
    first = rows.groupBy(channel).agg(F.min_by(total, order).alias("__total"), F.min(order).alias("__first"))
    new = first_copies(rows, [channel, key], order).withColumn("__seen", F.row_number().over(Window.partitionBy(channel).orderBy(order)))
    full = new.join(first, channel).where(F.col("__seen") >= F.col("__total")).groupBy(channel).agg(F.min(order).alias("ready"))
    if limit is None:
        return full
    stuck = rows.join(first, channel).where(F.col(order) - F.col("__first") >= limit).groupBy(channel).agg(F.min(order).alias("ready"))
    return full.unionByName(stuck).groupBy(channel).agg(F.min("ready").alias("ready"))


def after_bootstrap(rows: DataFrame, ready: DataFrame, channel: str, order: str = "seq") -> DataFrame:
    """Without what came before its channel was ready (channel, ready); channels that never were have no rows."""
    return rows.join(ready, channel).where(F.col(order) >= F.col("ready")).drop("ready")


class Reorder:
    """One channel's packets put in order: what is ahead waits, up to a distance or for a time; then the gap is accepted.

    Whoever accepts a gap goes out at once, and all waiting packets above it follow in order, over further gaps; those below
    it are dropped. The first packet of all seeds the numbering if it is far ahead. Times are in milliseconds. With timers a
    stall needs no packet to show: when the time is over, all that waits goes out.
    """

    def __init__(self, window: int, stall: int, timers: bool = False, expected: int = 1, since: int | None = None, waiting: dict | None = None):
        self.window, self.stall, self.timers = window, stall, timers
        self.expected, self.since, self.waiting = expected, since, dict(waiting or {})

    def due(self) -> int | None:
        """When the time of what waits is over; a packet of that moment still comes before."""
        return self.since + self.stall if self.timers and self.waiting else None

    def expire(self, now: int | None) -> list[tuple]:
        """(packet, reason) of what goes out because its time was over before now."""
        due = self.due()
        if due is None or now is None or now <= due:
            return []
        first = min(self.waiting)
        return [(self.waiting.pop(first), "gap"), *self.released(first, due)]

    def released(self, number: int, time: int) -> list[tuple]:
        """What goes out, or is dropped, after a gap was accepted at number."""
        out = []
        self.expected, self.since = number + 1, time
        for n in sorted(self.waiting):
            passed = n < self.expected
            out.append((self.waiting.pop(n), "passed" if passed else "released"))
            if not passed:
                self.expected = n + 1
        return out

    def take(self, seq: int, time: int, packet) -> list[tuple]:
        """(packet, reason) of all packets that this one settles: in, released, gap, duplicate or passed."""
        before = self.expire(time)
        if self.since is None:
            self.since = time
            if seq - self.expected > self.window:
                self.expected = seq
        if seq < self.expected or seq in self.waiting:
            return [*before, (packet, "duplicate")]
        if seq > self.expected:
            if seq - self.expected <= self.window and time - self.since < self.stall:
                self.waiting[seq] = packet
                return before
            return [*before, (packet, "gap"), *self.released(seq, time)]
        out = [*before, (packet, "in")]
        self.expected, self.since = seq + 1, time
        while self.expected in self.waiting:
            out.append((self.waiting.pop(self.expected), "released"))
            self.expected += 1
        return out


GOES = ("in", "gap", "released")
ORDERED = "channel string, arrival long, seq long, position long, reason string"


def reordered(rows: DataFrame, window: int = 256, stall: int = 2000, timers: bool = False, until: int | None = None) -> DataFrame:
    """(channel, arrival, seq, position, reason) of packets (channel, arrival, seq, time): in which order they go out, and why; position is null for those that don't (duplicate, passed, or waiting at the end).

    timers: what waits goes out when the time is over, without a next packet; until: the time up to which that is known at
    the end. Rows come sorted by channel and arrival; what is carried over batches is the packets that wait in one channel,
    window of them at most.
    """
    import pyarrow as pa

    def run(batches):
        state, now, position = None, object(), 0

        def placed(settled):
            nonlocal position
            for (arrival, seq), reason in settled:
                position += reason in GOES
                yield now, arrival, seq, position if reason in GOES else None, reason

        def rest():
            if state:
                yield from placed(state.expire(until))
                yield from placed((packet, "waiting") for packet in state.waiting.values())

        for batch in batches:
            out = []
            for channel, arrival, seq, time in zip(*(c.to_pylist() for c in batch.columns)):
                if channel != now:
                    out += rest()
                    state, now, position = Reorder(window, stall, timers), channel, 0
                out += placed(state.take(seq, time, (arrival, seq)))
            yield of(out)
        yield of([*rest()])

    def of(rows):
        columns = zip(*rows) if rows else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in ORDERED.split(", ")])

    rows = rows.select(F.col("channel").cast("string"), F.col("arrival").cast("long"), F.col("seq").cast("long"), F.col("time").cast("long"))
    return rows.repartition("channel").sortWithinPartitions("channel", "arrival").mapInArrow(run, ORDERED)


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with quarantine: the name of the first check that doesn't hold (a null result doesn't), else null. Bad rows stop nothing."""
    reason = None
    for name, holds in checks.items():
        failed = ~F.coalesce(holds, F.lit(False))
        reason = F.when(failed, name) if reason is None else reason.when(failed, name)
    return rows.withColumn("quarantine", F.lit(None).cast("string") if reason is None else reason)


def match_flags(rows: DataFrame, key: str, flags: str, end: int, recovery: int) -> DataFrame:
    """By key the events that end a match, and those that were sent in recovery."""
    return rows.groupBy(key).agg(F.count_if(F.col(flags).bitwiseAND(F.lit(end)) != 0).alias("ends"), F.count_if(F.col(flags).bitwiseAND(F.lit(recovery)) != 0).alias("recovered"))
