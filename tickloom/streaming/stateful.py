"""State machines on streams: packets put in order, and books healed, with Spark's state and timers.

Both keep what they wait for in Spark's state store (a map of packets, a list of held messages), so a query that is started
again from its checkpoint goes on where it was; results are those of the batch forms (operators.sequence.reordered,
operators.recovery.detailed and replayed) row for row. Rows of one micro-batch and key are taken in order of arrival or seq.
The session needs the RocksDB state store (STORE).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.recovery import CLEARING, DETAILED, POLICY, Book
from tickloom.operators.sequence import GOES, ORDERED, Reorder

if TYPE_CHECKING:
    import pandas as pd

#: Setting of the session, and the state store that these operators need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HEALED = DETAILED + ", healed_by long"


def frame(rows: list[tuple], shape: str) -> pd.DataFrame:
    """Rows in the types of shape; numbers may be missing."""
    import pandas as pd

    names = [c.split() for c in shape.split(", ")]
    out = pd.DataFrame(rows, columns=[n for n, _ in names])
    return out.astype({n: "Int64" if kind == "long" else object for n, kind in names})


def in_order(parts: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    import pandas as pd

    return pd.concat(list(parts)).sort_values(order, kind="stable")


def whole(value) -> int | None:
    """A number, or None for any kind of missing one."""
    return None if value is None or value != value else int(value)


class Ordering(StatefulProcessor):
    """Reorder() of a channel: state (expected, since, position), a map of the packets that wait, and a timer for the moment when their time is over."""

    def __init__(self, window: int, stall: int):
        self.window, self.stall = window, stall

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "expected long, since long, position long, timer long")
        self.waiting = handle.getMapState("waiting", "seq long", "arrival long")

    def load(self) -> tuple[Reorder, int, int | None]:
        if not self.state.exists():
            return Reorder(self.window, self.stall, True), 0, None
        expected, since, position, timer = self.state.get()
        waiting = {int(seq): (int(arrival), int(seq)) for (seq,), (arrival,) in self.waiting.iterator()}
        return Reorder(self.window, self.stall, True, int(expected), int(since), waiting), int(position), whole(timer)

    def save(self, now: Reorder, before: set[int], position: int, timer: int | None) -> None:
        for seq in before - set(now.waiting):
            self.waiting.removeKey((seq,))
        for seq in set(now.waiting) - before:
            self.waiting.updateValue((seq,), (now.waiting[seq][0],))
        due = now.due()
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer + 1)
            if due is not None:
                self.handle.registerTimer(due + 1)
        self.state.update((now.expected, now.since, position, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, position, timer = self.load()
        before, settled = set(now.waiting), []
        whole_ = in_order(rows, "arrival")
        for arrival, seq, time in zip(whole_.arrival.tolist(), whole_.seq.tolist(), whole_.time.tolist()):
            settled += now.take(int(seq), int(time), (int(arrival), int(seq)))
        yield self.placed(key[0], settled, now, before, position, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, position, timer = self.load()
        before = set(now.waiting)
        settled = now.expire(expiredTimerInfo.getExpiryTimeInMs())
        yield self.placed(key[0], settled, now, before, position, None if timer is None or timer < expiredTimerInfo.getExpiryTimeInMs() else timer)

    def placed(self, channel, settled, now, before, position, timer) -> pd.DataFrame:
        out = []
        for (arrival, seq), reason in settled:
            position += reason in GOES
            out.append((channel, arrival, seq, position if reason in GOES else None, reason))
        self.save(now, before, position, timer)
        return frame(out, ORDERED)

    def close(self) -> None:
        pass


def reordered_stream(packets: DataFrame, window: int = 256, stall: int = 2000, late: str = "0 seconds") -> DataFrame:
    """sequence.reordered() with timers, of a stream of packets (channel, arrival, seq, ts). Times are those of ts; a gap is accepted once the stream's watermark (late behind the newest packet of all channels) shows that its time is over."""
    rows = packets.withWatermark("ts", late).select("channel", "arrival", "seq", F.unix_millis("ts").alias("time"), "ts")
    shape = T.StructType.fromDDL(ORDERED)
    return rows.groupBy("channel").transformWithStateInPandas(Ordering(window, stall), shape, "Append", "EventTime")


class Healing(StatefulProcessor):
    """Book() of a security as one value, its watermarks by kind as a map, and the messages that it holds as a list."""

    def __init__(self, policy: dict[str, str], timeout: int):
        self.policy, self.timeout = policy, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.book = handle.getValueState("book", "state string, seen long, book long, top long, least long, since long")
        self.marks = handle.getMapState("marks", "op string", "number long")
        self.held = handle.getListState("held", "seq long, op string, rpt_seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        book = Book()
        if self.book.exists():
            state, *numbers = self.book.get()
            book = Book(state, *(whole(x) for x in numbers), {op: int(n) for (op,), (n,) in self.marks.iterator()})
        marks, held, kept, out = dict(book.marks), [], True, []
        batch = in_order(rows, "seq")
        for seq, op, number, time in zip(batch.seq.tolist(), batch.op.tolist(), batch.rpt_seq.tolist(), batch.ts_us.tolist()):
            number = whole(number)
            outcome, low, high = book.step(op, number, whole(time), self.policy, self.timeout)
            out.append((seq, key[0], op, number, outcome, book.state, low, high, *book.lacks, None))
            if outcome == "held":
                held.append((int(seq), op, number))
            elif outcome in CLEARING:
                if low is not None:
                    earlier = [(int(s), o, int(n)) for s, o, n in self.held.get()] if kept and self.held.exists() else []
                    first = {}
                    for s, o, n in [*earlier, *held]:
                        if low <= n <= high:
                            first.setdefault(n, (s, o, n))
                    out += [(s, key[0], o, n, "replayed", "healthy", None, None, None, None, seq) for s, o, n in first.values()]
                held, kept = [], False
        if not kept:
            self.held.clear()
        if held:
            self.held.appendList(held)
        if not book.marks:
            self.marks.clear()
        for op, number in book.marks.items():
            if marks.get(op) != number:
                self.marks.updateValue((op,), (number,))
        self.book.update(book.kept()[:6])
        yield frame(out, HEALED)

    def close(self) -> None:
        pass


def healed_stream(rows: DataFrame, policy: dict[str, str] = POLICY, timeout: int = 0) -> DataFrame:
    """recovery.detailed() of a stream of operations (seq, security_id, op, rpt_seq, ts_us), and with each heal the held messages that it replays, as rows with outcome replayed and healed_by."""
    rows = rows.select(F.col("seq").cast("long"), F.col("security_id").cast("long"), "op", F.col("rpt_seq").cast("long"), F.col("ts_us").cast("long"))
    return rows.groupBy("security_id").transformWithStateInPandas(Healing(policy, timeout), T.StructType.fromDDL(HEALED), "Append", "None")
