"""Streams with state against the batch forms, over micro-batches and restarts from the checkpoint."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tickloom.operators import recovery, sequence
from tickloom.streaming import read_messages, stateful

@pytest.fixture
def store(spark):
    old = spark.conf.get(stateful.STORE[0])
    spark.conf.set(*stateful.STORE)
    yield
    spark.conf.set(stateful.STORE[0], old)


def streamed(spark, frames, make, folder):
    """Rows of the stream over frames, each a run of its own from the same checkpoint; in a run each file is a micro-batch."""
    for parts in frames:
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
            time.sleep(0.02)
        source = read_messages(spark, f"{folder}/in", parts[0].schema, 1)
        query = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    out = spark.read.parquet(f"{folder}/out").collect()
    return sorted((tuple(r) for r in out), key=repr)


OPS = ["book"] * 8 + ["statistic", "statistic", "trade", "snapshot", "snapshot", "empty_snapshot", "mark_stale", "reset"]


def operations(seed, n=600):
    r, number, rows = random.Random(seed), {}, []
    for seq in range(n):
        security, op = seq % 5, r.choice(OPS)
        at = number.get(security, 0)
        if op == "reset":
            number[security] = at = 0
        if op in ("book", "statistic", "trade"):
            number[security] = at = at + r.choice([1, 1, 1, 1, 1, 1, 2, 3])
            at -= r.choice([0, 0, 0, 0, 1, 2])
        at = max(1, at - r.choice([0, 0, 1, 3, 12])) if op == "snapshot" else at
        rows.append((seq, security, op, None if op in ("empty_snapshot", "mark_stale", "reset") else max(1, at), seq * 100))
    return rows


def test_healing_over_restarts(spark, store, tmp_path):
    rows = operations(3)
    frame = spark.createDataFrame(rows, "seq long, security_id long, op string, rpt_seq long, ts_us long")
    found = recovery.detailed(frame, timeout=1500).cache()
    want = found.withColumn("healed_by", F.lit(None).cast("long"))
    more = recovery.replayed(found).select("seq", "security_id", "op", "rpt_seq", F.lit("replayed").alias("outcome"), F.lit("healthy").alias("state"), *(F.lit(None).cast("long").alias(c) for c in ("drain_from", "drain_to", "unsafe", "tail")), "healed_by")
    want = sorted((tuple(r) for r in want.unionByName(more).collect()), key=repr)
    cuts = [0, 90, 200, 320, 450, 600]
    parts = [frame.where(f"seq >= {a} and seq < {b}") for a, b in zip(cuts, cuts[1:])]
    got = streamed(spark, [parts[:2], parts[2:3], parts[3:]], lambda s: stateful.healed_stream(s, timeout=1500), str(tmp_path))
    assert got == want
    outcomes = {r[4] for r in want}
    assert outcomes == {"applied", "dropped", "held", "healed", "forced", "emptied", "marked", "reset", "rejected", "skipped", "replayed"}


def packets(seed, n=240):
    r, rows, number = random.Random(seed), [], {"a": 0, "b": 0}
    for k in range(n):
        channel = "a" if r.random() < 0.5 else "b"
        number[channel] += r.choice([1, 1, 1, 1, 1, 3])
        rows.append((channel, k, max(1, number[channel] - r.choice([0, 0, 0, 1, 2])), k * 300 + r.randrange(200)))
    return rows


def test_order_over_restarts(spark, store, tmp_path):
    """The last packets of channel a wait; only those of b, and so the watermark, go on."""
    rows = packets(5) + [("a", 1000, 900, 80_000), ("a", 1001, 902, 80_010)] + [("b", 1002 + k, 800 + k, 80_500 + 1000 * k) for k in range(6)]
    frame = spark.createDataFrame(rows, "channel string, arrival long, seq long, time long")
    until = 85_500
    want = sorted((tuple(r) for r in sequence.reordered(frame, 8, 2000, True, until).where("reason <> 'waiting'").collect()), key=repr)
    timed = frame.withColumn("ts", F.timestamp_millis("time")).drop("time")
    cuts = [0, 60, 130, 200, 1002, 1005, 1007, 1008]
    parts = [timed.where(f"arrival >= {a} and arrival < {b}") for a, b in zip(cuts, cuts[1:])]
    got = streamed(spark, [parts[:2], parts[2:4], parts[4:6], parts[6:]], lambda s: stateful.reordered_stream(s, 8, 2000), str(tmp_path))
    assert got == want
    assert {r[4] for r in want} == {"in", "gap", "released", "duplicate"} | ({"passed"} & {r[4] for r in want})


@pytest.mark.parametrize(
    ("timers", "until", "want"),
    [
        (False, None, [(1, "in"), (8, "gap"), (9, "in")]),
        (True, None, [(1, "in"), (3, "gap"), (4, "released"), (7, "released"), (8, "in"), (9, "in")]),
    ],
)
def test_timer_lets_what_waits_go(spark, timers, until, want):
    rows = [(1, 0), (3, 10), (7, 20), (4, 30), (8, 5000), (9, 5001)]
    frame = spark.createDataFrame([("a", k, n, t) for k, (n, t) in enumerate(rows)], "channel string, arrival long, seq long, time long")
    got = [(r.seq, r.reason) for r in sequence.reordered(frame, 16, 2000, timers, until).where("position is not null").orderBy("position").collect()]
    assert got == want


def test_timer_without_a_next_packet(spark):
    frame = spark.createDataFrame([("a", 0, 1, 0), ("a", 1, 3, 10)], "channel string, arrival long, seq long, time long")
    last = lambda until: [r.reason for r in sequence.reordered(frame, 16, 2000, True, until).where("seq = 3").collect()]
    assert [last(u) for u in (None, 2000, 2001)] == [["waiting"], ["waiting"], ["gap"]]
