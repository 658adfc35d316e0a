"""Hand-worked cases of feeds, recovery, instruments and delivery."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tickloom import functions as fx
from tickloom.operators import book, conflation, instruments, recovery, sequence, trades
from tickloom.sources import feeds, write_csv


def steps(ops, **more):
    state = recovery.Book()
    return [state.step(*o, **more)[0] for o in ops], state


def test_no_heal_over_a_hole():
    """A first message far on shows that those before it are missing."""
    got, state = steps([("book", 10), ("snapshot", 5), ("snapshot", 8), ("snapshot", 9)])
    assert got == ["held", "rejected", "rejected", "healed"] and (state.book, state.seen, state.state) == (10, 10, "healthy")
    got, state = steps([("snapshot", 3), ("book", 4), ("statistic", 6), ("book", 7), ("snapshot", 4), ("snapshot", 5)])
    assert got == ["healed", "applied", "applied", "held", "rejected", "healed"]


def test_empty_snapshot_marks_and_policy():
    got, state = steps([("book", 4), ("empty_snapshot", None), ("book", 5), ("mark_stale", None), ("snapshot", 4), ("snapshot", 5), ("book", 6)])
    assert got == ["held", "emptied", "applied", "marked", "rejected", "healed", "applied"] and state.book == 6
    assert steps([("book", 2), ("news", 3), ("statistic", 4)], policy={"book": "drop", "news": "apply", "statistic": "hold"})[0] == ["dropped", "applied", "held"]


def test_old_snapshot_after_the_timeout():
    ops = [("snapshot", 1, 0), ("book", 5, 100), ("snapshot", 3, 150), ("snapshot", 3, 301), ("book", 6, 302)]
    assert steps(ops, timeout=200)[0] == ["healed", "held", "rejected", "forced", "applied"]
    assert steps(ops)[0] == ["healed", "held", "rejected", "rejected", "held"]


def test_watermark_of_each_kind_and_what_a_forced_heal_lacks():
    """A statistic numbered below a book message that came first is new; the first snapshot that is taken late gives up what is held."""
    got, _ = steps([("snapshot", 3), ("book", 5), ("book", 4), ("statistic", 4), ("statistic", 4), ("trade", 4), ("trade", 3), ("trade", 6)])
    assert got == ["healed", "held", "held", "applied", "dropped", "applied", "dropped", "applied"]
    state = recovery.Book()
    for op in [("snapshot", 3, 0), ("book", 5, 100), ("book", 6, 110), ("book", 9, 120)]:
        state.step(*op, timeout=200)
    assert state.step("snapshot", 4, 301, timeout=200) == ("forced", None, None) and state.lacks == (8 - 4, 9 - 4) and state.book == 4
    assert [state.step("book", n, 302)[0] for n in (10, 10)] == ["applied", "dropped"] and state.lacks == (None, None)
    assert steps([("book", 9, 0), ("snapshot", 4, 900)], timeout=200)[0] == ["held", "rejected"]  # never healed, so never stale


def packets(spark, rows):
    return spark.createDataFrame([("a", i, n, t) for i, (n, t) in enumerate(rows)], "channel string, arrival long, seq long, time long")


@pytest.mark.parametrize(
    ("numbers", "want", "reasons"),
    [
        ([(1, 0), (3, 0), (2, 0), (3, 0), (4, 0)], [1, 2, 3, 4], {"duplicate": 1, "released": 1}),
        ([(1, 0), (3, 0), (4, 0), (7, 0), (8, 0)], [1, 7, 8], {"gap": 1, "passed": 2}),  # five ahead of two: the gap is accepted, and what waits below is dropped
        ([(1, 0), (4, 10), (3, 2000), (5, 2001)], [1, 3, 4, 5], {"gap": 1, "released": 1}),  # two was missed for too long
        ([(900, 0), (901, 0)], [900, 901], {}),  # the first packet seeds the numbering
        ([(1, 0), (3, 0)], [1], {"waiting": 1}),
    ],
)
def test_reorder(spark, numbers, want, reasons):
    rows = sequence.reordered(packets(spark, numbers), 4, 2000).collect()
    assert [r.seq for r in sorted((r for r in rows if r.position), key=lambda r: r.position)] == want
    assert len(rows) == len(numbers)
    counts = {}
    for r in rows:
        if r.reason != "in":
            counts[r.reason] = counts.get(r.reason, 0) + 1
    assert counts == reasons


def test_reorder_of_many(spark):
    """Late by less than the window and without loss, all go out in order; whatever comes, each packet has one row."""
    r = random.Random(2)
    late = sorted(range(1, 1001), key=lambda n: n + r.random() * 20)
    rows = spark.createDataFrame([(c, i, n, i) for c in "ab" for i, n in enumerate(late)] + [("c", i, r.randrange(1, 400), i * 3) for i in range(600)] + [(None, 0, 1, 0)], "channel string, arrival long, seq long, time long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sequence.reordered(rows, 64, 500).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 2601
    for c in "ab":
        assert [x.seq for x in sorted((x for x in got if x.channel == c), key=lambda x: x.position)] == list(range(1, 1001))
    out = [x.seq for x in sorted((x for x in got if x.channel == "c" and x.position), key=lambda x: x.position)]
    assert out == sorted(set(out)) and {x.reason for x in got if not x.position} <= {"duplicate", "passed", "waiting"}


def test_missing_numbers_of_gaps_only(spark):
    rows = spark.createDataFrame([(1, n) for n in (2, 3, 7, 7, 12)] + [(2, 5)], "k long, n long")
    bounds = spark.createDataFrame([(1, 1, 9), (2, 4, 5), (3, 0, 2), (4, 5, 5)], "k long, low long, high long")
    assert sorted(map(tuple, sequence.missing_numbers(rows, bounds, "k", "n").collect())) == [(1, 4), (1, 5), (1, 6), (1, 8), (1, 9), (3, 1), (3, 2)]


def test_rebuild_from_a_snapshot(spark):
    shape = "seq long, security_id long, side string, order_id long, action string, price long, qty long, rpt_seq long"
    events = [(1, 1, "bid", 1, "new", 100, 5, 1), (3, 1, "bid", 3, "new", 98, 5, 3), (4, 1, "bid", 1, "delete", None, None, 4), (9, 2, "ask", 1, "new", 7, 7, 3)]
    snapshots = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 1)], "security_id long, snapshot long, rpt_seq long")
    orders = spark.createDataFrame([(1, 2, "bid", 1, 100, 5), (1, 2, "bid", 2, 99, 5), (1, 1, "bid", 9, 1, 1), (2, 1, "ask", 5, 5, 5)], "security_id long, snapshot long, side string, order_id long, price long, qty long")
    books, stale = recovery.rebuild(snapshots, orders, spark.createDataFrame(events, shape))
    assert sorted(r.order_id for r in books.collect()) == [2]  # 3 is before the snapshot, 1 was deleted after it
    assert [tuple(r) for r in stale.collect()] == [(2, 2, 1)]


def test_replica(spark):
    rows = [(1, 1, "bid", 1, "new", 100, 5), (2, 1, "bid", 1, "new", 101, 6), (3, 1, "ask", 2, "new", 105, 5), (4, 1, "ask", 2, "change", 105, 0), (5, 2, "ask", 3, "new", 9, 9), (6, 2, None, None, "snapshot", None, None), (7, 2, "ask", 4, "new", 8, 8)]
    found = book.replica(spark.createDataFrame(rows, "seq long, security_id long, side string, order_id long, action string, price long, qty long"))
    assert sorted((r.security_id, r.order_id, r.price) for r in found.collect()) == [(1, 1, 101), (2, 4, 8)]


def test_detach_and_rejoin(spark):
    own = spark.createDataFrame([(5, 1, 17, 101), (5, 2, 17, 101), (20, 2, 0, 102), (30, 3, 4, 0)], "seq long, security_id long, status int, event int")
    phases = spark.createDataFrame([(1, "g", 2), (10, "g", 21)], "seq long, security_group string, status int")
    members = spark.createDataFrame([(k, "g") for k in (1, 2, 3, 4)] + [(5, "none")], "security_id long, security_group string")
    got = {r.security_id: (r.status, r.detached) for r in instruments.effective_status(own, phases, members).collect()}
    assert got == {1: (17, True), 2: (21, False), 3: (4, False), 4: (21, False), 5: (None, False)}


def test_groups_lookup_and_versions(spark):
    rows = spark.createDataFrame([(1, [(0, "x"), (3, "y")]), (2, [])], "id long, legs array<struct<number:int,name:string>>")
    assert sorted(map(tuple, instruments.members_of(rows, "id", "legs", "number").collect())) == [(1, 3, "y"), (2, None, None)]
    assert instruments.lookup(spark.createDataFrame([("ABCD4",)], "symbol string"), "symbol", " abcd4 ").count() == 1
    moves = spark.createDataFrame([(1, 1, None, 1), (2, 1, None, 1), (3, 1, 5, 1), (4, 1, 5, 2)], "seq long, k long, a int, b int")
    got = instruments.versions(moves, "k", {"one": ["a"], "two": ["b"]}, "seq").orderBy("seq").collect()
    assert [(r.one, r.two, r.any_version) for r in got] == [(1, 1, 1), (1, 1, 1), (2, 1, 2), (2, 2, 3)]


def test_windows_open_at_the_first_event(spark):
    rows = spark.createDataFrame([(i, 1, t) for i, t in enumerate([5, 9, 14, 15, 40])] + [(9, 2, 7)], "seq long, k long, ms long")
    got = conflation.anchored_windows(rows, "k", "ms", 10).orderBy("k", "seq").collect()
    assert [r.opened for r in got] == [5, 5, 5, 15, 40, 7]
    assert [r.opened for r in conflation.anchored_windows(rows.where("k = 1"), "k", "ms", 0).orderBy("seq").collect()] == [5, 9, 14, 15, 40]


def test_fragments_join_again(spark):
    r = random.Random(1)
    texts = [(k, "".join(r.choice("aé\U0001f600 \n") for _ in range(r.randrange(0, 90)))) for k in range(1, 30)]
    parts = conflation.fragments(spark.createDataFrame(texts, "news_id long, text string"), 7)
    back = instruments.reassemble_news(parts.withColumn("seq", -F.col("part_number")))
    assert {r.news_id: r.text for r in back.collect()} == dict(texts)


def test_tag_value(spark):
    rows = spark.createDataFrame([("ABCD4", 7, None), ("é=1", None, "x")], "symbol string, id int, text string")
    found = rows.select(fx.tag_value("W", {55: F.col("symbol"), 48: F.col("id"), 58: F.col("text")}).alias("m")).select("m", fx.intact(F.col("m")).alias("ok"), fx.tag_values(F.col("m")).alias("f")).collect()
    for row, fields in zip(found, [[(55, "ABCD4"), (48, "7")], [(55, "é=1"), (58, "x")]]):
        body = "".join(f"{k}={v}\x01" for k, v in [(35, "W"), *fields])
        head = f"8=FIX.4.4\x019={len(body.encode())}\x01{body}"
        assert row.m == f"{head}10={sum(head.encode()) % 256:03d}\x01" and row.ok
        assert [(x.tag, x.value) for x in row.f][3:-1] == fields
    bad = spark.createDataFrame([(found[0].m.replace("ABCD4", "ABCD3"),), ("x",), (None,)], "m string")
    assert [r.ok for r in bad.select(fx.intact(F.col("m")).alias("ok")).collect()] == [False] * 3


def test_text_functions(spark):
    row = spark.range(1).select(fx.csv_field(F.lit('a"b')).alias("q"), fx.csv_field(F.lit(None)).alias("n"), fx.csv_field(F.lit("a b")).alias("p"), fx.utc_stamp(F.lit(-1)).alias("t"), fx.decoded(F.lit(b"AB \x00"), F.lit(4)).alias("d"), fx.decoded(F.lit(b"AB"), F.lit(4)).alias("short")).first()
    assert (row.q, row.n, row.p, row.t, row.d, row.short) == ('"a""b"', "", "a b", "19691231-23:59:59.999", "AB", None)


def test_last_price_and_wide_bar(spark):
    bars = spark.createDataFrame([(1, 0, 10, 12, 9, 11, 4, 10), (1, 1, 11, 15, 11, 14, 2, 13), (2, 0, 5, 5, 5, 5, 0, 5)], "security_id long, time long, open long, high long, low long, close long, volume long, avg long")
    wide = {r.security_id: tuple(r) for r in trades.last_wide_bar(bars, 5).collect()}
    assert wide == {1: (1, 0, 10, 15, 9, 14, 6, 11), 2: (2, 0, 5, 5, 5, 5, 0, 5)}
    deals = spark.createDataFrame([(3, 1, 77, 8)], "seq long, security_id long, price long, qty long")
    assert {tuple(r) for r in trades.last_price(deals, bars).collect()} == {(1, 77, 8, 3), (2, 5, 0, None)}


def test_configuration_and_csv(spark, tmp_path):
    config = {"channels": [{"id": "84", "groups": [{"name": "main", "feeds": [{"role": "A", "address": "224.0.0.1", "port": 30001}, {"role": "B", "address": "224.0.0.2"}]}]}, {"id": "85"}]}
    (tmp_path / "c.json").write_text(json.dumps(config, indent=1))
    found = feeds(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in found.collect()} == {("84", "main", "A", "224.0.0.1", 30001), ("84", "main", "B", "224.0.0.2", None), ("85", None, None, None, None)}
    write_csv(found, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
