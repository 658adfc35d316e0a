"""Hand-worked cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tickloom import functions as fx
from tickloom.operators import analytics, book, conflation, instruments, recovery, sequence, trades
from tickloom.plans import QUERIES
from tickloom.sources import order_events
from tickloom.streaming import bars, cadence, first_copies, read_messages


def prints(spark, rows):
    return spark.createDataFrame([(i, 1, p, q, s, i) for i, (p, q, s) in enumerate(rows)], "seq long, security_id long, price long, qty long, second long, trade_id long")


@pytest.mark.parametrize(
    ("rows", "times"),
    [
        ([(500, 1, 10), (600, 1, 13)], [10, 11, 12, 13]),
        ([(1000, 10, 100), (1100, 5, 162)], [*range(100, 161), 162]),
        ([(1000, 1, 0), (1100, 1, 100)], [*range(0, 61), 100]),
        ([(10, 1, 5), (20, 1, 7), (99, 1, 6)], [5, 6, 7]),
    ],
)
def test_candle_times(spark, rows, times):
    found = trades.fill_gaps(trades.candles(prints(spark, rows))).orderBy("time").collect()
    assert [r.time for r in found] == times
    assert found[-1].open == rows[0][0]


def test_candle_continuity(spark):
    last = trades.candles(prints(spark, [(100, 1, 1), (90, 1, 2)])).orderBy("time").collect()[1]
    assert (last.open, last.high, last.low, last.close) == (100, 100, 90, 90)


def test_bust(spark):
    rows = prints(spark, [(100, 10, 1), (105, 4, 1), (99, 6, 1)])
    busts = spark.createDataFrame([(9, 1, 2), (0, 1, 1), (9, 1, 77)], "seq long, security_id long, trade_id long")
    left = trades.without_busted(rows, busts)
    bar = trades.candles(left).collect()[0]
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (100, 105, 100, 105, 14)
    assert trades.last_trade(left).collect()[0].price == 105


def events(spark, rows):
    return spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], "seq long, security_id long, side string, order_id long, action string, price long, qty long")


@pytest.mark.parametrize(
    ("gone", "want"),
    [
        # (time, open, high, low, close, volume, busted)
        ([1], [(1, 100, 100, 100, 100, 1, 0), (2, 100, 100, 90, 90, 2, 1), (3, 90, 130, 90, 130, 1, 0), (5, 130, 130, 110, 110, 1, 0)]),  # a sibling is left
        ([3], [(1, 100, 100, 100, 100, 1, 0), (2, 100, 120, 90, 90, 3, 0), (3, 90, 90, 90, 90, 0, 1), (5, 90, 110, 90, 110, 1, 0)]),  # an inner one stays, flat
        ([1, 2, 3], [(1, 100, 100, 100, 100, 1, 0), (2, 100, 100, 100, 100, 0, 2), (3, 100, 100, 100, 100, 0, 1), (5, 100, 110, 100, 110, 1, 0)]),
        ([4], [(1, 100, 100, 100, 100, 1, 0), (2, 100, 120, 90, 90, 3, 0), (3, 90, 130, 90, 130, 1, 0)]),  # the last goes
        ([0], [(1, 100, 100, 100, 100, 0, 1), (2, 100, 120, 90, 90, 3, 0), (3, 90, 130, 90, 130, 1, 0), (5, 130, 130, 110, 110, 1, 0)]),  # nothing before it: its old close
        ([0, 1, 2], [(1, 100, 100, 100, 100, 0, 1), (2, 100, 100, 100, 100, 0, 2), (3, 100, 130, 100, 130, 1, 0), (5, 130, 130, 110, 110, 1, 0)]),
        ([3, 4], [(1, 100, 100, 100, 100, 1, 0), (2, 100, 120, 90, 90, 3, 0), (3, 90, 90, 90, 90, 0, 1)]),
    ],
)
def test_candles_after_busts(spark, gone, want):
    rows = prints(spark, [(100, 1, 1), (120, 1, 2), (90, 2, 2), (130, 1, 3), (110, 1, 5)])
    busts = spark.createDataFrame([(50 + k, 1, k) for k in gone] + [(0, 1, 4)], "seq long, security_id long, trade_id long")  # one that comes before its trade
    found = trades.rebuilt(rows, busts).orderBy("time").collect()
    assert [(r.time, r.open, r.high, r.low, r.close, r.volume, r.busted) for r in found] == want


def test_no_busted_bucket_is_lost(spark):
    folder = "/root/testdata/sf0.01"
    from tickloom.plans.market import busts
    from tickloom.sources import trades as table_of_prints

    rows, bad = table_of_prints(spark, folder), busts(spark, folder)
    clean = trades.without_busted(rows, bad).select("seq")
    gone = rows.join(clean, "seq", "left_anti").select("security_id", fx.floor_bucket(F.col("second"), 3600).alias("time"))
    last = rows.groupBy("security_id").agg(F.max(fx.floor_bucket(F.col("second"), 3600)).alias("last"))
    buckets = {(r.security_id, r.time): r.time == r.last for r in gone.join(last, "security_id").collect()}
    found = {(r.security_id, r.time) for r in QUERIES["candle_bust_rebuild"](spark, folder).where("busted > 0").collect()}
    assert len(buckets) == 62 and found <= set(buckets) and all(buckets[b] for b in set(buckets) - found)


def test_book(spark):
    live = book.live_orders(events(spark, [("bid", 1, "new", 100, 10), ("bid", 2, "new", 100, 20), ("bid", 3, "new", 99, 5), ("ask", 4, "new", None, 50), ("ask", 4, "change", 103, 50), ("bid", 3, "change", 98, 5)]))
    assert {(r.side, r.price, r.total_qty, r.order_count) for r in book.price_levels(live).collect()} == {("bid", 100, 30, 2), ("bid", 98, 5, 1), ("ask", 103, 50, 1)}
    assert book.market_tier(live).count() == 0
    assert tuple(book.top_of_book(book.price_levels(live)).collect()[0])[1:] == (100, 30, 2, 103, 50, 1)


def test_mass_delete_one_side(spark):
    live = book.live_orders(events(spark, [("bid", 1, "new", 100, 1), ("bid", 2, "new", None, 1), ("ask", 3, "new", 101, 1), ("bid", 0, "mass_delete", None, None), ("bid", 5, "new", 90, 1)]))
    assert {r.order_id for r in live.collect()} == {3, 5}


def test_crossing(spark):
    found = book.crossing_series(events(spark, [("bid", 1, "new", 100, 1), ("ask", 2, "new", 100, 1), ("ask", 3, "new", 99, 1), ("ask", 3, "delete", None, None), ("bid", 1, "delete", None, None)])).orderBy("seq").collect()
    assert [r.state for r in found] == ["locked", "crossed", "locked", "normal"]


def test_gaps(spark):
    rows = spark.createDataFrame([(i, 1, n) for i, n in enumerate([1, 2, 2, 5, 6])], "seq long, k long, n long")
    assert [r.result for r in sequence.classify_gaps(rows, "k", "n").orderBy("seq").collect()] == ["in", "in", "dup", "gap", "in"]


@pytest.mark.parametrize(
    ("ops", "want"),
    [
        ([("book", 10), ("book", 11), ("snapshot", 10)], [("held", None), ("held", None), ("healed", (11, 11))]),
        ([("snapshot", 5), ("book", 8), ("snapshot", 6), ("snapshot", 7)], [("healed", None), ("held", None), ("rejected", None), ("healed", (8, 8))]),
        ([("snapshot", 0), ("book", 1), ("statistic", 3)], [("healed", None), ("applied", None), ("applied", None)]),
        ([("snapshot", 0), ("book", 1), ("statistic", 2), ("book", 3)], [("healed", None), ("applied", None), ("applied", None), ("applied", None)]),
    ],
)
def test_heal(ops, want):
    state = recovery.Book()
    got = [state.step(*o) for o in ops]
    assert [(o, (a, b) if a else None) for o, a, b in got] == want
    if ops[-1] == ("statistic", 3):
        assert state.state == "stale"


def test_heal_never_goes_back():
    r = random.Random(3)
    for _ in range(300):
        state, high = recovery.Book(), 0
        for _ in range(60):
            op, n = r.choice(["book", "book", "statistic", "snapshot"]), r.randrange(1, 40)
            before = state.book
            outcome, low, top = state.step(op, n)
            high = max(high, n if op != "snapshot" or outcome == "healed" else 0)
            assert state.seen == high and (outcome != "applied" or op != "book" or state.book == n > before)
            assert outcome != "healed" or state.state == "healthy"


def test_replay_in_batch_and_stream(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, i % 7, r.choice(["book", "book", "book", "statistic", "snapshot"]), i // 7 + r.choice([0, 0, 0, 1, 2])) for i in range(700)]
    frame = spark.createDataFrame(rows, "seq long, security_id long, op string, rpt_seq long")
    want = {tuple(x) for x in recovery.replay(frame).collect()}
    for k in range(4):
        frame.where(f"seq >= {175 * k} and seq < {175 * k + 175}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import time

    time.sleep(0.1)
    source = read_messages(spark, str(tmp_path / "in"), frame.schema)
    query = recovery.replay_stream(source).writeStream.format("memory").queryName("heals").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(x) for x in spark.table("heals").collect()} == want


def test_stream_windows(spark, tmp_path):
    rows = [(i, 1 + i % 2, 1000 + i, i // 3, 100 + i % 5, 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "seq long, security_id long, packet_seq long, s long, price long, qty long").select("*", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), F.lit("A").alias("channel"), F.lit("bid").alias("side"), F.lit("new").alias("action"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: first_copies(read_messages(spark, str(tmp_path / "in"), frame.schema))
    for name, df in (("one", source()), ("two", bars(read_messages(spark, str(tmp_path / "in"), frame.schema))), ("three", cadence(read_messages(spark, str(tmp_path / "in"), frame.schema)))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("one").count() == 60
    assert spark.table("two").where("volume = 4 or volume = 8").count() > 0
    assert spark.table("three").count() > 0


@pytest.mark.parametrize(("kinds", "want"), [("ADUD", None), ("AUD", None), ("DAD", "Delete"), ("DA", "Update"), ("AU", "Add"), ("U", "Update"), ("D", "Delete"), ("AD", None)])
def test_order_conflation(spark, kinds, want):
    name = {"A": "Add", "U": "Update", "D": "Delete"}
    rows = spark.createDataFrame([(i, 1, name[k], 100 + i, i) for i, k in enumerate(kinds)], "seq long, o long, kind string, price long, qty long")
    assert [r.kind for r in conflation.orders(rows, ["o"]).collect()] == ([want] if want else [])


def test_trade_coalescing(spark):
    rows = spark.createDataFrame([(1, 100, 5, 0, 1), (2, 100, 7, 1, 2)], "seq long, price long, qty long, flags int, trade_id long")
    assert tuple(conflation.trades(rows, ["price"]).collect()[0]) == (100, 12, 2, 1)


def test_news(spark):
    rows = [(1, 7, 3, 3, "CC"), (2, 7, 1, 3, "AA"), (3, 7, 2, 3, "BB"), (4, 0, 1, 2, "x"), (5, 0, 2, 2, "y"), (6, 9, 1, 2, "z"), (7, 0, 1, 1, "one"), (8, 7, 1, 3, "again")]
    found = instruments.reassemble_news(spark.createDataFrame(rows, "seq long, news_id long, part_number long, part_count long, text string"))
    assert {(r.news_id, r.text) for r in found.collect()} == {(7, "AABBCC"), (0, "one")}


@pytest.mark.parametrize(("kind", "low", "high", "want"), [(2, -10000, 10000, (495000, 505000)), (1, -50000, 50000, (499500, 500500)), (0, -10000, 10000, (-10000, 10000))])
def test_bands(spark, kind, low, high, want):
    row = spark.range(1).select(*(fx.effective_band(F.lit(kind), F.lit(x).cast("long"), F.lit(50 * 10**8), F.lit(10**6)).alias(n) for x, n in ((low, "low"), (high, "high")))).collect()[0]
    assert (row.low, row.high) == want


def test_median_of_clients(spark):
    clients = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 10)], "client_id long, pending_bytes long")
    found = analytics.slow_clients(clients, 10, 0.5, 2, 3).collect()
    assert [(r.client_id, r.median) for r in found] == [(4, 2)]


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 3, 3, 3], [-(2**63), 2**63 - 1, 0], [-7, -7, 4, None], [], [None], "many", "wide"])
def test_exact_median_by_histograms(spark, values):
    r = random.Random(8)
    if values in ("many", "wide"):
        values = [r.randrange(-10 if values == "many" else -(2**62), 5000 if values == "many" else 2**62) for _ in range(999)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    known = sorted(v for v in values if v is not None)
    want = (known[(len(known) - 1) // 2] + known[len(known) // 2]) // 2 if known else None
    assert analytics.whole_median(rows, "v") == want
    assert analytics.nth(rows, "v", len(known)) is None
    if known:
        assert [analytics.nth(rows, "v", k) for k in (0, len(known) - 1)] == [known[0], known[-1]]


def test_phases_are_looked_up(spark):
    phases = spark.createDataFrame([(1, "g", 2), (5, "g", 2), (7, "g", 3), (4, "h", 1)], "seq long, security_group string, status int")
    assert sorted(map(tuple, instruments.phase_intervals(phases).collect())) == [("g", 2, 1, 7), ("g", 3, 7, None), ("h", 1, 4, None)]
    members = spark.createDataFrame([(10, "g"), (11, "g"), (20, "h")], "security_id long, security_group string")
    rows = spark.createDataFrame([(0, 10), (6, 10), (7, 11), (9, 20), (9, 99)], "seq long, security_id long")
    assert sorted((r.seq, r.security_id, r.status) for r in instruments.phase_at(rows, members, phases).collect()) == [(0, 10, None), (6, 10, 2), (7, 11, 3), (9, 20, 1)]


def test_small_functions(spark):
    row = spark.range(1).select(fx.maturity_date(F.lit(20240131)).alias("d"), fx.maturity_date(F.lit(20249999)).alias("bad"), fx.trimmed(F.lit("AB \x00 ")).alias("t"), fx.tag_value_checksum(F.lit("8=FIX.4.4")).alias("c"), fx.floor_bucket(F.lit(-1), 5).alias("b")).collect()[0]
    assert (str(row.d), row.bad, row.t, row.c, row.b) == ("2024-01-31", None, "AB", f"{sum(b'8=FIX.4.4') % 256:03d}", -5)


FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_phases_of_all_members(spark):
    parts = sorted((r.p_partkey, r.p_brand, r.p_size % 4) for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect())
    changes, last = {}, {}
    for key, brand, status in parts:
        if last.get(brand) != status:
            changes.setdefault(brand, []).append((key, status))
        last[brand] = status
    want = sorted((seq, status, key) for key, brand, _ in parts for seq, status in changes[brand])
    got = QUERIES["group_phase"](spark, FOLDER).select("seq", "status", "security_id").collect()
    assert sorted(tuple(r) for r in got) == want
    assert len({r.security_id for r in got}) == len(parts)


def test_a_large_group_is_many_tasks(spark):
    r = random.Random(12)
    phases = [(k, r.choice(["g", "g", "g", "h", None]), r.randrange(3)) for k in range(400)]
    members = [(k, r.choice(["g", "g", "g", "h", "i", None]), k % 7) for k in range(200)]
    found = instruments.group_phases(spark.createDataFrame(phases, "seq long, security_group string, status int"), spark.createDataFrame(members, "security_id long, security_group string, board int"), block=16, lot=16)
    assert found.columns == ["security_group", "seq", "status", "security_id", "board"]
    want, last = [], {}
    for seq, group, status in phases:
        if group and last.get(group) != status:
            want += [(group, seq, status, k, board) for k, own, board in members if own == group]
        last[group] = status
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
    busy = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(busy) < len(want) / 4


def test_routing_to_all_clients(spark):
    events = [(r.event_id, r.user_id) for r in spark.read.parquet(f"{FOLDER}/events.parquet").collect()]
    clients = [r.c_custkey for r in spark.read.parquet(f"{FOLDER}/customer.parquet").collect()]
    count, want = max(u for _, u in events) + 1, {}
    for c in clients:
        seen = [seq for seq, user in events if user == c * 7 % count and c % 16 & 1 << seq % 4]
        if seen:
            want[c] = (len(seen), min(seen))
    got = {r.client_id: (r.events, r.first_seq) for r in QUERIES["subscription_routing"](spark, FOLDER).collect()}
    assert got == want


def test_route_counts_like_route(spark):
    r = random.Random(8)
    rows = spark.createDataFrame([(i, r.randrange(5), 1 << r.randrange(4)) for i in range(200)], "seq long, security_id long, channel_bit int")
    subscriptions = spark.createDataFrame([(300 + k % 30, r.randrange(7), r.randrange(16)) for k in range(60)], "client_id long, security_id long, flags int")
    want = conflation.route(rows, subscriptions).groupBy("client_id").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"))
    assert sorted(map(tuple, conflation.route_counts(rows, subscriptions).collect())) == sorted(map(tuple, want.collect()))


def test_levels_of_all_events(spark):
    rows = [(0, 1, "bid", 2, "new", 100, 5), (1, 1, "bid", 4, "new", 101, 7), (2, 1, "bid", 4, "delete", 101, None), (3, 1, "ask", 1, "trade", 103, 1), (13, 1, "ask", 1, "new", None, 1)]
    found = events_at(spark, rows)
    got = conflation.changed_levels(found, book.price_levels(book.live_orders(found))).collect()
    assert {tuple(r) for r in got} == {(1, "bid", 100, 5, False), (1, "bid", 101, 0, True)}
    whole = {tuple(r) for r in QUERIES["level_conflation"](spark, FOLDER).collect()}
    touched = order_events(spark, FOLDER).where("action in ('new', 'change', 'delete') and price is not null").select("security_id", "side", "price").distinct()
    assert {r[:3] for r in whole} == {tuple(r) for r in touched.collect()}
    assert len(whole) == touched.count()


def events_at(spark, rows):
    return spark.createDataFrame(rows, "seq long, security_id long, side string, order_id long, action string, price long, qty long")


def brute_crossing(rows):
    live, state, out = {}, {}, []
    for seq, security, side, order, action, price, _ in sorted(rows):
        own = live.setdefault(security, {})
        if action == "mass_delete":
            for key in [k for k in own if side is None or k[0] == side]:
                del own[key]
        elif action != "trade":
            own.pop((side, order), None)
            if action != "delete" and price is not None:
                own[side, order] = price
        bid, ask = max((p for k, p in own.items() if k[0] == "bid"), default=None), min((p for k, p in own.items() if k[0] == "ask"), default=None)
        now = "normal" if bid is None or ask is None or bid < ask else "locked" if bid == ask else "crossed"
        if now != state.get(security, "normal"):
            out.append((seq, security, bid, ask, now))
        state[security] = now
    return sorted(out)


def test_one_security_over_many_batches(spark):
    r = random.Random(11)
    side = lambda action: None if action == "mass_delete" and r.random() < 0.5 else r.choice(["bid", "ask"])
    actions = [r.choice(["new", "new", "new", "change", "delete", "trade", "mass_delete" if k % 20 == 0 else "new"]) for k in range(3000)]
    rows = [(i, r.choice([7, 7, 7, 7, 8, 9, None]), side(a), r.randrange(12), a, r.choice([None, *range(95, 106)]), 1) for i, a in enumerate(actions)]
    rows = [(2**53 + i, s if s else 10, *x) for i, s, *x in rows]
    ops = [(i, 3 if i % 3 else i % 11, r.choice(["book", "book", "book", "statistic", "snapshot", "reset" if i % 50 == 0 else "book"]), i // 7 + r.choice([0, 0, 0, 1, 2])) for i in range(1500)]
    state, want = {}, []
    for seq, security, op, number in ops:
        book_ = state.setdefault(security, recovery.Book())
        outcome, low, high = book_.step(op, number)
        want.append((seq, security, op, outcome, book_.state, low, high))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = book.crossing_series(events_at(spark, rows).repartition(3))
        healed = recovery.replay(spark.createDataFrame(ops, "seq long, security_id long, op string, rpt_seq long").repartition(3))
        assert sorted(map(tuple, found.collect())) == brute_crossing(rows)
        assert sorted(map(tuple, healed.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for frame in (found, healed):  # no security's rows are put into one frame
        plan = frame._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "InPandas" not in plan


def test_book_state_follows_live_orders():
    state = book.Crossing()
    for k in range(20_000):
        state.step("bid", 1, "new", k)
        state.step("ask", 2, "new", 100_000 - k)
    assert len(state.live) == 2 and len(state.count) < 3000 and all(len(h) < 3000 for h in state.heaps.values())


def test_empty_replay_and_crossing(spark):
    assert recovery.replay(spark.createDataFrame([], "seq long, security_id long, op string, rpt_seq long")).count() == 0
    assert book.crossing_series(events(spark, [])).count() == 0
