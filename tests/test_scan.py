"""Scans in two levels and dyadic intervals, against one window and against all pairs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import analytics, intervals, scan, sequence, trades
from tickloom.operators.book import crossing_series


def rows_of(spark, n=6000, seed=1):
    """A third of the rows have one key, some have none; orders tie now and then."""
    r = random.Random(seed)
    rows = [(r.choice([7, 7, 7, 1, 2, 3, 4, None, *range(10, 16)]), k // r.choice([1, 1, 1, 2]), k % 2, r.choice([None, r.randrange(1000)]), k) for k in range(n)]
    return spark.createDataFrame(rows, "key long, at long, second long, value long, id long").repartition(5)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("hot", [100, 1000, 10**9])
def test_prefix_like_one_window(spark, inclusive, hot):
    rows, order = rows_of(spark), ["at", "second", "id"]
    columns = {"most": ("max", F.col("value")), "sum": ("sum", F.col("value")), "last": ("last", F.col("value"))}
    got = scan.prefix(rows, "key", order, columns, inclusive, hot, 8)
    own = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.withColumns({"most": F.max("value").over(own), "sum": F.sum("value").over(own), "last": F.last("value", ignorenulls=True).over(own)})
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_busy_key_is_many_tasks(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("key"), F.col("id").alias("at"), (F.col("id") % 97).alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        sizes = lambda hot: sorted(r["count"] for r in scan.prefix(rows, "key", ["at"], {"most": ("max", F.col("value"))}, hot=hot).where("most >= 0").groupBy(F.spark_partition_id()).count().collect())
        plain, cut = sizes(10**9), sizes(5000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plain[-1] >= 20_000 and sum(cut) == 60_000
    assert cut[-1] < 2.5 * cut[len(cut) // 2]


def test_operators_on_a_busy_key(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, r.choice([5, 5, 1, 2, 3]), r.randrange(1, 3000), r.choice(["a", "b"]), r.randrange(100), 1000 + k // 3 - r.choice([0, 0, 0, 40])) for k in range(4000)]
    frame = spark.createDataFrame(rows, "seq long, security_id long, number long, kind string, price long, second long").withColumn("qty", F.lit(1).cast("long")).repartition(4)

    def every():
        facts = frame.select("seq", "security_id", F.when(F.col("price") > 70, F.col("price")).alias("bid"), F.when(F.col("price") < 10, F.col("price")).alias("ask"))
        found = (
            sequence.classify_gaps(frame, "security_id", "number"), sequence.current_epoch(frame, "security_id", "number"), trades.candles(frame, 5), analytics.hysteresis(frame, "security_id", "price", 80, 20, "seq"),
            trades.as_of(frame.where("kind = 'a'").select("seq", "security_id", "price"), facts, ["bid", "ask"]),
        )
        return [sorted(map(repr, f.collect())) for f in found]

    plain = every()
    monkeypatch.setattr(scan.prefix, "__defaults__", (True, 300, 16))
    assert every() == plain


def test_pieces_and_moments(spark):
    r = random.Random(7)
    spans = [(k, *sorted((r.randrange(0, 200), r.randrange(0, 200)))) for k in range(150)] + [(900, 0, 256), (901, 5, 5), (902, 255, 256), (903, 0, 1)]
    levels = intervals.levels_for(256)
    cut = intervals.pieces(spark.createDataFrame(spans, "id int, low long, high long"), "low", "high", levels)
    points = intervals.moments(spark.range(256).select(F.col("id").alias("t")), "t", levels)
    got = [(x.id, x.t) for x in points.join(cut, ["level", "piece"]).collect()]
    assert sorted(got) == sorted((k, t) for k, a, b in spans for t in range(a, b))
    assert max(x["count"] for x in cut.groupBy("id").count().collect()) <= 2 * levels


def order_rows(seed, n=1500):
    r = random.Random(seed)
    side = lambda action: None if action == "mass_delete" and r.random() < 0.5 else r.choice(["bid", "ask"])
    actions = [r.choice(["new", "new", "new", "change", "delete", "trade", "mass_delete" if k % 20 == 0 else "new"]) for k in range(n)]
    return [(i, r.choice([7, 7, 7, 8, 9]), side(a), r.randrange(12), a, r.choice([None, *range(95, 106)]), 1) for i, a in enumerate(actions)]


EVENTS = "seq long, security_id long, side string, order_id long, action string, price long, qty long"


def live_at(rows, security, cutoff):
    live = {}
    for seq, own, side, order, action, price, qty in rows:
        if own != security or seq > cutoff:
            continue
        if action == "mass_delete":
            live = {k: v for k, v in live.items() if side in ("bid", "ask") and k[0] != side}
        elif action == "delete":
            live.pop((side, order), None)
        elif action in ("new", "change"):
            live[side, order] = (price, qty)
    return live


@pytest.mark.parametrize("hot", [10**9, 100])
def test_books_by_intervals(spark, monkeypatch, hot):
    monkeypatch.setattr(scan.prefix, "__defaults__", (True, hot, 8))
    rows = order_rows(4)
    events = spark.createDataFrame(rows, EVENTS).repartition(3)
    best = {r.seq: (r.bid_px, r.ask_px) for r in intervals.best_prices(events).collect()}
    for seq, security, *_ in rows:
        live = live_at(rows[: seq + 1], security, seq)
        side = lambda s: [p for (k, _), (p, _) in live.items() if k == s and p is not None]  # noqa: E731, B023
        assert best[seq] == (max(side("bid"), default=None), min(side("ask"), default=None)), seq
    assert sorted(map(tuple, intervals.crossings(events).collect())) == sorted(map(tuple, crossing_series(events).collect()))
    r = random.Random(1)
    clients = [(c, r.choice([7, 8, 9, 10]), r.randrange(-1, 1700)) for c in range(60)]
    got = {}
    for x in intervals.books_at(events, spark.createDataFrame(clients, "client_id long, security_id long, cutoff long")).collect():
        got.setdefault(x.client_id, {})[x.side, x.order_id] = (x.price, x.qty)
    assert all(got.get(c, {}) == live_at(rows, s, t) for c, s, t in clients)


def test_exploded_rows_are_not_broadcast(spark, capsys, tmp_path):
    # from files, whose sizes are known and small
    spark.createDataFrame(order_rows(5, 300), EVENTS).write.parquet(f"{tmp_path}/events")
    spark.createDataFrame([(1, 7, 200)], "client_id long, security_id long, cutoff long").write.parquet(f"{tmp_path}/asked")
    events, asked = spark.read.parquet(f"{tmp_path}/events"), spark.read.parquet(f"{tmp_path}/asked")
    for found in (intervals.best_prices(events), intervals.crossings(events), intervals.books_at(events, asked)):
        found.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_levels_follow_the_longest_book(spark, monkeypatch):
    levels, counted = [], []
    moments, cuts = intervals.moments, scan.cuts
    monkeypatch.setattr(intervals, "moments", lambda rows, at, n: levels.append(n) or moments(rows, at, n))
    monkeypatch.setattr(scan, "cuts", lambda rows, *rest: counted.append(rows.columns) or cuts(rows, *rest))
    events = spark.createDataFrame([(seq * 10**9, *rest) for seq, *rest in order_rows(6, 600)], EVENTS)
    assert sorted(map(tuple, intervals.crossings(events).collect())) == sorted(map(tuple, crossing_series(events).collect()))
    assert levels == [levels[0]] and levels[0] <= (600).bit_length()
    # busy books are found in the events, not by making all best prices once more
    assert counted and not any("bid_px" in columns for columns in counted)
    twice = spark.createDataFrame([(5, 1), (5, 1), (9, 1), (9, 2)], "seq long, security_id long")
    assert sorted((r.security_id, r.seq, r.place) for r in intervals.placed(twice).collect()) == [(1, 5, 0), (1, 5, 0), (1, 9, 2), (2, 9, 0)]


def test_nothing(spark):
    none = spark.createDataFrame([], EVENTS)
    assert intervals.best_prices(none).count() == intervals.crossings(none).count() == 0
    assert intervals.books_at(none, spark.createDataFrame([(1, 2, 3)], "client_id long, security_id long, cutoff long")).count() == 0
