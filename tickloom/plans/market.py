"""Queries on messages, books, trades and candles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom import functions as fx
from tickloom.operators import analytics, book, conflation, instruments, sequence, trades
from tickloom.sources import messages, numbered, order_events, packets, table
from tickloom.sources import trades as prints

#: The stand-in tables of tickloom.sources, in SQL.
EV = """ev AS (
  SELECT event_id AS seq, user_id AS security_id, event_type AS kind, CAST(floor(value * 10000) AS BIGINT) AS price,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS qty, epoch_us(ts) // 1000000 AS second, epoch_us(ts) AS ts_us FROM events)"""
NUM = EV + """, num AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY seq) AS rpt_seq FROM ev) WHERE (seq * 7919) % 100 >= 3)"""
ORD = EV + """, ord AS (
  SELECT seq, security_id, CASE WHEN kind = 'signup' AND seq % 3 = 0 THEN NULL WHEN qty % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, qty % 10 AS order_id,
         CASE kind WHEN 'click' THEN 'new' WHEN 'view' THEN 'change' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'mass_delete' ELSE 'trade' END AS action,
         CASE WHEN seq % 11 <> 0 THEN CAST(floor(price / 100000) * 100000 AS BIGINT) END AS price, qty FROM ev)"""


def live_sql(source: str, name: str = "live", levels: str = "lev") -> str:
    """Live orders, and price levels, after all events of a CTE."""
    return f""", {name}_c AS (
  SELECT security_id, s.side, max(seq) AS cleared FROM {source} JOIN (VALUES ('bid'), ('ask')) AS s(side) ON coalesce({source}.side, s.side) = s.side
  WHERE action = 'mass_delete' GROUP BY ALL
), {name}_l AS (
  SELECT security_id, side, order_id, arg_max({{'seq': seq, 'action': action, 'price': price, 'qty': qty}}, seq) AS e FROM {source} WHERE action IN ('new', 'change', 'delete') GROUP BY ALL
), {name} AS (
  SELECT l.security_id, l.side, order_id, e.seq AS seq, e.price AS price, e.qty AS qty FROM {name}_l l LEFT JOIN {name}_c c ON l.security_id = c.security_id AND l.side = c.side
  WHERE e.action <> 'delete' AND (cleared IS NULL OR e.seq > cleared)
), {levels} AS (
  SELECT security_id, side, price, CAST(sum(qty) AS BIGINT) AS total_qty, count(*) AS order_count FROM {name} WHERE price IS NOT NULL GROUP BY ALL)"""


LIVE = ORD + live_sql("ord")
TRD = EV + """, trd AS (
  SELECT seq, security_id, seq % 5000 AS trade_id, price, qty, second, CAST(seq % 8 AS INTEGER) AS condition, CASE seq % 13 WHEN 0 THEN 'leg' WHEN 1 THEN 'cross' END AS sub_type FROM ev
), rep AS (SELECT * FROM trd WHERE condition & 1 = 0 AND (sub_type IS NULL OR sub_type <> 'leg')), bst AS (
  SELECT seq, security_id, (seq - 3 * (seq % 50)) % 5000 AS trade_id FROM ev WHERE kind = 'error')"""
PKT = """pkt AS (SELECT lang AS channel, doc_id * 15 + (doc_id // 100) * 4000 AS ts, n_chars % 2000 AS size FROM documents)"""


def bars_sql(source: str, width: int, name: str = "bars") -> str:
    """Candles of a CTE of trades."""
    return f"""{name}_t AS (
  SELECT *, second - second % {width} AS time FROM {source}
), {name}_l AS (
  SELECT *, max(time) OVER (PARTITION BY security_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high_time FROM {name}_t
), {name}_a AS (
  SELECT security_id, time, arg_min(price, seq) AS f, max(price) AS h, min(price) AS l, arg_max(price, seq) AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM {name}_l WHERE high_time IS NULL OR time >= high_time GROUP BY ALL
), {name}_o AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY security_id ORDER BY time), f) AS open FROM {name}_a
), {name} AS (
  SELECT security_id, time, open, greatest(h, open) AS high, least(l, open) AS low, close, volume, close AS avg FROM {name}_o)"""


def filled_sql(bars: str, width: int, most: int, name: str = "filled") -> str:
    return f"""{name}_g AS (
  SELECT *, least({most}, coalesce((lead(time) OVER (PARTITION BY security_id ORDER BY time) - time) // {width} - 1, 0)) AS gap FROM {bars}
), {name} AS (
  SELECT security_id, time + k * {width} AS time, CASE WHEN k = 0 THEN open ELSE close END AS open, CASE WHEN k = 0 THEN high ELSE close END AS high,
         CASE WHEN k = 0 THEN low ELSE close END AS low, close, CASE WHEN k = 0 THEN volume ELSE 0 END AS volume, avg
  FROM (SELECT *, unnest(generate_series(0, gap)) AS k FROM {name}_g))"""


def reported(s, d):
    return trades.reportable(prints(s, d))


def busts(s, d):
    rows = messages(s, d).where("kind = 'error'")
    return rows.select("seq", "security_id", F.pmod(F.col("seq") - 3 * F.pmod("seq", F.lit(50)), F.lit(5000)).alias("trade_id"))


def statuses(s, d):
    return messages(s, d).where("kind in ('signup', 'error')").select("seq", "security_id", F.pmod("qty", F.lit(4)).cast("int").alias("status"))


def bars(s, d, width=3600):
    return trades.candles(messages(s, d), width)


def live(s, d):
    return book.live_orders(order_events(s, d))


def levels(s, d):
    return book.price_levels(live(s, d))


STATUS = ", sts AS (SELECT seq, security_id, CAST(qty % 4 AS INTEGER) AS status FROM ev WHERE kind IN ('signup', 'error'))"
WITH_STATUS = """, sta AS (
  SELECT * FROM (SELECT t.*, (SELECT arg_max(status, s.seq) FROM sts s WHERE s.security_id = t.security_id AND s.seq <= t.seq) AS status FROM trd t))"""
ALL_BARS = f"WITH {EV}, {bars_sql('ev', 3600)}"


def gap_series(s, d):
    rows = sequence.classify_gaps(numbered(s, d), "security_id", "rpt_seq")
    return rows.select("seq", "security_id", "rpt_seq", "expected", "result")


def two_feeds(s, d):
    rows = messages(s, d).withColumn("rpt_seq", F.row_number().over(Window.partitionBy("security_id").orderBy("seq")).cast("bigint"))
    a = rows.where("pmod(seq * 7919, 100) >= 3").select("security_id", "rpt_seq", (F.col("seq") * 2).alias("arrival"), F.lit("A").alias("feed"))
    b = rows.where("pmod(seq * 104729, 100) >= 5").select("security_id", "rpt_seq", (F.col("seq") * 2 + 1).alias("arrival"), F.lit("B").alias("feed"))
    return sequence.first_copies(a.unionByName(b), ["security_id", "rpt_seq"], "arrival")


def epochs(s, d):
    rows = messages(s, d).withColumn("version", (F.floor(F.col("seq") / 500) + F.when(F.pmod("seq", F.lit(97)) == 0, -1).otherwise(0)).cast("bigint"))
    return sequence.current_epoch(rows, "security_id", "version").groupBy("security_id", "epoch").agg(F.count("*").alias("n"))


def coverage(s, d):
    rows = numbered(s, d)
    bounds = rows.groupBy("security_id").agg((F.min("rpt_seq") - 1).alias("low"), F.max("rpt_seq").alias("high"))
    return sequence.missing_numbers(rows, bounds, "security_id", "rpt_seq")


def bootstrap(s, d):
    rows = messages(s, d).select("seq", F.col("kind").alias("channel"), "security_id", F.lit(40).alias("total"))
    return sequence.bootstrap_ready(rows, "channel", "security_id", "total")


def net_orders(s, d):
    kind = F.when(F.col("action") == "new", "Add").when(F.col("action") == "change", "Update").otherwise("Delete")
    rows = order_events(s, d).where("action in ('new', 'change', 'delete')").withColumns({"kind": kind, "window": F.floor(F.col("seq") / 1000)})
    return conflation.orders(rows, ["window", "security_id", "order_id"])


def coalesced(s, d):
    rows = prints(s, d).withColumns({"window": F.floor(F.col("seq") / 1000), "price": F.floor(F.col("price") / 100000) * 100000, "flags": F.col("condition")})
    return conflation.trades(rows, ["window", "security_id", "price"])


def cadence(s, d):
    rows = order_events(s, d).where("action in ('new', 'change', 'delete') and price is not null").withColumn("window", F.floor(F.col("seq") / 250))
    return conflation.last_of(rows, ["window", "security_id", "side", "price"], ["action", "qty", "seq"])


def cleared_windows(s, d):
    kind = F.when(F.col("action") == "mass_delete", "Clear").otherwise("Other")
    rows = order_events(s, d).where("side is not null").withColumns({"kind": kind, "window": F.floor(F.col("seq") / 2000)})
    kept = conflation.after_clears(rows, ["window", "security_id", "side"])
    return kept.select("seq", "security_id", "side", "kind", "emit_rank")


def routed(s, d):
    """All clients, dealt over all securities."""
    rows = messages(s, d).select("seq", "security_id", F.expr("shiftleft(1, cast(pmod(seq, 4) as int))").alias("channel_bit"))
    count = rows.agg((F.max("security_id") + 1).alias("securities"))
    clients = table(s, d, "customer").crossJoin(F.broadcast(count)).select(F.col("c_custkey").alias("client_id"), F.pmod(F.col("c_custkey") * 7, F.col("securities")).alias("security_id"), F.pmod("c_custkey", F.lit(16)).cast("int").alias("flags"))
    return conflation.route_counts(rows, clients)


def level_changes(s, d):
    """Levels touched by any event, with what is left of them at the end."""
    return conflation.changed_levels(order_events(s, d), levels(s, d))


def snapshot_and_changes(s, d):
    """Live orders at a cutoff, and all later events on top of them: the same as live orders at the end."""
    rows = order_events(s, d)
    cut = book.live_orders(rows.where("seq <= 5000")).withColumn("action", F.lit("new")).select("seq", "security_id", "side", "order_id", "action", "price", "qty")
    return book.live_orders(cut.unionByName(rows.where("seq > 5000").select(*cut.columns)))


def fix_batches(s, d):
    rows = order_events(s, d).where("action in ('new', 'change', 'delete') and price is not null").withColumn("window", F.floor(F.col("seq") / 2500))
    return conflation.batches(rows, ["window", "security_id", "side"])


def busted_bars(s, d):
    return trades.rebuilt(prints(s, d), busts(s, d), 3600)


def quotes(s, d):
    """Trades with the best prices of the messages before: clicks bid, views ask."""
    rows = messages(s, d)
    facts = rows.where("kind in ('click', 'view')").select("seq", "security_id", F.when(F.col("kind") == "click", F.col("price")).alias("bid"), F.when(F.col("kind") == "view", F.col("price")).alias("ask"))
    deals = rows.where("kind = 'purchase'").select("seq", "security_id", "price", "qty")
    found = trades.as_of(deals, facts, ["bid", "ask"])
    return found.withColumn("side", trades.aggressor(F.col("price"), F.col("bid"), F.col("ask")))


QUERIES = {
    "seq_gap_detect": gap_series,
    "ab_dedup": two_feeds,
    "channel_epoch": epochs,
    "gap_stats_by_kind": lambda s, d: sequence.gap_statistics(numbered(s, d), "security_id", "rpt_seq", "kind"),
    "rptseq_invariants": lambda s, d: sequence.sequence_invariants(numbered(s, d), "security_id", "rpt_seq", "kind"),
    "replay_coverage": coverage,
    "bootstrap_ready": bootstrap,
    "live_orders": live,
    "market_tier": lambda s, d: book.market_tier(live(s, d)),
    "price_levels": levels,
    "bbo": lambda s, d: book.top_of_book(levels(s, d)),
    "depth_topn": lambda s, d: book.depth(levels(s, d), 3),
    "book_validate": lambda s, d: book.orders_on_both_sides(book.live_orders(order_events(s, d).withColumn("side", F.when(F.pmod("seq", F.lit(2)) == 0, "bid").otherwise("ask")))),
    "book_summary": lambda s, d: book.book_summary(live(s, d)),
    "tier_transitions": lambda s, d: book.tier_transitions(order_events(s, d)),
    "trade_filter": reported,
    "recent_trades": lambda s, d: trades.recent(prints(s, d), 5).select("security_id", "n", "seq", "price", "qty"),
    "trade_bust": lambda s, d: trades.without_busted(prints(s, d), busts(s, d)).select("seq", "security_id", "trade_id"),
    "last_trade": lambda s, d: trades.last_trade(trades.without_busted(reported(s, d), busts(s, d))),
    "candles": lambda s, d: trades.candles(messages(s, d).withColumn("second", F.col("second") + F.pmod("seq", F.lit(7)) * 4000), 3600),
    "candles_gapfill": lambda s, d: trades.fill_gaps(bars(s, d), 3600, 60),
    "candle_retention": lambda s, d: trades.newest(trades.fill_gaps(bars(s, d), 3600, 60), 100),
    "latest_candle": lambda s, d: trades.newest(bars(s, d), 1),
    "candles_phase_gated": lambda s, d: trades.candles(trades.phase_gated(prints(s, d), statuses(s, d), 2), 3600),
    "auction_print": lambda s, d: trades.as_of(prints(s, d), statuses(s, d), ["status"]).select("seq", trades.auction_print(F.col("condition"), F.col("status"), 4, (1, 3)).alias("auction")),
    "candle_bust_rebuild": busted_bars,
    "candle_resample": lambda s, d: trades.resample(bars(s, d), 14400, 600),
    "auto_resolution": lambda s, d: bars(s, d, 60).groupBy("security_id").agg(fx.auto_resolution(F.max("time") - F.min("time")).alias("seconds")),
    "aggressor": quotes,
    "candle_chunks": lambda s, d: conflation.chunks(bars(s, d).select("security_id", "time"), "security_id", "time", 16),
    "order_conflation": net_orders,
    "trade_coalesce": coalesced,
    "level_conflation": level_changes,
    "cadence_last_value": cadence,
    "clear_purge": cleared_windows,
    "subscription_routing": routed,
    "snapshot_plus_changes": snapshot_and_changes,
    "fix_batches": fix_batches,
    "traffic_buckets": lambda s, d: analytics.traffic_buckets(packets(s, d), 100),
    "rolling_peak": lambda s, d: analytics.rolling_peak(analytics.traffic_buckets(packets(s, d), 100), 100, 1000),
    "size_histogram": lambda s, d: analytics.size_histogram(packets(s, d)),
    "channel_summary": lambda s, d: analytics.channel_summary(packets(s, d)),
    "halt_resume": lambda s, d: instruments.halts(messages(s, d).select("seq", "security_id", F.pmod("qty", F.lit(20)).alias("status"), F.pmod("seq", F.lit(9)).alias("event"))),
    "session_stats": lambda s, d: instruments.session_last(messages(s, d), F.col("kind") == "signup", "price"),
    "last_value_stats": lambda s, d: instruments.last_values(messages(s, d).select("seq", "security_id", "kind", F.col("price").alias("value"), F.floor(F.col("seq") / 3).alias("rpt_seq"))),
    "band_change": lambda s, d: instruments.changes(messages(s, d).select("seq", "security_id", F.when(F.pmod("qty", F.lit(5)) > 0, F.pmod("qty", F.lit(3))).alias("low"), F.pmod("qty", F.lit(2)).alias("high")), "security_id", ["low", "high"], "seq"),
    "gate_hysteresis": lambda s, d: analytics.hysteresis(messages(s, d).select("seq", "security_id", "qty"), "security_id", "qty", 80, 20, "seq"),
    "recovery_progress": lambda s, d: analytics.recovery_progress(messages(s, d).groupBy("security_id", "kind").agg((F.max("qty") > 95).alias("stale"))),
}

AFTER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
CLS = f"""{NUM}, cls AS (
  SELECT *, coalesce(max(rpt_seq) OVER (PARTITION BY security_id ORDER BY seq {AFTER}), 0) + 1 AS expected FROM num)"""
CLEAN = """, cln AS (SELECT t.* FROM {} t LEFT JOIN (SELECT security_id, trade_id, max(seq) AS b FROM bst GROUP BY ALL) x
  ON t.security_id = x.security_id AND t.trade_id = x.trade_id WHERE b IS NULL OR b < t.seq)"""

ORACLE_SQL = {
    "seq_gap_detect": f"WITH {CLS} SELECT seq, security_id, rpt_seq, expected, CASE WHEN rpt_seq = expected THEN 'in' WHEN rpt_seq < expected THEN 'dup' ELSE 'gap' END AS result FROM cls",
    "ab_dedup": f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY seq) AS rpt_seq FROM ev), f AS (
      SELECT security_id, rpt_seq, seq * 2 AS arrival, 'A' AS feed FROM n WHERE (seq * 7919) % 100 >= 3 UNION ALL SELECT security_id, rpt_seq, seq * 2 + 1, 'B' FROM n WHERE (seq * 104729) % 100 >= 5)
      SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY security_id, rpt_seq ORDER BY arrival) = 1""",
    "channel_epoch": f"""WITH {EV}, v AS (SELECT *, seq // 500 + CASE WHEN seq % 97 = 0 THEN -1 ELSE 0 END AS version FROM ev), m AS (
      SELECT *, max(version) OVER (PARTITION BY security_id ORDER BY seq) AS epoch FROM v WHERE version > 0) SELECT security_id, epoch, count(*) AS n FROM m WHERE version = epoch GROUP BY ALL""",
    "gap_stats_by_kind": f"""WITH {CLS} SELECT kind, count(*) AS gaps, CAST(sum(rpt_seq - expected) AS BIGINT) AS missing, count(DISTINCT security_id) AS keys
      FROM cls WHERE rpt_seq > expected AND expected > 1 GROUP BY GROUPING SETS ((kind), ())""",
    "rptseq_invariants": f"""WITH {NUM}, s AS (SELECT security_id, rpt_seq - lag(rpt_seq) OVER w AS step, lag(kind) OVER w <> kind AS other FROM num WINDOW w AS (PARTITION BY security_id ORDER BY seq))
      SELECT security_id, count(*) AS n, count(*) FILTER (step < 0) AS back, count(*) FILTER (step = 0) AS same, count(*) FILTER (step > 1) AS skipped, count(*) FILTER (step > 0 AND other) AS across_kinds FROM s GROUP BY ALL""",
    "replay_coverage": f"""WITH {NUM}, b AS (SELECT security_id, min(rpt_seq) AS low, max(rpt_seq) AS high FROM num GROUP BY ALL), w AS (SELECT security_id, unnest(generate_series(low, high)) AS rpt_seq FROM b)
      SELECT * FROM w ANTI JOIN num USING (security_id, rpt_seq)""",
    "bootstrap_ready": f"""WITH {EV}, n AS (SELECT kind, min(seq) AS seq FROM ev GROUP BY kind, security_id), c AS (SELECT kind, seq, row_number() OVER (PARTITION BY kind ORDER BY seq) AS k FROM n)
      SELECT kind AS channel, min(seq) AS ready FROM c WHERE k >= 40 GROUP BY ALL""",
    "live_orders": f"WITH {LIVE} SELECT * FROM live",
    "market_tier": f"WITH {LIVE} SELECT security_id, side, CAST(sum(qty) AS BIGINT) AS total_qty, count(*) AS order_count FROM live WHERE price IS NULL GROUP BY ALL",
    "price_levels": f"WITH {LIVE} SELECT * FROM lev",
    "bbo": f"""WITH {LIVE}, b AS (SELECT security_id, price, total_qty, order_count FROM lev WHERE side = 'bid' QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY price DESC) = 1),
      a AS (SELECT security_id, price, total_qty, order_count FROM lev WHERE side = 'ask' QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY price) = 1)
      SELECT coalesce(b.security_id, a.security_id) AS security_id, coalesce(b.price, 0) AS bid_px, coalesce(b.total_qty, 0) AS bid_qty, coalesce(b.order_count, 0) AS bid_count,
      coalesce(a.price, 0) AS ask_px, coalesce(a.total_qty, 0) AS ask_qty, coalesce(a.order_count, 0) AS ask_count FROM b FULL JOIN a ON a.security_id = b.security_id""",
    "depth_topn": f"WITH {LIVE}, r AS (SELECT *, row_number() OVER (PARTITION BY security_id, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS level FROM lev) SELECT * FROM r WHERE level <= 3",
    "book_validate": f"WITH {LIVE.replace('CASE WHEN kind = ' + chr(39) + 'signup' + chr(39) + ' AND seq % 3 = 0 THEN NULL WHEN qty % 2 = 0', 'CASE WHEN seq % 2 = 0')} SELECT security_id, order_id FROM live GROUP BY ALL HAVING count(DISTINCT side) > 1",
    "book_summary": f"""WITH {LIVE}, l AS (SELECT security_id, max(total_qty) AS max_qty, count(*) AS levels, CAST(sum(order_count) AS BIGINT) AS orders FROM lev GROUP BY ALL),
      m AS (SELECT security_id, CAST(sum(qty) AS BIGINT) AS market_qty FROM live WHERE price IS NULL GROUP BY ALL)
      SELECT coalesce(l.security_id, m.security_id) AS security_id, coalesce(max_qty, 0) AS max_qty, coalesce(levels, 0) AS levels, coalesce(orders, 0) AS orders, coalesce(market_qty, 0) AS market_qty
      FROM l FULL JOIN m ON l.security_id = m.security_id""",
    "tier_transitions": f"""WITH {ORD}, t AS (SELECT security_id, action, price, lag(price) OVER w AS was, lag(action) OVER w AS did FROM ord WHERE action IN ('new', 'change', 'delete') WINDOW w AS (PARTITION BY security_id, side, order_id ORDER BY seq))
      SELECT security_id, count(*) FILTER (was IS NULL AND price IS NOT NULL) AS to_priced, count(*) FILTER (was IS NOT NULL AND price IS NULL) AS to_market FROM t WHERE did IS NOT NULL AND did <> 'delete' AND action <> 'delete' GROUP BY ALL""",
    "trade_filter": f"WITH {TRD} SELECT * FROM rep",
    "recent_trades": f"WITH {TRD}, r AS (SELECT security_id, row_number() OVER (PARTITION BY security_id ORDER BY seq DESC) AS n, seq, price, qty FROM trd) SELECT * FROM r WHERE n <= 5",
    "trade_bust": f"WITH {TRD}{CLEAN.format('trd')} SELECT seq, security_id, trade_id FROM cln",
    "last_trade": f"WITH {TRD}{CLEAN.format('rep')} SELECT security_id, arg_max(price, seq) AS price, arg_max(qty, seq) AS qty, max(seq) AS seq FROM cln GROUP BY ALL",
    "candles": f"WITH {EV}, sh AS (SELECT * REPLACE (second + (seq % 7) * 4000 AS second) FROM ev), {bars_sql('sh', 3600)} SELECT * FROM bars",
    "candles_gapfill": f"{ALL_BARS}, {filled_sql('bars', 3600, 60)} SELECT * FROM filled",
    "candle_retention": f"{ALL_BARS}, {filled_sql('bars', 3600, 60)} SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY time DESC) <= 100",
    "latest_candle": f"{ALL_BARS} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY time DESC) = 1",
    "candles_phase_gated": f"WITH {TRD}{STATUS}{WITH_STATUS}, g AS (SELECT * FROM sta WHERE coalesce(status, 2) = 2), {bars_sql('g', 3600)} SELECT * FROM bars",
    "auction_print": f"WITH {TRD}{STATUS}{WITH_STATUS} SELECT seq, condition & 4 <> 0 OR coalesce(status IN (1, 3), FALSE) AS auction FROM sta",
    "candle_bust_rebuild": f"""WITH {TRD}, t AS (
      SELECT trd.*, second - second % 3600 AS time, EXISTS (SELECT 1 FROM bst WHERE bst.security_id = trd.security_id AND bst.trade_id = trd.trade_id AND bst.seq >= trd.seq) AS gone,
             max(second - second % 3600) OVER (PARTITION BY security_id ORDER BY seq) AS newest FROM trd
    ), g AS (
      SELECT security_id, time, count(*) AS all_, count(*) FILTER (gone) AS busted, arg_max(price, seq) AS was FROM t WHERE time = newest GROUP BY ALL
    ), k AS (
      SELECT security_id, time, arg_min(price, seq) AS first, arg_max(price, seq) AS close, max(price) AS top, min(price) AS bottom, CAST(sum(qty) AS BIGINT) AS volume FROM t WHERE time = newest AND NOT gone GROUP BY ALL
    ), e AS (  -- without the last candle of a security if nothing is left of it
      SELECT g.*, close, (SELECT arg_max(k2.close, k2.time) FROM k k2 WHERE k2.security_id = g.security_id AND k2.time < g.time) AS before,
             (SELECT arg_min(g2.was, g2.time) FROM g g2 WHERE g2.security_id = g.security_id) AS oldest, (SELECT min(g3.time) FROM g g3 WHERE g3.security_id = g.security_id) AS start
      FROM g LEFT JOIN k USING (security_id, time) WHERE NOT (busted = all_ AND time = (SELECT max(g4.time) FROM g g4 WHERE g4.security_id = g.security_id))
    ), o AS (  -- a flat one, and what opens after it: at the last close before, or the old close of the first candle
      SELECT e.*, k.first, top, bottom, volume, CASE WHEN e.time = start AND e.close IS NOT NULL THEN k.first ELSE coalesce(before, oldest) END AS open FROM e LEFT JOIN k USING (security_id, time)
    )
    SELECT security_id, time, open, greatest(top, open) AS high, least(bottom, open) AS low, coalesce(close, open) AS close, coalesce(volume, 0) AS volume, was AS avg, busted FROM o""",
    "candle_resample": f"""{ALL_BARS}, w AS (SELECT security_id, time - time % 14400 AS time, arg_min(open, time) AS f, max(high) AS h, min(low) AS l, arg_max(close, time) AS close, CAST(sum(volume) AS BIGINT) AS volume, arg_max(avg, time) AS avg FROM bars GROUP BY 1, 2),
      o AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY security_id ORDER BY time), f) AS open FROM w), wide AS (SELECT security_id, time, open, greatest(h, open) AS high, least(l, open) AS low, close, volume, avg FROM o),
      {filled_sql('wide', 14400, 600)} SELECT * FROM filled""",
    "auto_resolution": f"""WITH {EV}, {bars_sql('ev', 60)}, s AS (SELECT security_id, max(time) - min(time) AS span FROM bars GROUP BY ALL)
      SELECT security_id, CASE WHEN span <= 600 THEN 1 WHEN span <= 3600 THEN 5 WHEN span <= 7200 THEN 15 WHEN span <= 14400 THEN 60 ELSE 300 END AS seconds FROM s""",
    "aggressor": f"""WITH {EV}, w AS (SELECT *, last_value(CASE WHEN kind = 'click' THEN price END IGNORE NULLS) OVER p AS bid, last_value(CASE WHEN kind = 'view' THEN price END IGNORE NULLS) OVER p AS ask FROM ev
      WINDOW p AS (PARTITION BY security_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT seq, security_id, price, qty, bid, ask, CASE WHEN price >= ask THEN 1 WHEN price <= bid THEN -1 ELSE 0 END AS side FROM w WHERE kind = 'purchase'""",
    "candle_chunks": f"""{ALL_BARS}, c AS (SELECT security_id, time, row_number() OVER (PARTITION BY security_id ORDER BY time) - 1 AS n, count(*) OVER (PARTITION BY security_id) AS a FROM bars)
      SELECT security_id, time, n // 16 AS chunk, n < 16 AS first, n // 16 = (a - 1) // 16 AS last FROM c""",
    "order_conflation": f"""WITH {ORD}, k AS (SELECT *, seq // 1000 AS w, CASE action WHEN 'new' THEN 'Add' WHEN 'change' THEN 'Update' ELSE 'Delete' END AS k FROM ord WHERE action IN ('new', 'change', 'delete')),
      n AS (SELECT w, security_id, order_id, arg_min(k, seq) <> 'Add' AS b, arg_max({{'k': k, 'price': price, 'qty': qty}}, seq) AS l FROM k GROUP BY ALL)
      SELECT w AS "window", security_id, order_id, CASE WHEN b AND l.k <> 'Delete' THEN 'Update' WHEN b THEN 'Delete' ELSE 'Add' END AS kind, l.price AS price, l.qty AS qty FROM n WHERE b OR l.k <> 'Delete'""",
    "trade_coalesce": f"""WITH {TRD} SELECT seq // 1000 AS window, security_id, CAST(floor(price / 100000) * 100000 AS BIGINT) AS price, CAST(sum(qty) AS BIGINT) AS qty, arg_max(trade_id, seq) AS trade_id, bit_or(condition) AS flags FROM trd GROUP BY 1, 2, 3""",
    "level_conflation": f"""WITH {LIVE}, t AS (SELECT DISTINCT security_id, side, price FROM ord WHERE action IN ('new', 'change', 'delete') AND price IS NOT NULL)
      SELECT t.*, coalesce(total_qty, 0) AS total_qty, total_qty IS NULL AS deleted FROM t LEFT JOIN lev USING (security_id, side, price)""",
    "cadence_last_value": f"""WITH {ORD} SELECT seq // 250 AS window, security_id, side, price, arg_max(action, seq) AS action, arg_max(qty, seq) AS qty, max(seq) AS seq FROM ord
      WHERE action IN ('new', 'change', 'delete') AND price IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "clear_purge": f"""WITH {ORD}, c AS (SELECT *, max(CASE WHEN action = 'mass_delete' THEN seq END) OVER (PARTITION BY seq // 2000, security_id, side) AS c FROM ord WHERE side IS NOT NULL)
      SELECT seq, security_id, side, CASE WHEN action = 'mass_delete' THEN 'Clear' ELSE 'Other' END AS kind, CASE WHEN action = 'mass_delete' THEN 0 ELSE 1 END AS emit_rank FROM c WHERE c IS NULL OR seq >= c""",
    "subscription_routing": f"""WITH {EV}, b AS (SELECT security_id, 1 << CAST(seq % 4 AS INTEGER) AS bit, count(*) AS n, min(seq) AS f FROM ev GROUP BY 1, 2),
      c AS (SELECT c_custkey AS client_id, (c_custkey * 7) % (SELECT max(security_id) + 1 FROM ev) AS security_id, CAST(c_custkey % 16 AS INTEGER) AS flags FROM customer)
      SELECT client_id, CAST(sum(n) AS BIGINT) AS events, min(f) AS first_seq FROM b JOIN c USING (security_id) WHERE flags & bit <> 0 GROUP BY ALL""",
    "snapshot_plus_changes": f"WITH {LIVE} SELECT * FROM live",
    "fix_batches": f"""WITH {ORD} SELECT seq // 2500 AS window, security_id, side, count(*) AS n, string_agg(seq || ':' || action || ':' || price, ',' ORDER BY seq) AS changes FROM ord
      WHERE action IN ('new', 'change', 'delete') AND price IS NOT NULL GROUP BY 1, 2, 3""",
    "traffic_buckets": f"WITH {PKT} SELECT channel, ts - ts % 100 AS bucket, count(*) AS pkts, CAST(sum(size) AS BIGINT) AS bytes, min(size) AS min_size, max(size) AS max_size FROM pkt GROUP BY 1, 2",
    "rolling_peak": f"""WITH {PKT}, b AS (SELECT channel, ts - ts % 100 AS bucket, count(*) AS pkts FROM pkt GROUP BY 1, 2), r AS (SELECT channel, sum(pkts) OVER (PARTITION BY channel ORDER BY bucket RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS n FROM b)
      SELECT channel, CAST(max(n) AS BIGINT) AS peak FROM r GROUP BY ALL""",
    "size_histogram": f"""WITH {PKT}, b AS (SELECT unnest([80, 128, 192, 256, 384, 512, 768, 1024, 1500, -1]) AS bin), f AS (SELECT channel, coalesce((SELECT min(bin) FROM b WHERE bin >= size), -1) AS bin FROM pkt)
      SELECT c.channel, CAST(b.bin AS INTEGER) AS bin, count(f.bin) AS n FROM (SELECT DISTINCT channel FROM pkt) c CROSS JOIN b LEFT JOIN f ON f.channel = c.channel AND f.bin = b.bin GROUP BY ALL""",
    "channel_summary": f"""WITH {PKT}, b AS (SELECT channel, ts - ts % 100 AS bucket, count(*) AS pkts FROM pkt GROUP BY 1, 2),
      r AS (SELECT channel, pkts, sum(pkts) OVER (PARTITION BY channel ORDER BY bucket RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) AS n FROM b),
      k AS (SELECT channel, max(pkts) AS peak_bucket, CAST(max(n) AS BIGINT) AS peak_window FROM r GROUP BY ALL),
      p AS (SELECT channel, count(*) AS pkts, CAST(sum(size) AS BIGINT) AS bytes, max(ts) - min(ts) AS duration FROM pkt GROUP BY ALL)
      SELECT p.*, CASE WHEN duration > 0 THEN pkts * 1000 // duration END AS per_second, peak_bucket, peak_window FROM p JOIN k USING (channel)""",
    "halt_resume": f"""WITH {EV}, h AS (SELECT seq, security_id, lag(qty % 20) OVER (PARTITION BY security_id ORDER BY seq) AS previous_status, qty % 20 AS new_status, seq % 9 AS e FROM ev)
      SELECT seq, security_id, previous_status, new_status, CASE e WHEN 1 THEN 'halted' ELSE 'resumed' END AS transition FROM h WHERE e IN (1, 2)""",
    "session_stats": f"""WITH {EV}, s AS (SELECT *, CAST(sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY security_id ORDER BY seq) AS BIGINT) AS session FROM ev),
      l AS (SELECT security_id, session, arg_max(price, seq) FILTER (kind <> 'signup') AS price FROM s GROUP BY ALL) SELECT * FROM l QUALIFY session = max(session) OVER (PARTITION BY security_id)""",
    "last_value_stats": f"""WITH {EV}, r AS (SELECT *, seq // 3 AS rpt_seq FROM ev) SELECT security_id, kind, price AS value, rpt_seq FROM r QUALIFY row_number() OVER (PARTITION BY security_id, kind ORDER BY rpt_seq DESC, seq) = 1""",
    "band_change": f"""WITH {EV}, b AS (SELECT seq, security_id, CASE WHEN qty % 5 > 0 THEN qty % 3 END AS low, qty % 2 AS high FROM ev), c AS (SELECT *, lag(low) OVER w AS l, lag(high) OVER w AS h, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY security_id ORDER BY seq))
      SELECT seq, security_id, low, high FROM c WHERE n = 1 OR low IS DISTINCT FROM l OR high IS DISTINCT FROM h""",
    "gate_hysteresis": f"""WITH {EV} SELECT seq, security_id, qty, coalesce(last_value(CASE WHEN qty >= 80 THEN TRUE WHEN qty <= 20 THEN FALSE END IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS engaged FROM ev""",
    "recovery_progress": f"""WITH {EV}, s AS (SELECT security_id, kind, max(qty) > 95 AS stale FROM ev GROUP BY ALL) SELECT kind, count(DISTINCT security_id) AS known, count(DISTINCT CASE WHEN stale THEN security_id END) AS stale FROM s GROUP BY GROUPING SETS ((kind), ())""",
}
