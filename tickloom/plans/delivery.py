"""Queries on trade times, instruments, monitors, conflation and delivery, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import functions as fx
from tickloom.operators import analytics, book, conflation, instruments, sequence, trades
from tickloom.plans.market import ALL_BARS, EV, LIVE, ORD, PKT, TRD, bars, bars_sql, busts, filled_sql, live, live_sql, levels, reported
from tickloom.plans.reference import definitions
from tickloom.sources import messages, order_events, packets, table
from tickloom.sources import trades as prints


def trade_times(s, d):
    """A trade has the time of its transaction, or else that of its packet."""
    rows = messages(s, d).select("seq", F.when(F.pmod("seq", F.lit(5)) > 0, F.col("second") - 1).alias("transact_time"), F.col("second").alias("sending_time"))
    return rows.select("seq", F.coalesce("transact_time", "sending_time").alias("time"))


def few_trades(s, d):
    """Trades of every third security: the others have candles only."""
    return trades.without_busted(reported(s, d), busts(s, d)).where("pmod(security_id, 3) = 0")


def vwap_bars(s, d):
    """Candles whose avg is the session's average price as last published before the trade."""
    published = messages(s, d).where("kind = 'view'").select("seq", "security_id", F.col("price").alias("avg"))
    rows = trades.as_of(messages(s, d), published, ["avg"])
    return trades.candles(rows.withColumn("avg", F.coalesce("avg", "price")), 3600)


def forward_bars(s, d):
    """Forward trades take the same path as trades."""
    rows = messages(s, d)
    both = rows.where("kind = 'purchase'").withColumn("forward", F.lit(False)).unionByName(rows.where("kind = 'click'").withColumn("forward", F.lit(True)))
    return trades.candles(both, 3600)


def wiped(s, d):
    """Orders of a customer since their identity (here their order's status) changed last."""
    rows = definitions(s, d)
    kept = instruments.current_generation(rows, rows.select("security_id", "seq", "status"), ["status"])
    return kept.groupBy("security_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def legs(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.pmod("l_partkey", F.lit(5)).alias("number"), F.col("l_linenumber").alias("line")))).alias("legs"))
    return instruments.members_of(lines, "l_orderkey", "legs", "number")


def effective_statuses(s, d):
    rows = messages(s, d)
    own = rows.where("kind in ('signup', 'error')").select("seq", "security_id", F.pmod("qty", F.lit(4)).alias("status"), F.when(F.pmod("qty", F.lit(7)) == 0, 101).when(F.pmod("qty", F.lit(7)) == 1, 102).otherwise(0).alias("event"))
    phases = rows.where("kind = 'click' and pmod(seq, 50) = 0").select("seq", F.pmod("security_id", F.lit(10)).alias("security_group"), F.pmod("seq", F.lit(9)).alias("status"))
    return instruments.effective_status(own, phases, rows.select("security_id", F.pmod("security_id", F.lit(10)).alias("security_group")).distinct())


def news_in_time(s, d):
    """Turns of a conversation as parts, 1.7 seconds apart, of which those within five seconds count."""
    parts = table(s, d, "conversations").where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("news_id"), (F.col("turn") * 1700).alias("ms"))
    return instruments.within_life(parts, 5000, "ms").groupBy("news_id").agg(F.count("*").alias("parts"))


def subscribed(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("client_id"), F.pmod(F.col("c_custkey") * 7, F.lit(200)).alias("security_id"), F.pmod("c_custkey", F.lit(16)).cast("int").alias("flags"))


def sparse_parts(s, d):
    """Instruments some of whose fields are missing."""
    missing = lambda c, k: F.when(F.pmod("p_size", F.lit(k)) > 0, F.col(c)).alias(c)
    return table(s, d, "part").select(F.col("p_partkey").alias("security_id"), missing("p_name", 2), missing("p_brand", 3), missing("p_type", 5), missing("p_retailprice", 7))


def projections(s, d):
    """The definition, price band and auction views of an instrument, with the mask of fields that are there."""
    rows = sparse_parts(s, d)
    fields = ["p_name", "p_brand", "p_type", "p_retailprice"]
    limit = F.floor("p_retailprice").cast("bigint")
    return rows.select("security_id", instruments.presence(fields).alias("mask"), F.col("p_name").alias("symbol"), F.col("p_brand").alias("security_group"), (limit * 90).alias("low_limit"), (limit * 110).alias("high_limit"), fx.imbalance_side(F.when(F.col("p_type").isNotNull(), F.col("security_id") % 3 - 1)).alias("imbalance"))


def counted_versions(s, d):
    rows = messages(s, d).select("seq", "security_id", F.pmod("qty", F.lit(3)).alias("symbol"), F.when(F.pmod("seq", F.lit(4)) > 0, F.pmod("qty", F.lit(2))).alias("low"), F.floor(F.col("qty") / 50).alias("imbalance"))
    return instruments.versions(rows, "security_id", {"definition": ["symbol"], "band": ["low"], "auction": ["imbalance"]}, "seq").select("seq", "definition", "band", "auction", "any_version")


def group_health(s, d):
    groups = packets(s, d).groupBy(F.col("channel").alias("name")).agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    groups = groups.select("name", F.when(F.pmod("n", F.lit(2)) == 0, "Recovering").otherwise("Streaming").alias("state"), "last")
    return analytics.unhealthy(groups, 60_000, 5_200)


def tier_windows(s, d):
    rows = order_events(s, d).where("action in ('new', 'change', 'delete') and price is null").withColumns({"window": F.floor(F.col("seq") / 1000), "total_qty": F.col("qty"), "order_count": F.lit(1)})
    return conflation.tiers(rows, ["window", "security_id", "side"])


def emissions(s, d):
    kinds = {"mass_delete": "Clear", "new": "Order", "change": "Order", "delete": "Level", "trade": "Trade"}
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("action")]
    rows = order_events(s, d).select("seq", "security_id", F.floor(F.col("seq") / 1000).alias("window"), F.when((kind == "Order") & F.col("price").isNull(), "Tier").otherwise(kind).alias("kind"))
    return rows.select("seq", "window", "kind", conflation.emission(F.col("kind")).alias("emit_rank"))


def cadence_by_time(s, d):
    """The last values of each key in each quarter of a second."""
    rows = messages(s, d).withColumn("window", F.floor(F.col("ts_us") / 250_000))
    return conflation.last_of(rows, ["window", "security_id", "kind"], ["price", "qty", "seq"])


def requests(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("client_id"), F.pmod("c_custkey", F.lit(40)).cast("int").alias("flags"), F.element_at(F.array(*(F.lit(x) for x in (0, 50, 100, 250, 500))), F.pmod("c_custkey", F.lit(5)).cast("int") + 1).alias("interval"))
    return rows.select("client_id", "flags", "interval", (conflation.valid_flags(F.col("flags"), 31) & conflation.valid_cadence(F.col("interval"))).alias("valid"))


def bundles(s, d):
    """What each subscriber gets first: best prices (1), market tiers (2), last candle (4), last trade (8)."""
    parts = {
        1: book.top_of_book(levels(s, d)).select("security_id", "bid_px", "ask_px"), 2: book.market_tier(live(s, d)).select("security_id", "side", "total_qty"),
        4: trades.newest(bars(s, d), 1).select("security_id", "time", "close"), 8: trades.last_trade(trades.without_busted(reported(s, d), busts(s, d))).select("security_id", "price", "qty"),
    }
    return conflation.snapshot_bundle(parts, subscribed(s, d))


def turns(s, d):
    rows = table(s, d, "conversations").where("conv_id is not null and turn is not null and text is not null")
    return rows.groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("news_id")).agg(F.min("text").alias("text"))


def encoded(s, d):
    fields = {55: F.col("p_name"), 48: F.col("p_partkey"), 15: F.when(F.pmod("p_partkey", F.lit(2)) == 0, "é")}
    return table(s, d, "part").select("p_partkey", fx.tag_value("W", fields).alias("message"))


def texts(s, d):
    name = F.concat(F.col("p_name"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.lit(', "é"')).otherwise(F.lit("")))
    micros = F.col("p_partkey") * 86_399_123_457 - 5_000_000_000_000
    return table(s, d, "part").select("p_partkey", fx.csv_field(name).alias("field"), fx.utc_stamp(micros).alias("stamp"), fx.decoded(F.encode(F.concat(F.substring("p_name", 1, 6), F.lit("  ")), "UTF-8"), F.when(F.pmod("p_partkey", F.lit(4)) == 0, 99).otherwise(8)).alias("name"))


def labels(s, d):
    """Codes of two letters made from the keys of parts (some of one letter, some null)."""
    key = F.col("p_partkey")
    letter = lambda k: F.substring(F.lit("EDROFMSXPCLY"), F.pmod(k, F.lit(12)).cast("int") + 1, F.lit(1))
    code = F.when(F.pmod(key, F.lit(13)) > 0, F.concat(letter(key), F.when(F.pmod(key, F.lit(17)) > 0, letter(F.floor(key / 12))).otherwise(F.lit(""))))
    return table(s, d, "part").select("p_partkey", fx.cfi_label(code).alias("cfi"), fx.label(F.pmod(key, F.lit(4)).cast("int"), fx.LIMIT_TYPES).alias("limit_type"), fx.label(F.pmod(key, F.lit(3)).cast("int"), fx.LEG_SIDES).alias("leg_side"))


def stuck(s, d):
    """Channels of kinds that are ready at 10,000 securities, which none reaches, or after 300 messages."""
    rows = messages(s, d).select("seq", F.col("kind").alias("channel"), "security_id", F.lit(10_000).alias("total"))
    return sequence.bootstrap_ready(rows, "channel", "security_id", "total", limit=300)


def watched(s, d, **columns):
    return instruments.changes(messages(s, d).select("seq", "security_id", *(v.alias(k) for k, v in columns.items())), "security_id", list(columns), "seq")


QUERIES = {
    "trade_time": trade_times,
    "last_price": lambda s, d: trades.last_price(few_trades(s, d), bars(s, d)),
    "candles_vwap": vwap_bars,
    "forward_trades": forward_bars,
    "execution_summary": lambda s, d: messages(s, d).where("kind = 'purchase'").select("security_id", F.col("price").alias("last_price"), F.col("qty").alias("fill_qty"), F.col("second").alias("time")),
    "candles_display": lambda s, d: trades.display_bars(bars(s, d), 3600, 600),
    "last_wide_candle": lambda s, d: trades.last_wide_bar(bars(s, d), 14400),
    "candle_at": lambda s, d: trades.bars_at(bars(s, d), messages(s, d).where("kind = 'error'").select("seq", "security_id", F.col("second").alias("at")), 3600).select("seq", "security_id", "time", "close"),
    "instrument_last_trade": lambda s, d: trades.with_last_trade(table(s, d, "part").select(F.col("p_partkey").alias("security_id"), F.col("p_name").alias("symbol")), prints(s, d)),
    "identity_wipe": wiped,
    "group_members": legs,
    "effective_status": effective_statuses,
    "quantity_band_change": lambda s, d: watched(s, d, average=F.when(F.pmod("qty", F.lit(9)) > 0, F.floor(F.col("qty") / 40)), most=F.pmod("qty", F.lit(2))),
    "imbalance_change": lambda s, d: watched(s, d, size=F.floor(F.col("qty") / 30), condition=F.pmod("seq", F.lit(2))),
    "instrument_lookup": lambda s, d: instruments.lookup(table(s, d, "customer").select("c_custkey", F.upper("c_name").alias("symbol")), "symbol", "  customer#000000007 "),
    "news_in_time": news_in_time,
    "delisted": lambda s, d: instruments.delisted(subscribed(s, d), messages(s, d)),
    "instrument_projections": projections,
    "admin_status": lambda s, d: instruments.latest_status(messages(s, d).select("seq", "security_id", F.pmod("qty", F.lit(20)).alias("status"), F.pmod("seq", F.lit(9)).alias("event"))),
    "version_counters": counted_versions,
    "stats_by_epoch": lambda s, d: instruments.last_values_by_epoch(messages(s, d).select("seq", "security_id", "kind", F.col("price").alias("value"), F.floor(F.col("seq") / 400).alias("epoch"), F.pmod(F.floor(F.col("seq") / 3), F.lit(100)).alias("rpt_seq"))),
    "group_health": group_health,
    "tier_conflation": tier_windows,
    "stale_flags": lambda s, d: conflation.stale_flags(messages(s, d).withColumns({"window": F.floor(F.col("seq") / 1000), "stale": F.col("qty") > 50}), ["window", "security_id"]),
    "emission_order": emissions,
    "anchored_windows": lambda s, d: conflation.anchored_windows(messages(s, d).select("seq", "security_id", "second"), "security_id", "second", 7200),
    "cadence_by_time": cadence_by_time,
    "snapshot_at_cutoff": lambda s, d: book.live_orders(order_events(s, d).where("seq <= 5000")),
    "subscribe_validation": requests,
    "snapshot_bundle": bundles,
    "news_fragments": lambda s, d: conflation.fragments(turns(s, d), 40),
    "news_rejoined": lambda s, d: instruments.reassemble_news(conflation.fragments(turns(s, d), 64).withColumn("seq", F.col("part_number"))).select("news_id", F.md5("text").alias("digest")),
    "fix_encode": encoded,
    "fix_decode": lambda s, d: encoded(s, d).select("p_partkey", fx.intact(F.col("message")).alias("intact"), F.explode(fx.tag_values(F.col("message"))).alias("f")).select("p_partkey", "intact", "f.tag", "f.value"),
    "text_functions": texts,
    "labels": labels,
    "bootstrap_stuck": stuck,
}


def changed_sql(columns: str, names: tuple[str, ...]) -> str:
    """Rows in which any of the named values differs from the row before."""
    differs = " OR ".join(f"{n} IS DISTINCT FROM lag({n}) OVER w" for n in names)
    return f"WITH {EV}, b AS (SELECT seq, security_id, {columns} FROM ev), c AS (SELECT *, row_number() OVER w = 1 OR {differs} AS differs FROM b WINDOW w AS (PARTITION BY security_id ORDER BY seq)) SELECT * EXCLUDE (differs) FROM c WHERE differs"


def bytes_sum(text: str) -> str:
    return f"lpad(CAST(list_sum(list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS INTEGER))) % 256 AS VARCHAR), 3, '0')"


CLEANED = """, cln AS (SELECT t.* FROM rep t LEFT JOIN (SELECT security_id, trade_id, max(seq) AS b FROM bst GROUP BY ALL) x
  ON t.security_id = x.security_id AND t.trade_id = x.trade_id WHERE b IS NULL OR b < t.seq)"""
SUB = "sub AS (SELECT c_custkey AS client_id, (c_custkey * 7) % 200 AS security_id, CAST(c_custkey % 16 AS INTEGER) AS flags FROM customer)"
DEFS = "def AS (SELECT o_custkey AS security_id, o_orderkey AS seq, o_orderstatus AS status FROM orders)"
MESSAGES = f"""bdy AS (SELECT p_partkey, '35=W' || chr(1) || coalesce('55=' || p_name || chr(1), '') || '48=' || p_partkey || chr(1) || CASE WHEN p_partkey % 2 = 0 THEN '15=é' || chr(1) ELSE '' END AS b FROM part),
  whl AS (SELECT p_partkey, '8=FIX.4.4' || chr(1) || '9=' || strlen(b) || chr(1) || b AS w FROM bdy), msg AS (SELECT p_partkey, w || '10=' || {bytes_sum('w')} || chr(1) AS message FROM whl)"""
TURNS = "trn AS (SELECT conv_id * 1000 + turn AS news_id, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY ALL)"

ORACLE_SQL = {
    "trade_time": f"WITH {EV} SELECT seq, CASE WHEN seq % 5 > 0 THEN second - 1 ELSE second END AS time FROM ev",
    "last_price": f"""WITH {TRD}{CLEANED}, {bars_sql('ev', 3600)}, t AS (SELECT security_id, arg_max(price, seq) AS price, arg_max(qty, seq) AS qty, max(seq) AS seq FROM cln WHERE security_id % 3 = 0 GROUP BY ALL),
      c AS (SELECT security_id, arg_max(close, time) AS close FROM bars GROUP BY ALL) SELECT coalesce(t.security_id, c.security_id) AS security_id, coalesce(price, close) AS price, coalesce(qty, 0) AS qty, seq FROM t FULL JOIN c ON t.security_id = c.security_id""",
    "candles_vwap": f"""WITH {EV}, v AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'view' THEN price END IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), price) AS vwap FROM ev), {bars_sql('v', 3600)},
      a AS (SELECT security_id, time, arg_max(vwap, seq) AS avg FROM bars_l WHERE high_time IS NULL OR time >= high_time GROUP BY ALL) SELECT bars.* EXCLUDE (avg), a.avg FROM bars JOIN a USING (security_id, time)""",
    "forward_trades": f"WITH {EV}, f AS (SELECT * FROM ev WHERE kind IN ('purchase', 'click')), {bars_sql('f', 3600)} SELECT * FROM bars",
    "execution_summary": f"WITH {EV} SELECT security_id, price AS last_price, qty AS fill_qty, second AS time FROM ev WHERE kind = 'purchase'",
    "candles_display": f"{ALL_BARS}, {filled_sql('bars', 3600, 600)} SELECT * REPLACE (CASE WHEN volume = 0 THEN close ELSE avg END AS avg) FROM filled",
    "last_wide_candle": f"""{ALL_BARS}, w AS (SELECT *, time - time % 14400 AS wide FROM bars), l AS (SELECT * FROM w QUALIFY wide = max(wide) OVER (PARTITION BY security_id))
      SELECT security_id, wide AS time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, CAST(sum(volume) AS BIGINT) AS volume,
      CAST(CASE WHEN sum(volume) > 0 THEN sum(avg * volume) // sum(volume) ELSE arg_max(close, time) END AS BIGINT) AS avg FROM l GROUP BY ALL""",
    "candle_at": f"{ALL_BARS} SELECT ev.seq, ev.security_id, time, close FROM ev JOIN bars ON bars.security_id = ev.security_id AND time = second - second % 3600 WHERE kind = 'error'",
    "instrument_last_trade": f"WITH {TRD}, l AS (SELECT security_id, arg_max(price, seq) AS last_price, arg_max(qty, seq) AS last_qty FROM trd GROUP BY ALL) SELECT p_partkey AS security_id, p_name AS symbol, last_price, last_qty FROM part LEFT JOIN l ON l.security_id = p_partkey",
    "identity_wipe": f"""WITH {DEFS}, c AS (SELECT *, row_number() OVER w > 1 AND status IS DISTINCT FROM lag(status) OVER w AS changed FROM def WINDOW w AS (PARTITION BY security_id ORDER BY seq)),
      g AS (SELECT security_id, max(seq) FILTER (changed) AS since FROM c GROUP BY ALL) SELECT security_id, count(*) AS n, min(seq) AS first_seq FROM def JOIN g USING (security_id) WHERE since IS NULL OR seq > since GROUP BY ALL""",
    "group_members": """WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), m AS (SELECT l_orderkey, l_partkey % 5 AS number, l_linenumber AS line FROM lineitem WHERE l_partkey % 5 <> 0) SELECT l_orderkey, number, line FROM o LEFT JOIN m USING (l_orderkey)""",
    "effective_status": f"""WITH {EV}, own AS (SELECT seq, security_id, qty % 4 AS status, CASE qty % 7 WHEN 0 THEN 101 WHEN 1 THEN 102 ELSE 0 END AS event FROM ev WHERE kind IN ('signup', 'error')),
      ph AS (SELECT security_id % 10 AS g, max(seq) AS pseq, arg_max(seq % 9, seq) AS phase FROM ev WHERE kind = 'click' AND seq % 50 = 0 GROUP BY ALL),
      st AS (SELECT security_id, arg_max(event, seq) FILTER (event IN (101, 102)) AS way, max(seq) FILTER (event <> 102) AS oseq, arg_max(status, seq) FILTER (event <> 102) AS ostatus, max(seq) FILTER (event = 102) AS rejoined FROM own GROUP BY ALL)
      SELECT m.security_id, CASE WHEN coalesce(way = 101, FALSE) THEN ostatus WHEN phase IS NOT NULL AND (oseq IS NULL OR greatest(pseq, rejoined) > oseq) THEN phase ELSE ostatus END AS status, coalesce(way = 101, FALSE) AS detached
      FROM (SELECT DISTINCT security_id FROM ev) m LEFT JOIN ph ON g = m.security_id % 10 LEFT JOIN st ON st.security_id = m.security_id""",
    "quantity_band_change": changed_sql("CASE WHEN qty % 9 > 0 THEN qty // 40 END AS average, qty % 2 AS most", ("average", "most")),
    "imbalance_change": changed_sql("qty // 30 AS size, seq % 2 AS condition", ("size", "condition")),
    "instrument_lookup": "SELECT c_custkey, upper(c_name) AS symbol FROM customer WHERE upper(c_name) = upper(trim('  customer#000000007 '))",
    "news_in_time": "WITH p AS (SELECT conv_id AS news_id, turn * 1700 AS ms FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), f AS (SELECT *, min(ms) OVER (PARTITION BY news_id) AS f FROM p) SELECT news_id, count(*) AS parts FROM f WHERE ms - f <= 5000 GROUP BY ALL",
    "delisted": f"WITH {EV}, {SUB} SELECT client_id, security_id, flags FROM sub ANTI JOIN ev USING (security_id)",
    "instrument_projections": """WITH p AS (SELECT p_partkey AS security_id, CASE WHEN p_size % 2 > 0 THEN p_name END AS n, CASE WHEN p_size % 3 > 0 THEN p_brand END AS b, CASE WHEN p_size % 5 > 0 THEN p_type END AS t, CASE WHEN p_size % 7 > 0 THEN p_retailprice END AS r FROM part)
      SELECT security_id, CAST(CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN b IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN t IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN r IS NOT NULL THEN 8 ELSE 0 END AS BIGINT) AS mask, n AS symbol, b AS security_group,
      CAST(floor(r) AS BIGINT) * 90 AS low_limit, CAST(floor(r) AS BIGINT) * 110 AS high_limit, CASE WHEN t IS NOT NULL THEN CASE security_id % 3 WHEN 0 THEN 'sellers' WHEN 1 THEN 'balanced' ELSE 'buyers' END END AS imbalance FROM p""",
    "admin_status": f"WITH {EV} SELECT security_id, arg_max(qty % 20, seq) AS admin_status, max(seq) AS seq FROM ev WHERE seq % 9 IN (1, 2) GROUP BY ALL",
    "version_counters": f"""WITH {EV}, v AS (SELECT seq, security_id, qty % 3 AS a, CASE WHEN seq % 4 > 0 THEN qty % 2 END AS b, qty // 50 AS c FROM ev),
      x AS (SELECT *, row_number() OVER w = 1 OR a IS DISTINCT FROM lag(a) OVER w AS da, row_number() OVER w = 1 OR b IS DISTINCT FROM lag(b) OVER w AS db, row_number() OVER w = 1 OR c IS DISTINCT FROM lag(c) OVER w AS dc FROM v WINDOW w AS (PARTITION BY security_id ORDER BY seq))
      SELECT seq, count(*) FILTER (da) OVER w AS definition, count(*) FILTER (db) OVER w AS band, count(*) FILTER (dc) OVER w AS auction, count(*) FILTER (da OR db OR dc) OVER w AS any_version FROM x WINDOW w AS (PARTITION BY security_id ORDER BY seq)""",
    "stats_by_epoch": f"""WITH {EV}, r AS (SELECT *, seq // 400 AS epoch, (seq // 3) % 100 AS rpt_seq FROM ev)
      SELECT security_id, kind, price AS value, epoch, rpt_seq FROM r QUALIFY row_number() OVER (PARTITION BY security_id, kind ORDER BY epoch DESC, rpt_seq DESC, seq) = 1""",
    "group_health": f"WITH {PKT}, g AS (SELECT channel AS name, CASE WHEN count(*) % 2 = 0 THEN 'Recovering' ELSE 'Streaming' END AS state, max(ts) AS last FROM pkt GROUP BY ALL), w AS (SELECT *, CASE WHEN state <> 'Streaming' THEN 'state' WHEN 60000 - last > 5200 THEN 'quiet' END AS why FROM g) SELECT * FROM w WHERE why IS NOT NULL",
    "tier_conflation": f"WITH {ORD} SELECT seq // 1000 AS \"window\", security_id, side, arg_max(qty, seq) AS total_qty, 1 AS order_count FROM ord WHERE action IN ('new', 'change', 'delete') AND price IS NULL GROUP BY 1, 2, 3",
    "stale_flags": f"WITH {EV} SELECT seq // 1000 AS \"window\", security_id, arg_max(qty > 50, seq) AS stale, bool_or(qty > 50) AND NOT arg_max(qty > 50, seq) AS snapshot FROM ev GROUP BY 1, 2",
    "emission_order": f"""WITH {ORD}, k AS (SELECT seq, seq // 1000 AS w, CASE action WHEN 'mass_delete' THEN 'Clear' WHEN 'delete' THEN 'Level' WHEN 'trade' THEN 'Trade' ELSE CASE WHEN price IS NULL THEN 'Tier' ELSE 'Order' END END AS kind FROM ord)
      SELECT seq, w AS "window", kind, CAST(list_position(['Clear', 'Order', 'Tier', 'Trade', 'Candle', 'Stale', 'Level'], kind) - 1 AS INTEGER) AS emit_rank FROM k""",
    "anchored_windows": f"""WITH RECURSIVE {EV}, r AS (SELECT seq, security_id, second, row_number() OVER (PARTITION BY security_id ORDER BY seq) AS n FROM ev), w AS (
      SELECT *, second AS opened FROM r WHERE n = 1 UNION ALL SELECT r.*, CASE WHEN r.second - w.opened >= 7200 THEN r.second ELSE w.opened END FROM w JOIN r ON r.security_id = w.security_id AND r.n = w.n + 1)
      SELECT seq, security_id, second, opened FROM w""",
    "cadence_by_time": f"WITH {EV} SELECT ts_us // 250000 AS \"window\", security_id, kind, arg_max(price, seq) AS price, arg_max(qty, seq) AS qty, max(seq) AS seq FROM ev GROUP BY 1, 2, 3",
    "snapshot_at_cutoff": f"WITH {ORD}, cut AS (SELECT * FROM ord WHERE seq <= 5000){live_sql('cut')} SELECT * FROM live",
    "subscribe_validation": """WITH r AS (SELECT c_custkey AS client_id, CAST(c_custkey % 40 AS INTEGER) AS flags, [0, 50, 100, 250, 500][CAST(c_custkey % 5 AS INTEGER) + 1] AS interval FROM customer)
      SELECT *, flags BETWEEN 1 AND 31 AND interval <> 50 AS valid FROM r""",
    "snapshot_bundle": f"""WITH {TRD}{CLEANED}, {ORD.split("FROM events),", 1)[1].strip()}{live_sql('ord')}, {bars_sql('ev', 3600)}, {SUB},
      b AS (SELECT security_id, coalesce(max(price) FILTER (side = 'bid'), 0) AS bid_px, coalesce(min(price) FILTER (side = 'ask'), 0) AS ask_px FROM lev GROUP BY ALL),
      p AS (SELECT security_id, 1 AS part, CAST(json_object('ask_px', ask_px, 'bid_px', bid_px) AS VARCHAR) AS content FROM b
        UNION ALL SELECT security_id, 2, CAST(json_object('side', side, 'total_qty', CAST(sum(qty) AS BIGINT)) AS VARCHAR) FROM live WHERE price IS NULL GROUP BY security_id, side
        UNION ALL SELECT security_id, 4, CAST(json_object('close', arg_max(close, time), 'time', max(time)) AS VARCHAR) FROM bars GROUP BY security_id
        UNION ALL SELECT security_id, 8, CAST(json_object('price', arg_max(price, seq), 'qty', arg_max(qty, seq)) AS VARCHAR) FROM cln GROUP BY security_id)
      SELECT client_id, security_id, part, content FROM p JOIN sub USING (security_id) WHERE flags & part <> 0""",
    "news_fragments": f"""WITH {TURNS}, n AS (SELECT *, CAST(greatest(1, ceil(length(text) / 40.0)) AS INTEGER) AS part_count FROM trn), f AS (SELECT *, unnest(generate_series(1, part_count)) AS k FROM n)
      SELECT news_id, CAST(k AS INTEGER) AS part_number, part_count, substring(text, (k - 1) * 40 + 1, 40) AS text FROM f""",
    "news_rejoined": f"WITH {TURNS} SELECT news_id, md5(text) AS digest FROM trn WHERE length(text) <= 64 OR (length(text) <= 64 * 64 AND news_id <> 0)",
    "fix_encode": f"WITH {MESSAGES} SELECT p_partkey, message FROM msg",
    "fix_decode": f"""WITH {MESSAGES}, f AS (SELECT p_partkey, unnest(string_split(message, chr(1))) AS f FROM msg) SELECT p_partkey, TRUE AS intact, CAST(regexp_extract(f, '^([0-9]+)=', 1) AS INTEGER) AS tag, regexp_replace(f, '^[0-9]+=', '') AS value FROM f WHERE f <> ''""",
    "text_functions": """WITH t AS (SELECT *, p_name || CASE WHEN p_partkey % 3 = 0 THEN ', "é"' ELSE '' END AS n, make_timestamp(CAST(p_partkey * 86399123457 - 5000000000000 AS BIGINT)) AS ts FROM part)
      SELECT p_partkey, CASE WHEN regexp_matches(n, '[",\r\n]') THEN '"' || replace(n, '"', '""') || '"' ELSE n END AS field, strftime(ts, '%Y%m%d-%H:%M:%S.%g') AS stamp, CASE WHEN p_partkey % 4 > 0 THEN rtrim(substr(p_name, 1, 6)) END AS name FROM t""",
    "labels": """WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 13 > 0 THEN substr('EDROFMSXPCLY', CAST(p_partkey % 12 AS INTEGER) + 1, 1) || CASE WHEN p_partkey % 17 > 0 THEN substr('EDROFMSXPCLY', CAST((p_partkey // 12) % 12 AS INTEGER) + 1, 1) ELSE '' END END AS c FROM part),
      n AS (SELECT *, CASE left(c, 1) WHEN 'E' THEN 'Equity' WHEN 'D' THEN 'Debt' WHEN 'R' THEN 'Right/Warrant' WHEN 'O' THEN 'Option' WHEN 'F' THEN 'Future' WHEN 'M' THEN 'Others(Multileg)' WHEN 'S' THEN 'Swap' END AS cat,
        CASE substr(c, 2, 1) WHEN 'S' THEN 'Common/Ordinary' WHEN 'P' THEN 'Preferred' WHEN 'C' THEN 'Convertible' WHEN 'F' THEN 'Preference' WHEN 'L' THEN 'Limited Partnership' WHEN 'D' THEN 'Depositary Receipt' WHEN 'Y' THEN 'Structured Instrument' WHEN 'M' THEN 'Others' END AS grp FROM k)
      SELECT p_partkey, CASE WHEN length(c) >= 2 THEN CASE WHEN cat = 'Equity' AND grp IS NOT NULL THEN 'Equity / ' || grp ELSE coalesce(cat, c) END END AS cfi,
        CASE p_partkey % 4 WHEN 0 THEN 'Price Unit' WHEN 1 THEN 'Ticks' WHEN 2 THEN 'Percentage' ELSE '3' END AS limit_type, CASE p_partkey % 3 WHEN 1 THEN 'Buy' WHEN 2 THEN 'Sell' ELSE '0' END AS leg_side FROM n""",
    "bootstrap_stuck": f"WITH {EV}, f AS (SELECT kind, min(seq) AS f FROM ev GROUP BY ALL) SELECT kind AS channel, min(seq) AS ready FROM ev JOIN f USING (kind) WHERE seq - f >= 300 GROUP BY ALL",
}
