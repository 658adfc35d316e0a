"""Queries on feeds, recovery and books, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import analytics, book, episodes, intervals, jumps, recovery, sequence, trades
from tickloom.plans.market import EV, LIVE, NUM, ORD, STATUS, levels, live, live_sql, statuses
from tickloom.sources import capture, messages, numbered, order_events, table


#: Of heal_state: microseconds of being stale after which any snapshot is taken.
OVERDUE = 40_000_000_000


def operations(s, d):
    """Messages after losses; some are statistics and trades, some snapshots, a few empty or behind, and now and then a mark or a reset."""
    marker = F.when(F.pmod("seq", F.lit(901)) == 0, "reset").when(F.pmod("seq", F.lit(307)) == 0, "mark_stale").when(F.pmod("seq", F.lit(211)) == 0, "empty_snapshot").when(F.pmod("seq", F.lit(6)) == 0, "snapshot")
    op = F.coalesce(marker, F.when(F.col("kind") == "purchase", "statistic").when(F.col("kind") == "signup", "trade"), F.lit("book"))
    rows = numbered(s, d).withColumn("op", op)
    behind = F.when(F.col("op") == "snapshot", F.greatest(F.lit(0), F.col("rpt_seq") - F.pmod("seq", F.lit(5)))).when(op.isin("reset", "mark_stale", "empty_snapshot"), F.lit(None)).when(F.col("op") == "trade", F.col("rpt_seq") - F.pmod("seq", F.lit(3))).otherwise(F.col("rpt_seq"))
    return rows.withColumn("rpt_seq", behind)


def heals(s, d):
    return recovery.detailed(operations(s, d), timeout=OVERDUE)


def late_packets(s, d):
    """Messages as packets of eight channels, some late by up to 12 places, some lost, some twice."""
    rows = messages(s, d).withColumn("channel", F.pmod("security_id", F.lit(8)).cast("string"))
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("channel").orderBy("seq")).cast("bigint")).where("pmod(number * 7919, 500) > 0")
    late = rows.select("channel", (F.col("number") * 10 + F.pmod(F.col("number") * 31, F.lit(120))).alias("arrival"), F.col("number").alias("seq"), F.floor(F.col("number") / 4).alias("time"))
    again = late.where("pmod(seq, 97) = 0").withColumn("arrival", F.col("arrival") + 1)
    return late.unionByName(again)


def received(s, d):
    """Order events with report numbers, after losses."""
    rows = order_events(s, d).withColumn("rpt_seq", F.row_number().over(Window.partitionBy("security_id").orderBy("seq")).cast("bigint"))
    return rows, rows.where("pmod(seq * 7919, 100) >= 3")


def assembled(s, d):
    """A snapshot for each security and 1000 messages, of its new orders; some entries are lost."""
    entries = order_events(s, d).where("action = 'new' and side is not null").withColumn("snapshot", F.floor(F.col("seq") / 1000))
    headers = entries.groupBy("security_id", "snapshot").agg(F.count_if(F.expr("side = 'bid'")).alias("bids"), F.count_if(F.expr("side = 'ask'")).alias("asks"), F.max("seq").alias("rpt_seq"))
    return recovery.assemble(headers, entries.where("pmod(seq * 7919, 100) >= 3"))


def rebuilt(s, d):
    """Each security's snapshot stands at four fifths of its numbers."""
    every, got = received(s, d)
    cut = every.groupBy("security_id").agg(F.floor(F.count("*") * 4 / 5).alias("rpt_seq"))
    upto = every.join(cut.withColumnRenamed("rpt_seq", "cut"), "security_id").where("rpt_seq <= cut")
    orders = book.live_orders(upto).withColumn("snapshot", F.lit(1))
    return recovery.rebuild(cut.withColumn("snapshot", F.lit(1)), orders, got)


def unreconciled(s, d):
    every, got = received(s, d)
    full = book.live_orders(every).groupBy("security_id").agg(F.count_if(F.expr("side = 'bid'")).alias("bids"), F.count_if(F.expr("side = 'ask'")).alias("asks"))
    return recovery.disagreeing(full, book.live_orders(got))


def after_bootstrap(s, d):
    rows = messages(s, d).select("seq", F.col("kind").alias("channel"), "security_id")
    ready = sequence.bootstrap_ready(rows.withColumn("total", F.lit(40)), "channel", "security_id", "total")
    return sequence.after_bootstrap(rows, ready, "channel").groupBy("channel").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def quarantine(s, d):
    rows = sequence.quarantined(messages(s, d), {"kind": F.col("kind").isin("click", "view", "purchase", "error"), "price": F.col("price") >= 100_000, "quantity": F.when(F.pmod("seq", F.lit(50)) > 0, F.col("qty")) > 3})
    return rows.groupBy("quarantine").agg(F.count("*").alias("n"))


def crossings_by_phase(s, d):
    """Rising edges of crossed books by the status at that moment (null: unknown)."""
    edges = book.crossing_series(order_events(s, d)).where("state = 'crossed'").select("seq", "security_id", "state")
    return trades.as_of(edges, statuses(s, d), ["status"]).groupBy(F.when(F.col("status").isin(1, 3), "auction").when(F.col("status").isNotNull(), "open").alias("phase")).agg(F.count("*").alias("n"))


def after_reset(s, d):
    channel = F.pmod("security_id", F.lit(4)).alias("channel")
    resets = messages(s, d).where("kind = 'signup' and pmod(seq, 101) = 0").select("seq", channel)
    return book.live_orders(book.after_reset(order_events(s, d).withColumn("channel", channel), resets, "channel"))


def client_replica(s, d):
    return book.replica(order_events(s, d).withColumn("qty", F.col("qty") - 30))


def ladders(s, d):
    """The book's price levels against those that changes add up to at a client that lost some events."""
    return book.compare_ladders(levels(s, d), book.summed_levels(book.level_deltas(received(s, d)[1])))


def client_books(s, d):
    """What each customer sees of one book, at a message of its own."""
    events = order_events(s, d)
    bounds = events.agg((F.max("security_id") + 1).alias("securities"), (F.max("seq") + 1).alias("n"))  # one row
    clients = table(s, d, "customer").crossJoin(F.broadcast(bounds)).select(F.col("c_custkey").alias("client_id"), F.pmod(F.col("c_custkey") * 7, "securities").alias("security_id"), F.pmod(F.col("c_custkey") * 7919, "n").alias("cutoff"))
    return intervals.books_at(events, clients)


def snapshots_among(s, d):
    """Order events after losses; every tenth message is a snapshot instead, now and then a reset."""
    every, got = received(s, d)
    op = F.when(F.pmod("seq", F.lit(901)) == 0, "reset").when(F.pmod("seq", F.lit(10)) == 0, "snapshot").otherwise("book")
    rows = got.withColumn("op", op)
    return every, rows.withColumn("rpt_seq", F.when(F.col("op") == "snapshot", F.greatest(F.lit(0), F.col("rpt_seq") - F.pmod("seq", F.lit(3)))).otherwise(F.col("rpt_seq")))


def episode_books(s, d):
    """Snapshots hold the whole book at their number."""
    every, rows = snapshots_among(s, d)
    found = jumps.settled(episodes.episodes(rows))
    asked = found.select(F.col("healed_seq").alias("client_id"), "security_id", F.col("number").alias("cutoff"))
    orders = intervals.books_at(every.withColumn("seq", F.col("rpt_seq")), asked).withColumnRenamed("client_id", "healed_seq")
    return episodes.episode_books(found, orders, rows)


def merged(s, d):
    """Messages of each kind as a capture of two groups; some times go back."""
    back = F.when(F.pmod("seq", F.lit(17)) == 0, 90_000_000_000).otherwise(0)
    rows = messages(s, d).select(F.col("kind").alias("file"), F.col("seq").alias("n"), (F.floor(F.col("ts_us") / 60_000_000) * 60_000_000 - back).alias("ts_us"), F.col("kind").isin("click", "view").alias("orders"))
    return capture.merged_in_order(rows, "orders").select("file", "n", "replay_us", "position")


QUERIES = {
    "captures_merged": merged,
    "packet_invariants": lambda s, d: sequence.packet_invariants(numbered(s, d).select("seq", F.floor(F.col("seq") / 500).alias("packet"), "security_id", (F.col("rpt_seq") - F.pmod(F.col("seq") * 31, F.lit(4))).alias("rpt_seq")), "packet", "security_id", "rpt_seq"),
    "heaviest_securities": lambda s, d: analytics.heaviest(messages(s, d), "security_id", "kind"),
    "heal_episodes": lambda s, d: episodes.episodes(operations(s, d).where("op not in ('mark_stale', 'empty_snapshot')")),
    "episode_books": episode_books,
    "bbo_series": lambda s, d: intervals.best_prices(order_events(s, d)),
    "crossing_intervals": lambda s, d: intervals.crossings(order_events(s, d)),
    "client_books": client_books,
    "heal_state": heals,
    "heal_replays": lambda s, d: recovery.replayed(heals(s, d)),
    "bounded_reorder": lambda s, d: sequence.reordered(late_packets(s, d), 64, 2000),
    "snapshot_assembly": lambda s, d: assembled(s, d).select("security_id", "snapshot", "bids", "asks", "got_bids", "got_asks", "complete"),
    "snapshot_floor": lambda s, d: recovery.heal_floors(assembled(s, d)).select("security_id", "snapshot", "rpt_seq", "least", "usable"),
    "snapshot_versions": lambda s, d: sequence.current_epoch(messages(s, d).select("seq", "security_id", (F.floor(F.col("seq") / 700) + F.when(F.pmod("seq", F.lit(89)) == 0, -1).otherwise(1)).cast("bigint").alias("version")), "security_id", "version"),
    "snapshot_heal": lambda s, d: rebuilt(s, d)[0].select("security_id", "side", "order_id", "price", "qty"),
    "snapshot_stale": lambda s, d: rebuilt(s, d)[1],
    "snapshot_reconcile": unreconciled,
    "after_bootstrap": after_bootstrap,
    "quarantine": quarantine,
    "bbo_crossing": lambda s, d: book.crossing_series(order_events(s, d)),
    "crossing_by_phase": crossings_by_phase,
    "book_findings": lambda s, d: book.findings(live(s, d)),
    "book_after_reset": after_reset,
    "client_replica": client_replica,
    "level_deltas": lambda s, d: book.level_deltas(order_events(s, d)),
    "ladder_equivalence": ladders,
    "match_flags": lambda s, d: sequence.match_flags(messages(s, d), "security_id", "qty", 1, 8),
}

RCV = ORD + """, rcv0 AS (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY seq) AS rpt_seq FROM ord),
  rcv AS (SELECT * FROM rcv0 WHERE (seq * 7919) % 100 >= 3)"""
HOLES = RCV + """, stp AS (SELECT security_id, rpt_seq, coalesce(lag(rpt_seq) OVER (PARTITION BY security_id ORDER BY rpt_seq), 0) AS b FROM rcv),
  hol AS (SELECT security_id, coalesce(max(CASE WHEN rpt_seq - b > 1 THEN rpt_seq - 1 END), 0) AS lost, max(rpt_seq) AS high FROM stp GROUP BY ALL),
  cut AS (SELECT security_id, count(*) * 4 // 5 AS best FROM rcv0 GROUP BY ALL)"""
ASM = ORD + """, ent AS (SELECT *, seq // 1000 AS snapshot FROM ord WHERE action = 'new' AND side IS NOT NULL),
  asm AS (SELECT security_id, snapshot, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks, max(seq) AS rpt_seq,
    count(*) FILTER (side = 'bid' AND (seq * 7919) % 100 >= 3) AS got_bids, count(*) FILTER (side = 'ask' AND (seq * 7919) % 100 >= 3) AS got_asks, bids = got_bids AND asks = got_asks AS complete FROM ent GROUP BY 1, 2)"""
VERSIONS = """clr AS (SELECT security_id, seq, s.side FROM ord JOIN (VALUES ('bid'), ('ask')) AS s(side) ON coalesce(ord.side, s.side) = s.side WHERE action = 'mass_delete'),
  ver0 AS (SELECT *, lead(seq) OVER (PARTITION BY security_id, side, order_id ORDER BY seq) AS nxt FROM ord WHERE action IN ('new', 'change', 'delete')),
  ver AS (SELECT v.seq, v.security_id, v.side, v.order_id, v.price, v.qty, least(any_value(nxt), min(c.seq)) AS until FROM ver0 v
    LEFT JOIN clr c ON c.security_id = v.security_id AND c.side = v.side AND c.seq > v.seq WHERE action <> 'delete' AND price IS NOT NULL GROUP BY ALL)"""
CROSS = ORD + ", " + VERSIONS + """, bst AS (SELECT e.seq, e.security_id, max(CASE WHEN v.side = 'bid' THEN v.price END) AS bid_px, min(CASE WHEN v.side = 'ask' THEN v.price END) AS ask_px
    FROM ord e LEFT JOIN ver v ON v.security_id = e.security_id AND v.seq <= e.seq AND (until IS NULL OR until > e.seq) GROUP BY ALL),
  sta AS (SELECT *, CASE WHEN bid_px IS NULL OR ask_px IS NULL OR bid_px < ask_px THEN 'normal' WHEN bid_px = ask_px THEN 'locked' ELSE 'crossed' END AS state FROM bst),
  edg AS (SELECT * FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY security_id ORDER BY seq), 'normal') AS before FROM sta) WHERE state <> before)"""

#: The operations of heal_state.
OPERATIONS = """SELECT seq, security_id, op, ts_us AS t,
           CASE WHEN op IN ('reset', 'mark_stale', 'empty_snapshot') THEN NULL WHEN op = 'snapshot' THEN greatest(0, rpt_seq - seq % 5) WHEN op = 'trade' THEN rpt_seq - seq % 3 ELSE rpt_seq END AS x FROM (
    SELECT *, CASE WHEN seq % 901 = 0 THEN 'reset' WHEN seq % 307 = 0 THEN 'mark_stale' WHEN seq % 211 = 0 THEN 'empty_snapshot' WHEN seq % 6 = 0 THEN 'snapshot' WHEN kind = 'purchase' THEN 'statistic' WHEN kind = 'signup' THEN 'trade' ELSE 'book' END AS op FROM num)"""


def heals_sql(before: str, operations: str, overdue: int) -> str:
    """The state after each operation, one after another. steps: the security's row before, the operation, and what follows from both."""
    return before + f""", r AS (
    SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY seq) AS n FROM ({operations})
  ), st AS (
    SELECT security_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, '' AS op, CAST(NULL AS BIGINT) AS x, '' AS outcome, 'unknown' AS state, CAST(0 AS BIGINT) AS seen, CAST(0 AS BIGINT) AS book, CAST(0 AS BIGINT) AS top, CAST(0 AS BIGINT) AS least,
           CAST(NULL AS BIGINT) AS since, CAST(0 AS BIGINT) AS stat, CAST(0 AS BIGINT) AS trade, CAST(NULL AS BIGINT) AS drain_from, CAST(NULL AS BIGINT) AS drain_to, CAST(NULL AS BIGINT) AS unsafe, CAST(NULL AS BIGINT) AS tail FROM (SELECT DISTINCT security_id FROM r)
    UNION ALL
    SELECT security_id, n, seq, op, x,
           CASE WHEN op = 'reset' THEN 'reset' WHEN op = 'mark_stale' THEN 'marked' WHEN op IN ('snapshot', 'empty_snapshot') AND was = 'healthy' THEN 'skipped' WHEN op = 'empty_snapshot' THEN 'emptied'
                WHEN op = 'snapshot' THEN CASE WHEN heals THEN 'healed' WHEN forced THEN 'forced' ELSE 'rejected' END
                WHEN op = 'statistic' THEN CASE WHEN x > stat THEN 'applied' ELSE 'dropped' END WHEN op = 'trade' THEN CASE WHEN x > trade THEN 'applied' ELSE 'dropped' END
                WHEN x <= book THEN 'dropped' WHEN now = 'healthy' THEN 'applied' ELSE 'held' END,
           CASE WHEN op = 'reset' THEN 'unknown' WHEN op = 'mark_stale' AND was = 'healthy' THEN 'stale' WHEN heals OR forced OR empties THEN 'healthy' ELSE now END,
           CASE WHEN op = 'reset' THEN 0 WHEN empties THEN greatest(seen, top, least) WHEN carries OR heals THEN greatest(seen, x) ELSE seen END,
           CASE WHEN op = 'reset' THEN 0 WHEN empties THEN greatest(seen, top, least) WHEN heals THEN greatest(seen, x) WHEN forced THEN x WHEN op = 'book' AND now = 'healthy' THEN greatest(book, x) ELSE book END,
           CASE WHEN op = 'reset' THEN 0 WHEN empties THEN greatest(seen, top, least) WHEN heals THEN greatest(seen, x) WHEN forced THEN x WHEN op = 'book' THEN greatest(top, x) ELSE top END,
           CASE WHEN op = 'reset' OR heals OR forced OR empties THEN 0 WHEN op = 'mark_stale' AND was = 'healthy' THEN top WHEN skips THEN greatest(least, x - 1) ELSE least END,
           CASE WHEN op = 'reset' OR heals OR forced OR empties THEN NULL WHEN was = 'healthy' AND (op = 'mark_stale' OR skips) THEN t ELSE since END,
           CASE WHEN op = 'reset' THEN 0 WHEN op = 'statistic' THEN greatest(stat, x) ELSE stat END, CASE WHEN op = 'reset' THEN 0 WHEN op = 'trade' THEN greatest(trade, x) ELSE trade END,
           CASE WHEN heals AND seen > x THEN x + 1 END, CASE WHEN heals AND seen > x THEN seen END, CASE WHEN forced THEN least - x END, CASE WHEN forced THEN greatest(0, top - x) END
    FROM (SELECT *, CASE WHEN skips AND was = 'healthy' THEN 'stale' ELSE was END AS now, op = 'snapshot' AND was <> 'healthy' AND x >= least AS heals, op = 'empty_snapshot' AND was <> 'healthy' AS empties,
                 coalesce(op = 'snapshot' AND was = 'stale' AND x < least AND t - since > {overdue}, FALSE) AS forced
          FROM (SELECT r.*, st.state AS was, seen, book, top, least, since, stat, trade, r.op IN ('book', 'statistic', 'trade') AS carries, r.op IN ('book', 'statistic', 'trade') AND r.x - seen > 1 AS skips
                FROM st JOIN r ON r.security_id = st.security_id AND r.n = st.n + 1))
  )"""


HEALS = heals_sql(NUM, OPERATIONS, OVERDUE)
NEVER = 10**18
#: Healthy rows by the heal that they follow; what ends them is the next row of the same security that isn't healthy.
EPISODES = """, lif AS (SELECT *, CAST(count(*) FILTER (op = 'reset') OVER w AS BIGINT) AS resets, max(CASE WHEN outcome = 'healed' THEN seq END) OVER w AS healed_seq FROM st WHERE n > 0 WINDOW w AS (PARTITION BY security_id ORDER BY seq)),
  eps AS (SELECT security_id, any_value(resets) FILTER (state = 'healthy') AS resets, healed_seq, arg_min(x, seq) AS number, arg_min(seen, seq) AS high, arg_min({'seq': seq, 'op': op}, seq) FILTER (state <> 'healthy') AS l, arg_max(seen, seq) FILTER (state = 'healthy') AS last_number FROM lif WHERE healed_seq IS NOT NULL GROUP BY security_id, healed_seq)"""
AMONG = """SELECT seq, security_id, op, 0 AS t, CASE WHEN op = 'snapshot' THEN greatest(0, rpt_seq - seq % 3) ELSE rpt_seq END AS x FROM (
    SELECT *, CASE WHEN seq % 901 = 0 THEN 'reset' WHEN seq % 10 = 0 THEN 'snapshot' ELSE 'book' END AS op FROM rcv)"""

ORACLE_SQL = {
    "captures_merged": f"""WITH {EV}, r AS (SELECT kind AS file, seq AS n, ts_us // 60000000 * 60000000 - CASE WHEN seq % 17 = 0 THEN 90000000000 ELSE 0 END AS t, kind IN ('click', 'view') AS g FROM ev),
      m AS (SELECT file, n, t - min(t) OVER (PARTITION BY g) + min(t) OVER () AS replay_us FROM r), w AS (SELECT *, max(replay_us) OVER (PARTITION BY file ORDER BY n) AS due FROM m)
      SELECT file, n, replay_us, row_number() OVER (ORDER BY due, file, n) AS position FROM w""",
    "packet_invariants": f"""WITH {NUM}, p AS (SELECT seq, seq // 500 AS packet, security_id, rpt_seq - (seq * 31) % 4 AS x FROM num), b AS (SELECT *, lag(x) OVER (PARTITION BY packet, security_id ORDER BY seq) AS y FROM p)
      SELECT packet, count(*) AS n, count(*) FILTER (x <= y) AS back FROM b GROUP BY packet""",
    "heaviest_securities": f"""WITH {EV}, c AS (SELECT security_id, kind, count(*) AS "count" FROM ev GROUP BY ALL), t AS (SELECT security_id, CAST(sum("count") AS BIGINT) AS total FROM c GROUP BY ALL ORDER BY total DESC, security_id LIMIT 10)
      SELECT security_id, total, CAST(dense_rank() OVER (ORDER BY total DESC, security_id) AS INTEGER) AS rank, kind, "count", CAST(row_number() OVER (PARTITION BY security_id ORDER BY "count" DESC, kind) AS INTEGER) AS part_rank FROM c JOIN t USING (security_id) QUALIFY part_rank <= 8""",
    "heal_episodes": f"""WITH RECURSIVE {heals_sql(NUM, OPERATIONS + " WHERE op NOT IN ('mark_stale', 'empty_snapshot')", NEVER)}{EPISODES}
      SELECT security_id, resets, healed_seq, number, high, CASE WHEN l.op <> 'reset' THEN l.seq END AS lost_seq, last_number FROM eps""",
    # the whole feed's book at the episode's last number
    "episode_books": f"""WITH RECURSIVE {heals_sql(RCV, AMONG, NEVER)}{EPISODES},
      e AS (SELECT healed_seq, last_number, f.* FROM eps JOIN rcv0 f ON f.security_id = eps.security_id AND f.rpt_seq <= last_number),
      l AS (SELECT healed_seq, security_id, side, order_id, arg_max({{'seq': seq, 'action': action, 'price': price, 'qty': qty}}, seq) AS e FROM e WHERE action IN ('new', 'change', 'delete') GROUP BY ALL),
      m AS (SELECT healed_seq, s.side, max(seq) AS cleared FROM e JOIN (VALUES ('bid'), ('ask')) AS s(side) ON coalesce(e.side, s.side) = s.side WHERE action = 'mass_delete' GROUP BY ALL)
      SELECT security_id, l.healed_seq, l.side, order_id, e.price AS price, e.qty AS qty FROM l LEFT JOIN m ON m.healed_seq = l.healed_seq AND m.side = l.side WHERE e.action <> 'delete' AND (cleared IS NULL OR e.seq > cleared)""",
    "heal_state": f"WITH RECURSIVE {HEALS} SELECT seq, security_id, op, x AS rpt_seq, outcome, state, drain_from, drain_to, unsafe, tail FROM st WHERE n > 0",
    "heal_replays": f"""WITH RECURSIVE {HEALS}, e AS (SELECT * FROM st WHERE outcome IN ('healed', 'forced', 'emptied', 'reset')),
      h AS (SELECT st.seq, st.security_id, st.op, st.x, (SELECT min(e.seq) FROM e WHERE e.security_id = st.security_id AND e.seq > st.seq) AS healed_by FROM st WHERE outcome = 'held')
      SELECT min(h.seq) AS seq, h.security_id, arg_min(h.op, h.seq) AS op, h.x AS rpt_seq, healed_by FROM h JOIN e ON e.seq = healed_by AND e.security_id = h.security_id
      WHERE e.outcome = 'healed' AND h.x BETWEEN e.drain_from AND e.drain_to GROUP BY h.security_id, h.x, healed_by""",
    "snapshot_assembly": f"WITH {ASM} SELECT security_id, snapshot, bids, asks, got_bids, got_asks, complete FROM asm",
    "snapshot_floor": f"""WITH {ASM}, f AS (SELECT *, coalesce(max(CASE WHEN NOT complete THEN rpt_seq END) OVER (PARTITION BY security_id ORDER BY snapshot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS least FROM asm)
      SELECT security_id, snapshot, rpt_seq, least, complete AND rpt_seq >= least AS usable FROM f""",
    "snapshot_versions": f"""WITH {EV}, v AS (SELECT seq, security_id, seq // 700 + CASE WHEN seq % 89 = 0 THEN -1 ELSE 1 END AS version FROM ev), m AS (SELECT *, max(version) OVER (PARTITION BY security_id ORDER BY seq) AS epoch FROM v WHERE version > 0)
      SELECT * FROM m WHERE version = epoch""",
    "snapshot_heal": f"""WITH {HOLES}, kpt AS (SELECT e.* FROM rcv0 e JOIN hol h ON h.security_id = e.security_id JOIN cut c ON c.security_id = e.security_id WHERE best >= lost AND (rpt_seq <= best OR (seq * 7919) % 100 >= 3)){live_sql("kpt")}
      SELECT security_id, side, order_id, price, qty FROM live""",
    "snapshot_stale": f"WITH {HOLES} SELECT security_id, lost, best FROM hol JOIN cut USING (security_id) WHERE best < lost",
    "snapshot_reconcile": f"""WITH {RCV}{live_sql("ord")}{live_sql("rcv", "got", "gotlev")}, a AS (SELECT security_id, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks FROM live GROUP BY ALL),
      b AS (SELECT security_id, count(*) FILTER (side = 'bid') AS got_bids, count(*) FILTER (side = 'ask') AS got_asks FROM got GROUP BY ALL)
      SELECT security_id, bids, asks, coalesce(got_bids, 0) AS got_bids, coalesce(got_asks, 0) AS got_asks FROM a LEFT JOIN b USING (security_id) WHERE bids <> coalesce(got_bids, 0) OR asks <> coalesce(got_asks, 0)""",
    "after_bootstrap": f"""WITH {EV}, n AS (SELECT kind, min(seq) AS seq FROM ev GROUP BY kind, security_id), c AS (SELECT kind, seq, row_number() OVER (PARTITION BY kind ORDER BY seq) AS k FROM n), y AS (SELECT kind, min(seq) AS ready FROM c WHERE k >= 40 GROUP BY ALL)
      SELECT kind AS channel, count(*) AS n, min(seq) AS first_seq FROM ev JOIN y USING (kind) WHERE seq >= ready GROUP BY ALL""",
    "quarantine": f"""WITH {EV}, q AS (SELECT CASE WHEN kind NOT IN ('click', 'view', 'purchase', 'error') THEN 'kind' WHEN price < 100000 THEN 'price' WHEN seq % 50 = 0 OR qty <= 3 THEN 'quantity' END AS quarantine FROM ev)
      SELECT quarantine, count(*) AS n FROM q GROUP BY ALL""",
    "bbo_crossing": f"WITH {CROSS} SELECT seq, security_id, bid_px, ask_px, state FROM edg",
    "crossing_by_phase": f"""WITH {CROSS}{STATUS}, p AS (SELECT e.seq, (SELECT arg_max(status, s.seq) FROM sts s WHERE s.security_id = e.security_id AND s.seq <= e.seq) AS status FROM edg e WHERE state = 'crossed')
      SELECT CASE WHEN status IN (1, 3) THEN 'auction' WHEN status IS NOT NULL THEN 'open' END AS phase, count(*) AS n FROM p GROUP BY ALL""",
    "book_findings": f"""WITH {LIVE}, o AS (SELECT security_id, order_id, count(DISTINCT side) AS sides, count(*) FILTER (qty <= 0) AS empty, max(CASE WHEN side = 'bid' THEN price END) AS bid, min(CASE WHEN side = 'ask' THEN price END) AS ask FROM live GROUP BY ALL)
      SELECT security_id, CAST(sum(empty) AS BIGINT) AS empty, count(*) FILTER (sides > 1) AS both_sides, coalesce(max(bid) > min(ask), FALSE) AS crossed FROM o GROUP BY ALL""",
    "book_after_reset": f"""WITH {ORD}, rst AS (SELECT security_id % 4 AS channel, max(seq) AS r FROM ev WHERE kind = 'signup' AND seq % 101 = 0 GROUP BY ALL), kpt AS (SELECT ord.* FROM ord LEFT JOIN rst ON security_id % 4 = channel WHERE r IS NULL OR seq > r){live_sql("kpt")}
      SELECT * FROM live""",
    "client_replica": f"""WITH {ORD}, rep0 AS (SELECT * REPLACE (qty - 30 AS qty) FROM ord), rep1 AS (SELECT * REPLACE (CASE WHEN action = 'change' AND qty <= 0 THEN 'delete' ELSE action END AS action) FROM rep0){live_sql("rep1")} SELECT * FROM live""",
    "level_deltas": f"""WITH {ORD}, {VERSIONS} SELECT seq, security_id, side, price, qty, 1 AS orders FROM ver UNION ALL SELECT until, security_id, side, price, -qty, -1 FROM ver WHERE until IS NOT NULL""",
    "ladder_equivalence": f"""WITH {RCV}{live_sql("ord")}{live_sql("rcv", "got", "gotlev")}, a AS (SELECT security_id, lev.total_qty AS x, gotlev.total_qty AS y FROM lev FULL JOIN gotlev USING (security_id, side, price))
      SELECT security_id, count(*) FILTER (x = y) AS same, count(*) FILTER (x <> y) AS different, count(*) FILTER (x IS NULL OR y IS NULL) AS alone FROM a GROUP BY ALL""",
    "bbo_series": f"WITH {CROSS} SELECT seq, security_id, bid_px, ask_px FROM bst",
    "crossing_intervals": f"WITH {CROSS} SELECT seq, security_id, bid_px, ask_px, state FROM edg",
    "client_books": f"""WITH {ORD}, c AS (SELECT c_custkey AS client_id, (c_custkey * 7) % (SELECT max(security_id) + 1 FROM ord) AS security_id, (c_custkey * 7919) % (SELECT max(seq) + 1 FROM ord) AS cutoff FROM customer),
      e AS (SELECT client_id, cutoff, ord.* FROM c JOIN ord ON ord.security_id = c.security_id AND seq <= cutoff),
      l AS (SELECT client_id, security_id, side, order_id, arg_max({{'seq': seq, 'action': action, 'price': price, 'qty': qty}}, seq) AS e FROM e WHERE action IN ('new', 'change', 'delete') GROUP BY ALL),
      m AS (SELECT client_id, s.side, max(seq) AS cleared FROM e JOIN (VALUES ('bid'), ('ask')) AS s(side) ON coalesce(e.side, s.side) = s.side WHERE action = 'mass_delete' GROUP BY ALL)
      SELECT l.client_id, security_id, l.side, order_id, e.price AS price, e.qty AS qty FROM l LEFT JOIN m ON m.client_id = l.client_id AND m.side = l.side WHERE e.action <> 'delete' AND (cleared IS NULL OR e.seq > cleared)""",
    "match_flags": f"WITH {EV} SELECT security_id, count(*) FILTER (qty & 1 <> 0) AS ends, count(*) FILTER (qty & 8 <> 0) AS recovered FROM ev GROUP BY ALL",
}
