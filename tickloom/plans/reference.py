"""Queries on instruments, definitions, news, rankings and monitors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import functions as fx
from tickloom.operators import analytics, instruments
from tickloom.sources import table


def definitions(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("security_id"), F.col("o_orderkey").alias("seq"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("validity"), F.col("o_orderstatus").alias("status"))


def identity(s, d):
    found = instruments.generations(definitions(s, d), "security_id", ["status"], "seq")
    return found.groupBy("security_id").agg(F.max("generation").alias("generations"))


def members(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("security_id"), F.col("p_brand").alias("security_group"))


def phase_rows(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("security_group"), F.pmod("p_size", F.lit(4)).alias("status"))


def traded_phases(s, d):
    """Trades with the phase of their part's group."""
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("security_id"))
    return instruments.phase_at(rows, members(s, d), phase_rows(s, d).withColumn("seq", F.col("seq") * 3))


def registry(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("security_id"), F.concat(F.lit("sym"), F.pmod("o_orderkey", F.lit(400)).cast("string")).alias("symbol"))
    return instruments.symbol_registry(rows)


def news(s, d):
    turns = table(s, d, "conversations").where("conv_id is not null and turn is not null and text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    count = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("part_count"))
    parts = turns.join(count, "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), (F.col("conv_id") + 1).alias("news_id"), (F.col("turn") + 1).alias("part_number"), "part_count", "text")
    return instruments.reassemble_news(parts).select("news_id", "parts", F.md5("text").alias("digest"))


def volumes(s, d):
    sums = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("security_id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))
    return sums.join(table(s, d, "part").select(F.col("p_partkey").alias("security_id"), F.col("p_name").alias("symbol")), "security_id")


def net_changes(s, d):
    value = F.floor(F.col("c_acctbal") * 100).cast("bigint")
    return table(s, d, "customer").select(F.col("c_custkey").alias("security_id"), F.col("c_name").alias("symbol"), value.alias("value"))


def clients(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("client_id"), F.floor(F.abs("c_acctbal")).cast("bigint").alias("pending_bytes"))


def bands(s, d):
    rows = table(s, d, "part").select(F.col("p_partkey").alias("security_id"), F.pmod("p_partkey", F.lit(3)).cast("int").alias("kind"), (F.pmod(F.col("p_partkey") * 37, F.lit(400)) - 200).cast("bigint").alias("l"), (F.floor(F.col("p_retailprice")) * 100000000).cast("bigint").alias("reference"))
    return rows.select("security_id", fx.effective_band(F.col("kind"), F.col("l") * 10000, F.col("reference"), F.lit(1000000)).alias("limit"))


def baselines(s, d):
    """Lines 1 to 3 of orders are the baseline, later lines the run, which brought nothing of one supplier in seventeen."""
    first = table(s, d, "lineitem").where("l_linenumber <= 3").groupBy("l_suppkey").agg(F.count("*").alias("mean"))
    now = table(s, d, "lineitem").where("l_linenumber > 3 and pmod(l_suppkey * 31, 17) > 0").groupBy("l_suppkey").agg(F.count("*").alias("mean"))
    return analytics.compare_baselines(first, now, ["l_suppkey"], "mean", 10.0).select("l_suppkey", "mean", "verdict")


def totals(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("security_id")).agg(F.sum(F.floor(F.col("l_extendedprice")).cast("bigint")).alias("amount"), F.sum(F.col("l_quantity").cast("bigint")).alias("volume"), F.count("*").alias("trades"))


def recent_events(s, d, limit: int = 50):
    """The newest events, 1 to 1000 of them."""
    return table(s, d, "events").select("event_id", "event_type", "user_id").orderBy(F.desc("event_id")).limit(min(max(limit, 1), 1000))


def checksums(s, d):
    message = F.concat_ws("|", F.concat(F.lit("35=W|55=é"), F.col("p_name")), F.concat(F.lit("48="), F.col("p_partkey").cast("string")))
    return table(s, d, "part").select("p_partkey", fx.tag_value_checksum(message).alias("checksum"))


def scalars(s, d):
    key = F.col("p_partkey")
    return table(s, d, "part").select(
        "p_partkey", fx.floor_bucket(key - 50, 7).alias("bucket"), fx.has_flag(key, 4).alias("flag"), fx.from_mantissa(key).alias("price"), fx.price_places(F.when(F.pmod(key, F.lit(2)) == 0, F.lit(100)).otherwise(key)).alias("places"), fx.imbalance_side(F.pmod(key, F.lit(3)) - 1).alias("side")
    )


QUERIES = {
    "definition_scd1": lambda s, d: instruments.latest_definitions(definitions(s, d), "security_id", "validity", "seq"),
    "identity_change": identity,
    "phase_intervals": lambda s, d: instruments.phase_intervals(phase_rows(s, d)),
    "phase_of_trades": traded_phases,
    "group_phase": lambda s, d: instruments.group_phases(phase_rows(s, d), members(s, d)),
    "symbol_search": lambda s, d: instruments.search_symbols(table(s, d, "customer").select("c_custkey", "c_name"), "c_name", "CUSTOMER#0000000", 20),
    "symbol_registry": registry,
    "effective_bands": bands,
    "news_reassemble": news,
    "rank_volume": lambda s, d: analytics.ranking(volumes(s, d), "value"),
    "rank_gainers": lambda s, d: analytics.ranking(net_changes(s, d), "value"),
    "rank_losers": lambda s, d: analytics.ranking(net_changes(s, d), "value", descending=False),
    "outliers_median": lambda s, d: analytics.slow_clients(clients(s, d), 1_000_000, 0.5, 1, 9000),
    "baseline_compare": baselines,
    "market_totals": totals,
    "recent_events": recent_events,
    "frame_stats": lambda s, d: table(s, d, "conversations").groupBy("role").agg(F.count("*").alias("frames"), F.sum(F.octet_length("text")).alias("bytes")),
    "fix_checksum": checksums,
    "scalar_functions": scalars,
}

RANKED = "SELECT security_id, symbol, value, row_number() OVER (ORDER BY value {o}, security_id) AS rank FROM v WHERE value {c} 0 ORDER BY value {o}, security_id LIMIT 10"
NET = "WITH v AS (SELECT c_custkey AS security_id, c_name AS symbol, CAST(floor(c_acctbal * 100) AS BIGINT) AS value FROM customer)"
DEF = "WITH def AS (SELECT o_custkey AS security_id, o_orderkey AS seq, epoch_us(o_orderdate) AS validity, o_orderstatus AS status FROM orders)"

ORACLE_SQL = {
    "definition_scd1": f"""{DEF}, b AS (SELECT *, max(validity) OVER (PARTITION BY security_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM def)
      SELECT security_id, seq, validity, status FROM b WHERE before IS NULL OR validity > before QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY seq DESC) = 1""",
    "identity_change": f"""{DEF}, c AS (SELECT security_id, row_number() OVER w > 1 AND status IS DISTINCT FROM lag(status) OVER w AS changed FROM def WINDOW w AS (PARTITION BY security_id ORDER BY seq))
      SELECT security_id, count(*) FILTER (changed) AS generations FROM c GROUP BY ALL""",
    "phase_intervals": """WITH p AS (SELECT p_partkey AS seq, p_brand AS security_group, p_size % 4 AS status, lag(p_size % 4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS l FROM part)
      SELECT security_group, status, seq AS since, lead(seq) OVER (PARTITION BY security_group ORDER BY seq) AS until FROM p WHERE l IS NULL OR l <> status""",
    "phase_of_trades": """WITH p AS (SELECT p_partkey * 3 AS seq, p_brand AS security_group, p_size % 4 AS status FROM part), t AS (SELECT l_orderkey AS seq, l_linenumber AS line, l_partkey AS security_id, p_brand AS security_group FROM lineitem JOIN part ON p_partkey = l_partkey)
      SELECT t.*, p.status FROM t ASOF LEFT JOIN p ON p.security_group = t.security_group AND t.seq >= p.seq""",
    "group_phase": """WITH p AS (SELECT p_partkey AS seq, p_brand AS security_group, p_size % 4 AS status, lag(p_size % 4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS l FROM part)
      SELECT p.security_group, p.seq, p.status, m.p_partkey AS security_id FROM p JOIN part m ON m.p_brand = p.security_group WHERE l IS NULL OR l <> status""",
    "symbol_search": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer#0000000') ORDER BY c_name LIMIT 20",
    "symbol_registry": """WITH l AS (SELECT o_custkey AS security_id, 'SYM' || CAST(o_orderkey % 400 AS VARCHAR) AS symbol, o_orderkey AS seq FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
      SELECT security_id, symbol FROM l QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1""",
    "effective_bands": """WITH p AS (SELECT p_partkey AS security_id, p_partkey % 3 AS kind, ((p_partkey * 37) % 400 - 200) AS l, CAST(floor(p_retailprice) AS BIGINT) AS r FROM part)
      SELECT security_id, CAST(CASE kind WHEN 0 THEN l * 10000 WHEN 1 THEN r * 10000 + l * 100 ELSE r * 10000 + r * l * 100 END AS BIGINT) AS "limit" FROM p""",
    "news_reassemble": """WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
      SELECT conv_id + 1 AS news_id, count(*) AS parts, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM t GROUP BY ALL HAVING count(*) = max(turn) + 1 AND min(turn) = 0 AND count(*) <= 64""",
    "rank_volume": "WITH v AS (SELECT l_partkey AS security_id, any_value(p_name) AS symbol, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey) " + RANKED.format(o="DESC", c=">"),
    "rank_gainers": f"{NET} " + RANKED.format(o="DESC", c=">"),
    "rank_losers": f"{NET} " + RANKED.format(o="ASC", c="<"),
    "outliers_median": """WITH c AS (SELECT c_custkey AS client_id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS pending_bytes FROM customer), m AS (SELECT sum(pending_bytes) AS total, CAST(floor(quantile_cont(pending_bytes, 0.5)) AS BIGINT) AS median FROM c)
      SELECT client_id, pending_bytes, median FROM c, m WHERE total >= 500000 AND pending_bytes > greatest(median, 9000)""",
    "baseline_compare": """WITH b AS (SELECT l_suppkey, count(*) AS mean FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), n AS (SELECT l_suppkey, count(*) AS now FROM lineitem WHERE l_linenumber > 3 AND (l_suppkey * 31) % 17 > 0 GROUP BY ALL)
      SELECT l_suppkey, mean, CASE WHEN now IS NULL THEN 'MISSING' WHEN (now - mean) * 100.0 / mean > 10 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM b LEFT JOIN n USING (l_suppkey)""",
    "market_totals": "SELECT l_partkey AS security_id, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS amount, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, count(*) AS trades FROM lineitem GROUP BY ALL",
    "recent_events": "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 50",
    "frame_stats": "SELECT role, count(*) AS frames, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY ALL",
    "fix_checksum": """WITH m AS (SELECT p_partkey, '35=W|55=é' || p_name || '|48=' || CAST(p_partkey AS VARCHAR) AS t FROM part)
      SELECT p_partkey, lpad(CAST(list_sum(list_transform(range(strlen(t)), lambda i: CAST('0x' || substr(hex(encode(t)), 2 * i + 1, 2) AS INTEGER))) % 256 AS VARCHAR), 3, '0') AS checksum FROM m""",
    "scalar_functions": """SELECT p_partkey, CAST((p_partkey - 50) - ((((p_partkey - 50) % 7) + 7) % 7) AS BIGINT) AS bucket, p_partkey & 4 <> 0 AS flag, CAST(p_partkey AS DECIMAL(19, 0)) / 10000 AS price,
      CASE WHEN p_partkey % 2 = 0 THEN 2 WHEN p_partkey = 1 THEN 0 ELSE 4 END AS places, CASE p_partkey % 3 WHEN 0 THEN 'sellers' WHEN 1 THEN 'balanced' ELSE 'buyers' END AS side FROM part""",
}
