"""Healing as jumps from heal to heal: every episode of a security in which its book was whole, without a state that runs along it.

What is lost is seen from the numbers alone: a message that skips one above all numbers before it shows a hole that ends
below it. A snapshot is good if it reaches the last such hole. A heal by a good snapshot lasts until the first hole above
its number, and the next heal is the first good snapshot after that: so each good snapshot has one successor, whatever came
before it, and the heals that happen are those that the first one leads to (jumps.reached()).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import jumps, scan
from tickloom.operators.book import live_orders


def lives(rows: DataFrame, hot: int = scan.HOT) -> DataFrame:
    """rows (seq, security_id, op) with life: the security and how many resets it had; without the resets, and without rows that have no number or seq."""
    rows = scan.prefix(rows.where("seq is not null"), "security_id", ["seq"], {"resets": ("sum", F.when(F.col("op") == "reset", F.lit(1)).otherwise(0))}, hot=hot)
    return rows.where("(op is null or op <> 'reset') and rpt_seq is not null").withColumn("life", F.struct("security_id", "resets")).drop("resets")


def episodes(rows: DataFrame, hot: int = scan.HOT) -> DataFrame:
    """(security_id, resets, healed_seq, number, high, lost_seq, last_number) for each time that a security was whole, as recovery.detailed() finds them.

    rows (seq, security_id, op, rpt_seq): snapshots, resets, and messages of any other op, whose numbers all show losses.
    healed_seq is the seq of the snapshot that healed, number the last that it holds, high how far what was held goes on
    from it; lost_seq is the seq of the message that showed the next hole (null: none before the next reset or the end), and
    last_number the last number before it. After a reset all begins anew. Marks, empty snapshots and time limits are
    detailed()'s alone; a null op is a message. Rows without a number or seq take no part; no rows give none.
    """
    rows = lives(rows.select(F.col("seq").cast("long"), F.col("security_id"), "op", F.col("rpt_seq").cast("long")), hot)
    rows = rows.withColumn("message", ~F.coalesce(F.col("op") == "snapshot", F.lit(False)))
    own = F.when(F.col("message"), F.col("rpt_seq"))
    rows = scan.prefix(rows, "life", ["seq"], {"before": ("max", own)}, inclusive=False, hot=hot).withColumn("before", F.coalesce("before", F.lit(0)))
    rows = rows.withColumn("hole", F.col("message") & (F.col("rpt_seq") - F.col("before") > 1))
    rows = scan.prefix(rows, "life", ["seq"], {"least": ("last", F.when(F.col("hole"), F.col("rpt_seq") - 1))}, hot=hot)
    # read three times below: once from the shared folder is less than three scans
    rows = jumps.settled(rows.where("hole or not message").select("life", "seq", "rpt_seq", "before", "hole", F.coalesce("least", F.lit(0)).alias("least"), own.alias("own")).unionByName(ends(rows, own)))
    good = rows.where("not hole and seq is not null and rpt_seq >= least").select("life", "seq", F.col("rpt_seq").alias("number"), "before")
    holes = rows.where("hole").select("life", "seq", "rpt_seq", "before")
    # the heal after each hole, then the hole after each heal: the first that skips a number above the snapshot's, which all before the heal don't
    heals = jumps.first_after(holes, good.select("life", F.col("seq").alias("place"), F.col("seq").alias("value")), "life", "seq", "next", strict=True, hot=hot)
    losses = heals.select("life", F.col("rpt_seq").alias("place"), F.struct("seq", "before", "next").alias("value"))
    good = jumps.settled(jumps.first_after(good.withColumn("due", F.col("number") + 2), losses, "life", "due", "loss", hot=hot))
    roots = good.groupBy("life").agg(F.min("seq").alias("place"))
    found = jumps.reached(good.select("life", F.col("seq").alias("place"), F.col("loss.next").alias("to")), roots, "life")
    last = rows.where("seq is null").select(F.col("life").alias("of"), "own")
    happened = good.join(found.select(F.col("life").alias("at"), "place"), (F.col("seq") == F.col("place")) & F.col("life").eqNullSafe(F.col("at")), "left_semi")
    happened = happened.join(last, F.col("life").eqNullSafe(F.col("of")), "left")
    until = F.greatest("number", F.when(F.col("loss").isNotNull(), F.col("loss.before")).otherwise(F.coalesce("own", F.lit(0))))
    return happened.select("life.security_id", "life.resets", F.col("seq").alias("healed_seq"), "number", F.greatest("number", "before").alias("high"), F.col("loss.seq").alias("lost_seq"), until.alias("last_number"))


def ends(rows: DataFrame, own) -> DataFrame:
    """A row without a seq for each life: its highest number."""
    none = F.lit(None).cast("long")
    return rows.groupBy("life").agg(F.max(own).alias("own")).select("life", none.alias("seq"), none.alias("rpt_seq"), none.alias("before"), F.lit(False).alias("hole"), none.alias("least"), "own")


def episode_books(found: DataFrame, orders: DataFrame, rows: DataFrame, hot: int = scan.HOT) -> DataFrame:
    """(security_id, healed_seq, side, order_id, price, qty): the book of each of the episodes at its end.

    orders (healed_seq, security_id, side, order_id, price, qty): what the snapshots hold; rows: those of episodes(), with
    side, order_id, action, price and qty. The book is the snapshot's orders with the messages of the episode's numbers above
    the snapshot's, those that were held before it included; of messages with the same number the first counts.
    """
    spans = found.select(F.struct("security_id", "resets").alias("life"), F.col("number").alias("rpt_seq"), F.struct("healed_seq", "last_number").alias("episode"), F.lit(1).alias("turn"))
    columns = ("side", "order_id", "action", "price", "qty")
    own = lives(rows, hot).where("op is null or op <> 'snapshot'").select("life", "rpt_seq", "seq", *columns, F.lit(0).alias("turn"))
    # numbers of a life's episodes don't overlap; the last that begins below a number is its own, if it reaches it
    both = scan.prefix(own.unionByName(spans, allowMissingColumns=True), "life", ["rpt_seq", "turn"], {"of": ("last", F.col("episode"))}, hot=hot)
    inside = both.where("turn = 0 and rpt_seq <= of.last_number").groupBy("life", "of.healed_seq", "rpt_seq").agg(F.min_by(F.struct(*columns), "seq").alias("e"))
    book = F.struct(F.col("life.security_id").alias("security_id"), "healed_seq").alias("security_id")
    after = inside.select(F.col("rpt_seq").alias("seq"), book, "e.*")
    start = found.select("security_id", "healed_seq", "number")
    base = orders.join(start.withColumnRenamed("security_id", "own"), "healed_seq").where(F.col("own").eqNullSafe(F.col("security_id")))
    base = base.select(F.col("number").alias("seq"), F.struct("security_id", "healed_seq").alias("security_id"), "side", "order_id", F.lit("new").alias("action"), "price", "qty")
    live = live_orders(base.unionByName(after))
    return live.select("security_id.security_id", "security_id.healed_seq", "side", "order_id", "price", "qty")
