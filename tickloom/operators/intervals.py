"""Intervals of whole numbers by dyadic pieces: what lives at a moment is found by equal keys, not by comparing all pairs.

An interval [low, high) is the union of at most two pieces of each level (2 ** level numbers that begin at a multiple of
that), and a moment lies in one piece of each level. So an interval and a moment in it share exactly one piece: a join on
(level, piece) gives each such pair once, and an aggregate by pieces answers a question for all moments at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import scan
from tickloom.operators.book import KEY


def levels_for(most: int) -> int:
    """The highest level of numbers up to most."""
    return max(1, int(most).bit_length())


def pieces(rows: DataFrame, low: str, high: str, levels: int) -> DataFrame:
    """rows, each for every piece (level, piece) of [low, high)."""
    size = lambda level: F.call_function("shiftleft", F.lit(1).cast("long"), level)
    first = lambda level: F.call_function("shiftright", F.col(low) + size(level) - 1, level)
    last = lambda level: F.call_function("shiftright", F.col(high), level)
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
    left = lambda level: F.when((first(level) < last(level)) & odd(first(level)), F.struct(level.alias("level"), first(level).alias("piece")))
    right = lambda level: F.when((first(level) < last(level)) & odd(last(level)), F.struct(level.alias("level"), (last(level) - 1).alias("piece")))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.array_compact(F.array(left(level), right(level)))))
    return rows.withColumn("__p", F.explode(every)).withColumns({"level": F.col("__p.level"), "piece": F.col("__p.piece")}).drop("__p")


def moments(rows: DataFrame, at: str, levels: int) -> DataFrame:
    """rows, each for the piece of every level that holds the moment."""
    return rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("piece", F.call_function("shiftright", F.col(at), F.col("level")))


def meet(points: DataFrame, cut: DataFrame) -> DataFrame:
    """moments() of books joined to pieces() of the same books. Never by a broadcast: an estimate of rows doesn't know how often they were exploded, so one of some MB can be of hundreds."""
    return points.hint("merge").join(cut, ["security_id", "level", "piece"])


def versions(events: DataFrame) -> DataFrame:
    """(seq, security_id, side, order_id, price, qty, until): what each event makes of its order, until (null: never) the order's next event or the next clear of its side."""
    rows = events.where("action in ('new', 'change', 'delete', 'mass_delete')")
    rows = rows.withColumn("side", F.explode(F.when(F.col("side").isin("bid", "ask"), F.array("side")).otherwise(F.array(F.lit("bid"), F.lit("ask")))))
    # backwards: the nearest clear that comes later
    rows = rows.withColumns({"__book": F.struct("security_id", "side"), "__back": -F.col("seq")})
    rows = scan.prefix(rows, "__book", ["__back"], {"clear": ("last", F.when(F.col("action") == "mass_delete", F.col("seq")))}, inclusive=False)
    rows = rows.where("action <> 'mass_delete'")
    rows = rows.withColumn("until", F.least("clear", F.lead("seq").over(Window.partitionBy(*KEY).orderBy("seq")))).where("action <> 'delete'")
    return rows.select("seq", *KEY, "price", "qty", "until")


def last_of(events: DataFrame) -> int:
    return events.agg(F.max("seq")).first()[0] or 0


def placed(events: DataFrame) -> DataFrame:
    """events with place: how many events of the book come before (events of the same seq share it)."""
    rows = scan.prefix(events, "security_id", ["seq"], {"place": ("sum", F.lit(1).cast("long"))}, inclusive=False)
    return rows.withColumn("place", F.min(F.coalesce("place", F.lit(0).cast("long"))).over(Window.partitionBy("security_id", "seq")))


def best_prices(events: DataFrame) -> DataFrame:
    """(seq, security_id, bid_px, ask_px) after every event: the highest live bid and the lowest live ask, null without one.

    Orders' prices go to the pieces of their lives, where only the best of each side stays; an event looks at the pieces that
    hold it. Time is the place in the book, so levels are as many as the longest book needs, not the feed. Past places, nothing
    runs along a book, so a busy book is many tasks, and a mass delete costs what it ends.
    """
    end = events.groupBy("security_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = levels_for(end)
    rows = placed(events)
    lives = versions(rows.withColumn("seq", F.col("place"))).where("price is not null").withColumn("until", F.coalesce("until", F.lit(end)))
    rank = F.when(F.col("side") == "bid", F.col("price")).otherwise(-F.col("price"))  # the best is the largest
    best = pieces(lives, "seq", "until", levels).groupBy("security_id", "level", "piece").agg(*(F.max(F.when(F.col("side") == side, rank)).alias(side) for side in ("bid", "ask")))
    points = meet(moments(rows.select("seq", "security_id", "place"), "place", levels), best)
    none = F.lit(None).cast("long")
    every = points.select("seq", "security_id", "bid", "ask").unionByName(events.select("seq", "security_id", none.alias("bid"), none.alias("ask")))
    return every.groupBy("seq", "security_id").agg(F.max("bid").alias("bid_px"), (-F.max("ask")).alias("ask_px"))


def crossings(events: DataFrame) -> DataFrame:
    """As book.crossing_series(), from best_prices(): each change of a book's state (crossed, locked or normal)."""
    locked, crossed = F.col("bid_px") == F.col("ask_px"), F.col("bid_px") > F.col("ask_px")
    rows = best_prices(events).withColumn("state", F.when(crossed, "crossed").when(locked, "locked").otherwise("normal"))
    rows = scan.prefix(rows, "security_id", ["seq"], {"before": ("last", F.col("state"))}, inclusive=False, like=events)
    return rows.where(F.col("state") != F.coalesce("before", F.lit("normal"))).drop("before")


def books_at(events: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The live orders that each client (client_id, security_id, cutoff) sees at its own cutoff, events up to which are in: client_id, security_id, side, order_id, price, qty."""
    end = max(last_of(events), cutoffs.agg(F.max("cutoff")).first()[0] or 0)
    levels = levels_for(end + 1)
    lives = pieces(versions(events).withColumn("until", F.coalesce("until", F.lit(end + 1))), "seq", "until", levels)
    asked = moments(cutoffs.where("cutoff >= 0").select("client_id", "security_id", "cutoff"), "cutoff", levels)
    return meet(asked, lives).select("client_id", *KEY, "price", "qty")
