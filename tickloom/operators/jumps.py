"""Chains of events by pointer jumping: what depends on the event before, all along a key, in rounds whose number is the logarithm of the longest chain.

A step leads from a node to the one that follows if the node counts (the next window's opening, the next heal). Steps are
composed with themselves, so each round follows twice as many; what the nodes that count reach by them counts too. Nodes
are joined by (key, place), so a busy key is spread over all tasks, and no state runs along it.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import scan


def settled(df: DataFrame) -> DataFrame:
    """Runs df once and keeps its rows in the session's checkpoint folder (spark.checkpoint.dir); only a local master may have a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tickloom-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint()


def first_after(probes: DataFrame, points: DataFrame, key: str, at: str, into: str, strict: bool = False, hot: int = scan.HOT) -> DataFrame:
    """probes with into: the value of the first point (key, place, value) of their key at or after (strict: after) their at; null without one.

    One scan from the end over probes and points, so a busy key is cut as in scan.prefix(). Places of a key's points differ.
    """
    rows = points.select(F.col(key), F.col("place").alias(at), F.col("value").alias("__point"), F.lit(int(strict)).alias("__turn"))
    both = probes.withColumn("__turn", F.lit(int(not strict))).unionByName(rows, allowMissingColumns=True).withColumn("__back", -F.col(at))
    found = scan.prefix(both, key, ["__back", "__turn"], {into: ("last", F.col("__point"))}, hot=hot)
    return found.where(F.col("__turn") == int(not strict)).drop("__point", "__turn", "__back")


def reached(steps: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, place) of the roots (key, place) and of all that steps (key, place, to) lead to from them. Steps go forward, one from a place at most; keys may be null.

    Steps into a root aren't followed, so the rounds are those of the longest chain between two roots.
    """
    name = F.col(key)
    marked = settled(roots.select(name.alias("key"), F.col("place")).distinct())
    ends = marked.select(F.col("key").alias("end_key"), F.col("place").alias("end"))
    jumps = steps.where("to is not null").select(name.alias("key"), "place", "to")
    jumps = settled(jumps.join(ends, F.col("key").eqNullSafe(F.col("end_key")) & (F.col("to") == F.col("end")), "left_anti"))
    size = marked.count()
    while not jumps.isEmpty():
        then = jumps.select(F.col("key").alias("then_key"), F.col("place").alias("from"), F.col("to").alias("then"))
        new = marked.join(then, F.col("key").eqNullSafe(F.col("then_key")) & (F.col("place") == F.col("from"))).select("key", F.col("then").alias("place"))
        marked = settled(marked.unionByName(new).distinct())
        before, size = size, marked.count()
        if size == before:
            break
        jumps = settled(jumps.join(then, F.col("key").eqNullSafe(F.col("then_key")) & (F.col("to") == F.col("from"))).select("key", "place", F.col("then").alias("to")))
    return marked.withColumnRenamed("key", key)
