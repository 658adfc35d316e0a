"""Connected components of an edge table, by alternating large and small stars.

In a large star every node links its larger neighbours to the smallest node it knows; in a small star it links its
smaller neighbours and itself to it. Edges never grow in number, and after a logarithmic number of rounds each node
points at the smallest node of its component. Each round is two grouped joins, whose hot keys adaptive execution can
split; nothing is collected but a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import settle


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node on an edge (a, b); root is the smallest node of its component, itself included.

    Nodes are longs or strings. Edges may repeat, run both ways or join a node to itself; those with a null end are none.
    """
    kind = dict(edges.dtypes)["a"]
    nodes = edges.select("a", "b").where("a is not null and b is not null")
    now = settle(nodes.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        now = settle(small_star(large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").cast(kind), F.col("root").cast(kind))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()
