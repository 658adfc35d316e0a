"""Mixing sources to target weights by capped water-filling, and seeded repetitions that meet the targets.

All sources together get as many words as they have. Each source's share follows its weight, but stops at `epochs` times
its size; the excess goes to the others by weight, again and again until none is above. Each round is an aggregate of
the table of sources, of which three numbers reach the driver.

A source whose target is a whole number of repetitions and a part gets the whole ones for each document, and one more for
the documents that come first in a seeded order while they fit into the part, and for the one that then comes closest to
what is left of it. For that order documents are dealt by hash to
buckets in each source (4,096, or more if there are more than 4 million documents; which doesn't change the order); sums of the buckets' sizes place each bucket, and documents are ordered only inside one.
So neither the largest source nor any group is in one task, and sources are numbered by ranges of their names.

A null text has size 0, a null source is one of its own (and comes last). Rows that repeat a doc_id are documents of their
own; those that are equal in doc_id and text are neighbours in the order. An empty table gives an empty result. Columns
of docs that have the name of a result column are replaced (names gives others); all others stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, settle
from tickloom.llm.quality import words_of

RESULTS = ("size", "source_size", "target", "copies", "taken")
#: Documents that a bucket, one group of a window, aims for if all are of one source.
BUCKET = 1000


def targets(sources: DataFrame, epochs: int) -> DataFrame:
    """sources (key, source, source_size, weight) with target."""
    exact = "decimal(38,0)"
    size, weight = F.col("source_size").cast(exact), F.col("weight").cast(exact)
    total = sources.agg(F.sum(size)).first()[0] or 0
    capped, weights = 0, None
    while True:
        # clamped so far: those that the last round's level puts above their cap
        above = F.lit(False) if weights is None else F.lit(total - capped).cast(exact) * weight > F.lit(weights).cast(exact) * size * epochs
        row = sources.agg(F.sum(F.when(above, size * epochs)).alias("c"), F.sum(F.when(~above, weight)).alias("w")).first()
        now = (int(row["c"] or 0), int(row["w"] or 0))
        if now == (capped, weights) or not now[1]:
            break
        capped, weights = now
    level = F.lit(float(total - capped)) * F.col("weight").cast("double") / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(above, (F.col("source_size") * epochs).cast("double")).otherwise(level))


def cyclic(number: Column) -> Column:
    """Weights 1, 2, 3, 1, 2, 3, ... for the sources by name."""
    return F.pmod(number - 1, F.lit(3)) + 1


def mix_sources(docs: DataFrame, weight=cyclic, epochs: int = 3, seed: str = "mix", names: tuple[str, ...] = RESULTS) -> DataFrame:
    """docs with size (words), source_size, target (of the source), copies and taken (size * copies), under these or other names.

    weight: from a source's number by code point (from 1, null last) to its whole-numbered weight.
    """
    docs = docs.drop(*names)
    size, source_size, target, copies, taken = names
    key, order, bucket, before, start, whole, rest, last = fresh(docs.select("*", *(F.lit(0).alias(n) for n in names)), "key", "order", "bucket", "before", "start", "whole", "rest", "last")
    named = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-"))
    # rows with one doc_id, or none, are told apart by their texts, so that they don't share a bucket
    hashed = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    given = docs.columns
    docs = docs.withColumns({size: F.size(words_of(F.coalesce(F.col("text"), F.lit("")))).cast("long"), key: named, order: hashed})
    digits = max(3, math.ceil(math.log(max(1, docs.count() / BUCKET), 16)))
    docs = docs.withColumn(bucket, F.substring(order, 1, digits))

    buckets = settle(docs.groupBy(F.col(key).alias("key"), F.col(bucket).alias("bucket")).agg(F.max("source").alias("source"), F.sum(size).alias("sum")))
    sources = numbered(buckets.groupBy("key").agg(F.max("source").alias("source"), F.sum("sum").alias("source_size")))
    filled = targets(settle(sources.withColumn("weight", weight(F.col("number"))).drop("number")), epochs)
    filled = filled.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    filled = filled.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    placed = with_starts(buckets, digits).join(filled.drop("source", "weight"), "key")
    placed = placed.select(F.col("key").alias(key), F.col("bucket").alias(bucket), F.col("start").alias(start), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("whole").alias(whole), F.col("rest").alias(rest))

    inside = Window.partitionBy(key, bucket).orderBy(order, size).rowsBetween(Window.unboundedPreceding, -1)
    reaches = F.col(start) + F.coalesce(F.sum(size).over(inside), F.lit(0)) + F.col(size)
    # what is left of the part is filled by the one row that comes closest to it, if that is closer than none; of equal rows
    # the one that comes first, which its place in the order tells from the others
    light = docs.select(key, bucket, order, size).join(placed, [key, bucket]).withColumn(before, reaches)
    left = light.groupBy(key).agg((F.max(rest) - F.coalesce(F.sum(F.when(F.col(before) <= F.col(rest), F.col(size))), F.lit(0))).alias("left"))
    # joined by bucket, not to a source's documents in one place
    again = docs.select(key, bucket, order, size).join(placed.join(left, key), [key, bucket]).withColumn(before, reaches)
    others = again.where(F.col(before) > F.col(rest)).where(f"`{size}` > 0 and abs(`{size}` - left) < left")
    closest = F.min(F.struct(F.abs(F.col(size) - F.col("left")).alias("off"), F.col(order).alias("one"), F.col(before).alias("at")))
    one = settle(others.groupBy(F.col(key).alias("key")).agg(closest.alias("m")).select("key", "m.one", "m.at"))
    joined = docs.join(placed.join(one.select(F.col("key").alias(key), F.struct("one", "at").alias(last)), key, "left"), [key, bucket])
    joined = joined.withColumn(before, reaches)
    is_last = F.coalesce((F.col(order) == F.col(last)["one"]) & (F.col(before) == F.col(last)["at"]) & (F.col(size) > 0), F.lit(False))
    more = ((F.col(rest) > 0) & (F.col(before) <= F.col(rest))) | is_last
    joined = joined.withColumn(copies, (F.col(whole) + F.when(more, 1).otherwise(0)).cast("int"))
    return joined.select(*given, size, source_size, target, copies, (F.col(size) * F.col(copies)).alias(taken))


def numbered(sources: DataFrame) -> DataFrame:
    """sources with number, from 1 by source (null last): counted within ranges of sources, to which the ranges before are added, so that no task has all."""
    placed = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = settle(placed.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    first, starts = 1, []
    for r in counts:
        starts += [F.lit(r.part).cast("long"), F.lit(first).cast("long")]
        first += r["count"]
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    number = F.element_at(F.create_map(*starts), part) + inside if starts else F.lit(0)
    return placed.withColumn("number", number.cast("long")).drop("place")


def with_starts(buckets: DataFrame, digits: int) -> DataFrame:
    """buckets with start: the sum of those before in their source. Groups of buckets come first (by half of the digits), then buckets in a group, so that no task has all buckets of a source."""
    group = F.substring("bucket", 1, digits // 2)
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    groups = buckets.groupBy("key", group.alias("group")).agg(F.sum("sum").alias("all"))
    groups = groups.select("key", "group", F.coalesce(F.sum("all").over(before("key").orderBy("group")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("sum").over(before("key", "group").orderBy("bucket")), F.lit(0))
    return buckets.withColumn("group", group).withColumn("inside", inside).join(groups, ["key", "group"]).withColumn("start", F.col("first") + F.col("inside")).drop("group", "first", "inside")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'none') || '/' || md5(coalesce(text, ''))) AS h
  FROM documents
), s AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)
), o AS (  -- a source is capped if the level, with all that are capped before it, puts it above
  SELECT *, 3 * source_size AS cap,
         sum(3 * source_size) OVER w - 3 * source_size AS caps, sum(weight) OVER (ORDER BY 3.0 * source_size / weight DESC, source DESC NULLS FIRST) AS weights,
         sum(source_size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST)
), c AS (
  SELECT *, (total - caps) * weight > weights * cap AS above FROM o
), l AS (
  SELECT coalesce(sum(CASE WHEN above THEN cap END), 0) AS capped, sum(CASE WHEN NOT above THEN weight END) AS open FROM c
), t AS (
  SELECT source, source_size, CASE WHEN above THEN CAST(cap AS DOUBLE) ELSE CAST(total - capped AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(open AS DOUBLE) END AS target FROM c, l
), p AS (
  SELECT d.doc_id, d.size, h, d.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole, target - CAST(whole * source_size AS DOUBLE) AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reaches
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, rest - coalesce(sum(CASE WHEN CAST(reaches AS DOUBLE) <= rest THEN size END) OVER (PARTITION BY source), 0) AS gap FROM p
), one AS (
  SELECT source, min({'off': abs(size - gap), 'h': h, 'r': reaches}) AS best FROM f WHERE CAST(reaches AS DOUBLE) > rest AND size > 0 AND abs(size - gap) < gap GROUP BY source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN CAST(reaches AS DOUBLE) <= rest OR (size > 0 AND h = best.h AND reaches = best.r) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM f LEFT JOIN one ON f.source IS NOT DISTINCT FROM one.source
"""
