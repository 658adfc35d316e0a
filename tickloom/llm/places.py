"""Places of text that are compared across the corpus: a row for a run of windows, judged where equal ones meet.

A place has a mark (what all its windows contain) and a stretch (a fingerprint of all that its windows cover). Equal
windows always stand in places with equal marks, so a place whose mark is nowhere else has no equals; one whose stretch
is elsewhere has equals for all its windows; any other is open: to be compared again in smaller pieces.

A place belongs to a doc_id and a tag, which tells different texts of one doc_id apart and is 0 for all others. In rows of
PLACE the tag stands above the two lowest bits of state, so that it costs nothing where it is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import fresh
from tickloom.llm.textkit import mix, signed

#: Repeated doc_ids up to this number are broadcast; more are joined by a shuffle.
BROADCAST = 500_000

PLACE = "mark long, stretch long, doc_id long, start long, windows long, at long, state int"
#: States: not settled; gone, and standing for no others; gone, but the first of its equals.
OPEN, LATER, LED = range(3)
NAMES = [x.split()[0] for x in PLACE.split(", ")]


def places(mark: np.ndarray, stretch: np.ndarray, ids: np.ndarray, tag: np.ndarray, start: np.ndarray, windows: np.ndarray, at: np.ndarray, first_stays: bool = True) -> pa.RecordBatch:
    """Rows of PLACE, with those that are equal within a slice settled here: all but the first are gone, and needn't meet others.

    Their mark becomes a random one, which spreads them; so a common passage costs its mark's task one row for a slice.
    first_stays: whether the first of equal places stays.
    """
    order = np.lexsort((start, tag, ids, stretch, mark))
    m, w, i, g, s = mark[order], stretch[order], ids[order], tag[order], start[order]
    same = np.zeros(len(order), bool)
    same[1:] = (m[1:] == m[:-1]) & (w[1:] == w[:-1])
    later = same.copy()
    later[1:] &= ~((i[1:] == i[:-1]) & (g[1:] == g[:-1]) & (s[1:] == s[:-1]))
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later &= (i != i[head]) | (g != g[head]) | (s != s[head])
    state = np.where(later, LATER, OPEN).astype(np.int32)
    if not first_stays:
        state[head[later]] = LED
    m[later] = mix(i[later].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s[later].astype(np.uint64))
    return pa.RecordBatch.from_arrays([signed(m), signed(w), i, s, windows[order], at[order], state | (g << 2).astype(np.int32)], NAMES)


def settled_runs(ids: np.ndarray, tag: np.ndarray, start: np.ndarray, windows: np.ndarray, at: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    """One row of PLACE for each run of places that are gone and stand for no others (run: which places; those side by side are one run)."""
    first = np.flatnonzero(run & ~np.append(False, run[:-1]))
    last = np.flatnonzero(run & ~np.append(run[1:], False))
    total = np.concatenate(([0], np.cumsum(windows)))
    n = total[last + 1] - total[first]
    mark = mix(ids[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[first].astype(np.uint64), 1)
    state = np.full(len(first), LATER, np.int32) | (tag[first] << 2).astype(np.int32)
    return pa.RecordBatch.from_arrays([signed(mark), signed(mark), ids[first], start[first], n, at[first], state], NAMES)


def judge(rows: DataFrame, first_stays: bool = True) -> DataFrame:
    """(doc_id, tag, start, windows, at, gone, open). gone: an equal place stands earlier (or, unless first_stays, anywhere else). open: the first of its equals, but its mark also stands in a different stretch."""
    rows = rows.repartition("mark")  # one exchange, the same for all that is asked of it
    rows = rows.withColumns({"tag": F.shiftright("state", 2), "state": F.col("state").bitwiseAND(3)})
    same = Window.partitionBy("mark", "stretch").orderBy("doc_id", "tag", "start")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mark = Window.partitionBy("mark")
    rows = rows.withColumn("rank", F.rank().over(same))
    gone = (F.col("state") != OPEN) | (F.col("rank") > 1)
    if not first_stays:
        rows = rows.withColumn("last", F.last(F.struct("doc_id", "tag", "start")).over(whole))
        gone = gone | (F.col("last") != F.struct("doc_id", "tag", "start"))
    rows = rows.withColumns({"least": F.min("stretch").over(mark), "most": F.max("stretch").over(mark)})
    open_ = (F.col("state") != LATER) & (F.col("rank") == 1) & (F.col("least") != F.col("most"))
    return rows.select("doc_id", "tag", "start", "windows", "at", gone.alias("gone"), open_.alias("open"))


class Texts:
    """docs with a key to join by, which is never null, and a tag that tells different texts of one doc_id apart; the three helper columns come after those of docs, under names that docs hasn't.

    tag: a fingerprint of the text where another row with this doc_id has a different one, else 0. Rows without a doc_id get
    keys that none has. All joins with texts start from the one frame, with all its columns, so that Spark shuffles the
    texts once and uses that exchange again.
    """

    def __init__(self, docs: DataFrame):
        self.docs, self.text = docs, docs.columns.index("text")
        self.key, self.none, self.tag, self.spans = fresh(docs, "key", "none", "tag", "spans")
        name, id_ = F.xxhash64("text"), *fresh(docs, "id")
        again = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a <> b").select(id_)
        n = again.count()
        tag = F.lit(0)
        if n:
            docs = docs.join(F.broadcast(again) if n <= BROADCAST else again, F.col("doc_id") == F.col(id_), "left")
            tag = F.when(F.col(id_).isNotNull(), 1 + F.pmod(name, F.lit((1 << 29) - 1))).otherwise(0).cast("int")
        key = F.coalesce(F.col("doc_id").cast("long"), name).alias(self.key)
        self.keyed = docs.select(*self.docs.columns, key, F.col("doc_id").isNull().cast("int").alias(self.none), tag.alias(self.tag))

    def plain(self) -> DataFrame:
        """(doc_id, text, tag) of the rows that take part."""
        return self.keyed.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(self.tag).alias("tag"))

    def with_places(self, rows: DataFrame, how: str) -> DataFrame:
        """The keyed texts with a last column, an array of the places in them."""
        spans = rows.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "windows", "at")).alias(self.spans))
        spans = spans.select(F.coalesce("doc_id", F.lit(0)).alias(self.key), F.col("doc_id").isNull().cast("int").alias(self.none), F.col("tag").alias(self.tag), self.spans)
        return self.keyed.join(spans, [self.key, self.none, self.tag], how).select(*self.keyed.columns, self.spans)


#: Where helper columns stand in a batch of with_places(): counted from the end.
KEY, TAG, SPANS = -4, -2, -1


def spans_of(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, start, windows and at of the structs in a column of lists (null: none)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
