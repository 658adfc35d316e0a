"""Hard-negative mining with a pivot table.

Vectors are whole numbers (components times SCALE, rounded down), and nearness is the exact inner product. One more
component, which brings each vector to the length of the longest and is zero in an anchor, turns it into Euclidean distance:
a.v = (|a|^2 + M - d(a, v)^2) / 2. The pivot table stores each vector's distances to PIVOTS pivots, which are spread out over
a bounded sample (SAMPLE vectors, by hash). For an anchor, with its own distances to the pivots, the triangle inequality
gives a least and a greatest distance to every vector, and so brackets the score; only vectors whose bracket meets what
is asked for are scored exactly, those that may score highest first.

Vectors belong to the cell of their nearest pivot, and a cell is dealt by hash to blocks of BLOCK vectors at most, so no
cell and no vector that is everywhere is one task. An anchor goes to the blocks of those cells that its brackets leave (the
k best in the sample raise the bar). That is done twice: for the best of its own label, its positives; then for the best
of other labels that score between two shares of each positive. A block returns k rows at most for a question.

Rows with a null vec_id or label, a null or empty vector, a null or non-finite component, or another length than most, take
no part, nor do those of 2^30 or longer after scaling (their scores might not fit a long). Of rows that repeat a vec_id the
smallest (by label, then components) counts. Ties go to the smaller vec_id. An empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import settle

SCALE, PIVOTS, SAMPLE, BLOCK = 256, 16, 4096, 32_768
#: Vectors that a block has at least, if its cell has as many; and candidates that are scored before the others.
LEAST, FIRST = 512, 256
LONGEST = float(1 << 60)
LOW, HIGH = -(1 << 62), 1 << 62
ASKED = "block long, kind int, vec_id long, label int, v array<long>, d array<double>, keys array<long>, lows array<long>, highs array<long>"


class Table:
    """The pivots, and what is known of all vectors: M, the greatest squared length; and of cells: their blocks, and bounds of the distances to each pivot."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: int):
        self.most, self.sample, self.ids, self.labels = most, sample, ids, labels
        whole = self.augmented(sample)
        chosen = [int(((whole - whole.mean(axis=0)) ** 2).sum(axis=1).argmax())]
        near = np.full(len(whole), np.inf)
        while len(chosen) < min(PIVOTS, len(whole)):  # each is the farthest from those before
            near = np.minimum(near, ((whole - whole[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(near.argmax()))
        self.pivots = whole[chosen]
        self.cells: dict[int, tuple[int, int]] = {}
        self.low = self.high = np.zeros((0, len(chosen)))

    def augmented(self, v: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = v.astype(np.float64)
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.most - (x**2).sum(axis=1), 0))
        return np.column_stack([x, more])

    def distances(self, v: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = self.augmented(v, anchors)
        return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in self.pivots], axis=1))

    def bracket(self, a: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score with anchor a of vectors in these distances from it."""
        sum_ = float((a.astype(np.float64) ** 2).sum()) + self.most
        slack = 1 + 1e-9 * sum_  # of rounding
        return (sum_ - most**2) / 2 - slack, (sum_ - least**2) / 2 + slack

    def scores(self, vectors: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Exact: in doubles where no sum can leave the whole numbers that they hold, else in longs."""
        if self.most < 1 << 52:
            return (vectors.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
        return vectors @ a


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def valid(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, settled."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), x.alias("x")).where("vec_id is not null and label is not null and size(x) > 0")
    rows = rows.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))))
    rows = rows.where(F.aggregate("x", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * scale).cast("double"), F.lit(2.0))) < LONGEST)
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    rows = settle(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size.n if size else 0))


def pivot_table(rows: DataFrame) -> tuple[DataFrame, Table]:
    """rows with d (distances to the pivots), cell and block; and the table."""
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    most = rows.agg(F.max(square)).first()[0] or 0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    table = Table(np.array([r.v for r in sample], np.int64), *(np.array([r[c] for r in sample], np.int64) for c in ("vec_id", "label")), most)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = table.distances(matrix(batch.column(2), np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64())), pa.array(d.argmin(axis=1).astype(np.int32))], ["vec_id", "label", "v", "d", "cell"])

    found = settle(rows.select("vec_id", "label", "v").mapInArrow(measured, "vec_id long, label int, v array<long>, d array<double>, cell int"))
    at = range(len(table.pivots))
    bounds = found.groupBy("cell").agg(F.count("*").alias("n"), *(F.min(F.col("d")[k]).alias(f"low{k}") for k in at), *(F.max(F.col("d")[k]).alias(f"high{k}") for k in at)).orderBy("cell").collect()  # PIVOTS rows at most
    total = sum(r.n for r in bounds)
    size = min(BLOCK, max(LEAST, -(-total // 64)))
    first = 0
    for r in bounds:
        table.cells[r.cell] = (first, -(-r.n // size))
        first += table.cells[r.cell][1]
    table.low, table.high = (np.array([[r[f"{side}{k}"] for k in at] for r in bounds]).reshape(len(bounds), -1) for side in ("low", "high"))
    firsts, counts = (F.array(*(F.lit(table.cells.get(c, (0, 1))[k]) for c in at)) for k in (0, 1))
    in_cell = F.pmod(F.xxhash64("vec_id"), F.element_at(counts, F.col("cell") + 1))
    return found.withColumn("block", (F.element_at(firsts, F.col("cell") + 1) + in_cell).cast("long")), table


def routed(table: Table, same: bool, k: int):
    """mapInArrow over (vec_id, label, v, keys, lows, highs): each anchor for each block that its brackets leave. The k best of the sample between two bounds raise the lower one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, labels = matrix(batch.column(2), np.int64), batch.column(1).to_pylist()
            distances = table.distances(vectors, anchors=True)
            out = []
            for i, (name, keys, lows, highs) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 3, 4, 5)))):
                own = ((table.labels == labels[i]) == same) & (table.ids != name)
                scores = np.sort(table.scores(table.sample[own], vectors[i]))[::-1]
                lows = [raised(scores, low, high, k) for low, high in zip(lows, highs)]
                a = distances[i]
                least, most = np.maximum(np.maximum(table.low - a, a - table.high), 0).max(axis=1), (table.high + a).min(axis=1)
                lower, upper = table.bracket(vectors[i], least, most)
                for cell, down, up in zip(sorted(table.cells), lower, upper):
                    left = [j for j in range(len(keys)) if down <= highs[j] and up >= lows[j]]
                    if left:
                        first, n = table.cells[cell]
                        out += [(block, 1, name, labels[i], vectors[i], a, [keys[j] for j in left], [lows[j] for j in left], [highs[j] for j in left]) for block in range(first, first + n)]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), *[pa.list_(pa.int64())] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in ASKED.split(", ")])

    return run


def raised(scores: np.ndarray, low: int, high: int, k: int) -> int:
    """low, or the k-th best of scores (best first) that is between low and high."""
    inside = scores[(scores >= low) & (scores <= high)]
    return int(inside[k - 1]) if len(inside) >= k else low


class Block:
    """The vectors of one block, by label and vec_id."""

    def __init__(self, table: Table, parts: list[tuple[np.ndarray, ...]]):
        self.table = table
        ids, labels, vectors, distances = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors, self.distances = ids[order], labels[order], vectors[order], distances[order]

    def best(self, same: bool, k: int, a: np.ndarray, d: np.ndarray, name: int, label: int, keys: list[int], lows: list[int], highs: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor_id, key, vec_id, score) of the k best between the bounds of each key."""
        low, high = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, "right")
        at = np.arange(low, high) if same else np.concatenate((np.arange(low), np.arange(high, len(self.ids))))
        at = at[self.ids[at] != name]
        own = self.distances[at]
        lower, upper = self.table.bracket(a, np.abs(own - d).max(axis=1, initial=0), (own + d).min(axis=1, initial=np.inf))
        for key, down, up in zip(keys, lows, highs):
            left = np.flatnonzero((lower <= up) & (upper >= down))
            left = left[np.argsort(-upper[left], kind="stable")]
            found = scores = np.zeros(0, np.int64)
            for some in (left[:FIRST], left[FIRST:]):  # the first raise the bar for the others
                some = at[some[upper[some] >= down]]
                exact = self.table.scores(self.vectors[some], a)
                inside = (exact >= down) & (exact <= up)
                found, scores = np.concatenate((found, self.ids[some][inside])), np.concatenate((scores, exact[inside]))
                order = np.lexsort((found, -scores))[:k]
                found, scores = found[order], scores[order]
                if len(found) == k:
                    down = scores[-1]
            yield np.full(len(found), name), np.full(len(found), key), found, scores


def searched(table: Table, same: bool, k: int):
    """mapInArrow over ASKED rows, sorted by block, its vectors (kind 0) before anchors: Block.best() of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, block = None, [], None
        for batch in batches:
            for rows, label, kind in runs_of(batch):
                if label != number:
                    number, parts, block = label, [], None
                if kind == 0:
                    parts.append((rows.column(2).to_numpy(), rows.column(3).to_numpy(), matrix(rows.column(4), np.int64), matrix(rows.column(5), np.float64)))
                    continue
                if block is None:
                    block, parts = Block(table, parts), []  # a routed block has vectors
                asked = zip(matrix(rows.column(4), np.int64), matrix(rows.column(5), np.float64), *(rows.column(c).to_pylist() for c in (2, 3, 6, 7, 8)))
                found = [f for one in asked for f in block.best(same, k, *one)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["anchor_id", "key", "vec_id", "score"])

    return run


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Rows of one block and kind."""
    keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
    starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if batch.num_rows else np.zeros(0, int)
    for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
        yield batch.slice(a, b - a), int(keys[0, a]), int(keys[1, a])


def search(vectors: DataFrame, table: Table, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, key, vec_id, score, rank) for asked (vec_id, label, v, keys, lows, highs): for each key the k best vectors of the same label, or of others, that score between its bounds."""
    none = F.lit(None).cast("array<long>")
    rows = vectors.select("block", F.lit(0).alias("kind"), "vec_id", "label", "v", "d", *(none.alias(c) for c in ("keys", "lows", "highs")))
    both = rows.unionByName(asked.select("vec_id", "label", "v", "keys", "lows", "highs").mapInArrow(routed(table, same, k), ASKED))
    blocks = sum(n for _, n in table.cells.values())
    found = both.repartition(max(1, blocks), "block").sortWithinPartitions("block", "kind").mapInArrow(searched(table, same, k), "anchor_id long, key long, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")  # k rows of each block at most
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, shares: tuple[int, int] = (30, 90), label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    For each vector that is_anchor (of vec_id) picks, its best others of the same label are its positives. For each of these,
    the best vectors of other labels that score from shares[0] to shares[1] percent of it are the hard negatives. label:
    replaces the label of the rows that take part (of vec_id and label).
    """
    rows = valid(vectors)
    if label is not None:
        rows = rows.withColumn("label", label.cast("int"))
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    table_rows, table = pivot_table(rows)
    anchors = table_rows.where(is_anchor).select("vec_id", "label", "v")
    one = lambda c: F.array(F.lit(c).cast("long") if isinstance(c, int) else F.col(c))
    near = search(table_rows, table, anchors.withColumns({"keys": one("vec_id"), "lows": one(LOW), "highs": one(HIGH)}), True, positives)
    near = settle(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    low, high = shares
    of = lambda share, more: F.expr(f"{share} * (positive_score div 100) + ({share} * (positive_score % 100) + {more}) div 100")
    bounds = near.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", of(low, 99).alias("low"), of(high, 0).alias("high"))).alias("w"))
    asked = anchors.join(bounds, "vec_id").select("vec_id", "label", "v", F.col("w.positive_id").alias("keys"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    far = search(table_rows, table, asked, False, negatives).select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
"""
