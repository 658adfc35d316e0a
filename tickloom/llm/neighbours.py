"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of the vectors.

Vectors are dealt to shards by hash. A shard's graph grows in batches: greedy beam searches of the graph so far propose
neighbours for each new vector; of these, relaxed distance pruning keeps a neighbour only if no kept one is closer to it
by the factor ALPHA, so edges point in different directions; edges are also added backwards, and pruned again where a
vector has too many. Each query runs a beam search in every shard, and the shards' answers are merged.

Nearness is the largest inner product. Graphs are built by the distance of the vectors brought to length one, so that
edges lead to vectors of like direction whatever their lengths; searches follow these edges by the inner product with the
original vectors, and so prefer the longer of them. Results are the inner product in double precision on the original
vectors. Equal vectors are one node with the k + 1 smallest of their ids, which is all that any answer can use; so a large
group of copies neither fills neighbour lists nor meets in one task.

A shard holds SHARD vectors at most (by hash, on average), fewer if there are cores enough for smaller ones: its
vectors, graph and searches take some 100 MB at 64 components.

Vectors that are null or zero, hold null or non-finite components, or have a null id or another length than most, take
no part. Of an id with different vectors the smallest (by component) counts. Fewer than k candidates give fewer rows; an
empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import settle

#: LEAST: vectors that a shard has at least, if there is more than one.
SHARD, LEAST, DEGREE, BUILD, BEAM, ALPHA = 32_768, 4096, 32, 64, 384, 1.2
#: Searches that run side by side, and beam entries that each expands at a time.
TOGETHER, EXPAND = 256, 4


class Graph:
    def __init__(self, vectors: np.ndarray):
        self.whole = vectors.astype(np.float32)
        self.x = (vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))).astype(np.float32)
        n = len(vectors)
        self.edges = np.full((n, DEGREE), -1, np.int32)
        self.start = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin())
        order = np.random.Generator(np.random.PCG64(n)).permutation(n)
        order = np.concatenate(([self.start], order[order != self.start]))
        done = min(n, TOGETHER)
        first = order[:done]
        self.link(first, np.broadcast_to(first, (done, done)))
        while done < n:
            batch = order[done : done + min(done, TOGETHER)]
            self.link(batch, self.search(self.x[batch], BUILD, self.distances))
            done += len(batch)

    def distances(self, to: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared, from each row of to to its row of places, all of length one."""
        near = self.x[at]
        return np.maximum((to**2).sum(axis=1)[:, None] + (near**2).sum(axis=2) - 2 * np.matmul(near, to[:, :, None])[:, :, 0], 0)

    def products(self, to: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Inner products with the original vectors, less for more."""
        return -np.matmul(self.whole[at], to[:, :, None])[:, :, 0]

    def search(self, queries: np.ndarray, width: int, far_from) -> np.ndarray:
        """The width nearest, by that measure, that beam searches find, nearest first; -1 fills up."""
        q, rows = len(queries), np.arange(len(queries))[:, None]
        beam = np.full((q, width), -1, np.int64)
        far = np.full((q, width), np.inf, np.float32)
        open_ = np.zeros((q, width), bool)
        beam[:, 0], open_[:, 0] = self.start, True
        far[:, 0] = far_from(queries, beam[:, :1])[:, 0]
        seen = np.zeros((q, len(self.x)), bool)
        seen[:, self.start] = True
        while open_.any():
            # the nearest entries that are not expanded; the beam is sorted
            rank = np.cumsum(open_, axis=1)
            pick = np.argsort(~(open_ & (rank <= EXPAND)), axis=1, kind="stable")[:, :EXPAND]
            chosen = open_[rows, pick]
            nodes = np.where(chosen, beam[rows, pick], -1)
            np.put_along_axis(open_, pick, False, axis=1)
            next_ = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(q, -1).astype(np.int64)
            next_[(next_ >= 0) & seen[rows, next_]] = -1
            next_ = np.sort(next_, axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1  # from two nodes at once
            new = next_ >= 0
            seen[np.nonzero(new)[0], next_[new]] = True
            away = np.where(new, far_from(queries, next_), np.inf).astype(np.float32)
            all_, all_far, all_open = np.concatenate((beam, next_), 1), np.concatenate((far, away), 1), np.concatenate((open_, new), 1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            beam, far, open_ = all_[rows, best], all_far[rows, best], all_open[rows, best]
        return beam

    def prune(self, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """For each node up to DEGREE of the others (-1: none): the nearest that is left, again and again, each taking out those that it is closer to."""
        others = np.where(others == nodes[:, None], -1, others)
        far = np.where(others >= 0, self.distances(self.x[nodes], others), np.inf)
        order = np.argsort(far, axis=1, kind="stable")[:, : 3 * DEGREE]
        others, far = np.take_along_axis(others, order, 1), np.take_along_axis(far, order, 1)
        near = self.x[others]
        norms = (near**2).sum(axis=2)
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
        left, rows = np.isfinite(far), np.arange(len(nodes))
        out = np.full((len(nodes), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            some = left.any(axis=1)
            if not some.any():
                break
            at = left.argmax(axis=1)
            out[some, k] = others[rows, at][some]
            left[rows, at] = False
            left &= ~(ALPHA**2 * between[rows, at] <= far)
        return out

    def link(self, nodes: np.ndarray, found: np.ndarray) -> None:
        for k in range(0, len(nodes), TOGETHER):
            self.edges[nodes[k : k + TOGETHER]] = self.prune(nodes[k : k + TOGETHER], found[k : k + TOGETHER].astype(np.int64))
        # backwards
        own = self.edges[nodes]
        target, source = own[own >= 0].astype(np.int64), np.repeat(nodes, (own >= 0).sum(axis=1))
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        heads = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else target
        counts = np.diff(np.append(heads, len(target)))
        for k in range(0, len(heads), TOGETHER):
            who, n = target[heads[k : k + TOGETHER]], counts[k : k + TOGETHER]
            more = np.full((len(who), n.max()), -1, np.int64)
            at = heads[k : k + TOGETHER]
            column = np.arange(n.max())
            inside = column < n[:, None]
            more[inside] = source[(at[:, None] + column)[inside]]
            both = np.sort(np.concatenate((self.edges[who].astype(np.int64), more), axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            small = (both >= 0).sum(axis=1) <= DEGREE
            kept = np.sort(both, axis=1)[:, ::-1][:, :DEGREE]
            self.edges[who[small]] = np.pad(kept[small], ((0, 0), (0, DEGREE - kept.shape[1])), constant_values=-1) if kept.shape[1] < DEGREE else kept[small]
            if (~small).any():
                self.edges[who[~small]] = self.prune(who[~small], both[~small])


def shard_search(k: int):
    """mapInArrow over (shard, query, ids, embedding), sorted by shard, vectors before queries: the k nearest vectors of each query in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, parts, graph, vectors = None, [], [], None, None
        for batch in batches:
            for rows, label, query in runs_of(batch):
                if label != shard:
                    shard, ids, parts, graph = label, [], [], None
                matrix = rows.column(3).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).astype(np.float64)
                if not query:
                    ids += rows.column(2).to_pylist()
                    parts.append(matrix)
                    continue
                if not ids:
                    continue
                if graph is None:
                    vectors, parts = np.concatenate(parts), []
                    graph = Graph(vectors)
                for a in range(0, len(matrix), TOGETHER):
                    own = matrix[a : a + TOGETHER]
                    found = graph.search(own.astype(np.float32), max(BEAM, 2 * k), graph.products)
                    exact = np.where(found >= 0, np.einsum("qd,qnd->qn", own, vectors[found]), -np.inf)
                    order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
                    exact, found = np.take_along_axis(exact, order, 1), np.take_along_axis(found, order, 1)
                    some = found >= 0
                    names = rows.column(2).slice(a, len(own)).to_pylist()
                    query_ids = np.repeat([n[0] for n in names], some.sum(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids, pa.int64()), pa.array([ids[i] for i in found[some]], pa.list_(pa.int64())), pa.array(exact[some])], ["own", "ids", "score"])

    return run


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)])
    starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if batch.num_rows else np.zeros(0, int)
    for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
        yield batch.slice(a, b - a), int(keys[0, a]), int(keys[1, a])


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of those that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    infinite = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite))
    rows = rows.where(finite).where(F.exists("embedding", lambda x: x != 0))
    rows = settle(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (size.d if size else 0))


def labels(spark: SparkSession, shards: int) -> DataFrame:
    """(number, shard), a row for each shard: labels that repartition() deals to partitions of their own."""
    label = F.col("id").cast("int")
    tried = spark.range(64 * shards).select(label.alias("label"), F.pmod(F.hash(label), F.lit(shards)).alias("number"))
    found = tried.groupBy("number").agg(F.min("label").alias("label"))
    every = spark.range(shards).select(label.alias("number"))
    return every.join(found, "number", "left").select("number", F.coalesce("label", -1 - F.col("number")).alias("shard"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that is_query (of vec_id) picks, the k nearest others that are found."""
    rows = valid(vectors)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    some = rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    nodes = settle(some.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    total = nodes.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-total // shard), min(-(-total // LEAST), cores))

    asked = rows.where(is_query)
    names = asked.join(nodes, "embedding").select("vec_id", F.element_at("ids", 1).alias("own"))
    dealt = nodes.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("number"), F.lit(0).alias("query"), "ids", "embedding")
    queries = nodes.join(asked.select("embedding").distinct(), "embedding", "left_semi")
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("number"), F.lit(1).alias("query"), F.slice("ids", 1, 1).alias("ids"), "embedding")
    both = dealt.unionByName(queries).join(F.broadcast(labels(rows.sparkSession, shards)), "number").select("shard", "query", "ids", "embedding")
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", "query", "ids")  # so that reruns build the same graphs
    found = both.mapInArrow(shard_search(k + 1), "own long, ids array<long>, score double")

    each = found.select("own", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    merged = each.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    answers = names.withColumnRenamed("vec_id", "query_id").join(merged.drop("n"), "own").where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
