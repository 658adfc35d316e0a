"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with equal n-gram sets are one node. The product is not formed where size bounds rule a pair out:

1. A pair with similarity t shares at least ceil(t * n) n-grams, n being the larger size. So if all n-grams are put in
   one order, it shares one among the first n - ceil(t * n) + 1 of both. These prefixes alone are shuffled. N-grams that a
   bounded table (HEAVY) names as frequent come last in that order, which only keeps lists short.
2. Each list of nodes that share a prefix n-gram is sorted by size, nodes without a neighbour within the size ratio t
   leave it, and those within the size ratio t are compared by
   parity sketches (about a bit for each n-gram, 512 to 8192): the number of differing bits never exceeds that of differing n-grams, so no link is lost. A
   list gives a spanning forest of the pairs that remain, so a group of g near copies costs g rows, not g * g. N-grams
   whose lists have the same nodes share one: lists are named by their content, and if two names agree by chance, their
   nodes are compared together, so that no pair is lost. A list of LONG nodes or more isn't compared: it gives an edge for each node to the next, which joins all of them.
3. The connected parts of that candidate graph are the blocks of the matrix product: whole n-gram sets go there once, and
   overlap counts of all pairs of a block are accumulated column by column. Parts of more than BLOCK n-grams are cut into
   block pairs, so that each task's matrix is bounded. A block returns a spanning forest of its links, and for each node
   the number of documents that it is linked to; a pair is counted in one block only. So all links count, but not all
   pairs are rows.

Components of these forests are the classes. Null or wordless texts have an empty set and no links. Rows with a null
doc_id link as others do; the component_id of a class without any doc_id is null. Rows that repeat a doc_id are
judged each by its own text. Two sets with the same 64-bit fingerprint and size count as equal. An empty table gives an
empty result; other columns of docs are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import settle
from tickloom.llm.components import components
from tickloom.llm.textkit import Rolling, Words, mix, ranges, row_of, signed, slices, text_bytes

#: N-grams that are put last: at most so many, each in at least this share of the documents.
HEAVY, HEAVY_SHARE = 50_000, 0.0005
#: Lists of up to SHORT nodes are compared many at a time; lists of LONG nodes or more not at all.
SHORT, LONG = 8, 20_000
#: N-grams of a block of the product.
BLOCK = 1_000_000
SKETCH = (512, 8192)
#: Candidate nodes up to this number (32 bytes each) are broadcast to find their texts; more are joined by a shuffle.
BROADCAST = 500_000


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each row, sorted by value, and where each row's begin."""
    names = words.hashes(lower=True)
    n = words.per_row()
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    start = ranges(words.rows[:-1], count)
    end = np.minimum(start + size, np.repeat(words.rows[1:], count))
    values = Rolling(names).span(start, end)
    rows = np.concatenate(([0], np.cumsum(count)))
    out, sizes = [], np.zeros(len(n), np.int64)
    for i in range(len(n)):
        own = np.unique(values[rows[i] : rows[i + 1]])
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else values, np.concatenate(([0], np.cumsum(sizes)))


def fingerprint(own: np.ndarray) -> np.uint64:
    return mix(mix(own, 6).sum(keepdims=True) + np.uint64(len(own)))[0]


def sketch(own: np.ndarray) -> bytes:
    bits = min(max(1 << (len(own) - 1).bit_length(), SKETCH[0]), SKETCH[1])
    odd = np.bincount((mix(own, 5) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


class Sketches:
    """Parity sketches of different widths (in 8-byte words); a wide one folds to any smaller power of two."""

    def __init__(self, width: np.ndarray, begin: np.ndarray, data: np.ndarray):
        self.width, self.begin, self.data = width, begin, data

    @classmethod
    def of(cls, values: list[bytes]) -> Sketches:
        width = np.array([len(v) // 8 for v in values], np.int64)
        return cls(width, np.cumsum(width) - width, np.frombuffer(b"".join(values), np.uint64))

    @classmethod
    def joined(cls, parts: list[Sketches]) -> Sketches:
        shift = np.cumsum([0, *(len(p.data) for p in parts[:-1])])
        return cls(np.concatenate([p.width for p in parts]), np.concatenate([p.begin + k for p, k in zip(parts, shift)]), np.concatenate([p.data for p in parts]))

    def __getitem__(self, chosen) -> Sketches:
        return Sketches(self.width[chosen], self.begin[chosen], self.data)

    def copy(self) -> Sketches:
        """Without the words of those that are no longer in it."""
        return Sketches(self.width, np.cumsum(self.width) - self.width, self.data[ranges(self.begin, self.width)])

    def folded(self, at: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(at), width), np.uint64)
        for own in np.unique(self.width[at]):
            some = self.width[at] == own
            words = self.data[self.begin[at[some]][:, None] + np.arange(own)]
            out[some] = np.bitwise_xor.reduce(words.reshape(-1, own // width, width), axis=1)
        return out

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least number of n-grams in which a and b can differ."""
        out = np.zeros(len(a), np.int64)
        least = np.minimum(self.width[a], self.width[b])
        for width in np.unique(least):
            some = least == width
            out[some] = np.bitwise_count(self.folded(a[some], width) ^ self.folded(b[some], width)).sum(axis=1, dtype=np.int64)
        return out


def frequent(size: int, share: float):
    """mapInArrow: the n-grams in at least this share of a slice's documents, with their number. What is that frequent in the corpus is in some slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, rows = grams(Words(*text_bytes(batch.column(1))), size)
            values, counts = np.unique(values, return_counts=True)
            often = counts >= max(2, share * (len(rows) - 1))
            yield pa.RecordBatch.from_arrays([signed(values[often]), counts[often]], ["gram", "n"])

    return run


def profile(size: int, percent: int, heavy: np.ndarray):
    """mapInArrow: node (a fingerprint of the set), size, prefix and sketch of each document; the prefix only once in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, rows = grams(Words(*text_bytes(batch.column(1))), size)
            last = np.isin(values, heavy)
            nodes, prefixes, sketches, seen = np.zeros(batch.num_rows, np.uint64), [], [], set()
            for i in range(batch.num_rows):
                own, late = values[rows[i] : rows[i + 1]], last[rows[i] : rows[i + 1]]
                n = len(own)
                nodes[i] = fingerprint(own)
                if not n or nodes[i] in seen:
                    prefixes.append(None)
                    sketches.append(None)
                    continue
                seen.add(nodes[i])
                length = n + (-percent * n // 100) + 1
                order = own if not late.any() else np.concatenate((own[~late], own[late]))
                prefixes.append(signed(order[:length]))
                sketches.append(sketch(own))
            sizes = np.diff(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(nodes), sizes, pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), batch.column(2)], ["doc_id", "node", "n", "prefix", "sketch", "text_hash"])

    return run


def near(n: np.ndarray, sketches: Sketches, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs a, b can be links: neither the sizes nor the sketches rule them out."""
    x, y = n[a], n[b]
    ok = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
    a, b = a[ok], b[ok]
    # similar enough: differing n-grams are at most (1 - t) / (1 + t) of both sizes
    ok[ok] = (100 + percent) * sketches.differing(a, b) <= (100 - percent) * (n[a] + n[b])
    return ok


def one_list(n: np.ndarray, node: np.ndarray, sketches: Sketches, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the possible links of a list that is sorted by size."""
    label = np.arange(len(n))
    until = np.searchsorted(percent * n, 100 * n, "right")  # later ones are too large
    for k in range(0, len(n), 32):
        rows = np.arange(k, min(k + 32, len(n)))
        a = np.repeat(rows, until[rows] - rows - 1)
        b = ranges(rows + 1, until[rows] - rows - 1)
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        ok = near(n, sketches, a, b, percent)
        label = merged(label, a[ok], b[ok])
    tied = np.flatnonzero(label != np.arange(len(n)))
    return node[tied], node[label[tied]]


def postings(percent: int):
    """mapInArrow over (list, n, node, sketch), sorted by the first three within the partition: edges of the candidate graph."""

    def edges(gram: np.ndarray, n: np.ndarray, node: np.ndarray, sketches: Sketches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        sizes = np.diff(np.append(starts, len(gram)))
        for d in np.unique(sizes[sizes > 1]):
            at = starts[sizes == d]
            if d <= SHORT:
                i, j = np.triu_indices(d, 1)
                a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                ok = near(n, sketches, a, b, percent)
                yield node[a[ok]], node[b[ok]]
            elif d < LONG:
                for k in at:
                    yield one_list(n[k : k + d], node[k : k + d], sketches[k : k + d], percent)
            else:
                yield from (chain(node[k : k + d]) for k in at)

    def chain(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return node[:-1], node[1:]

    def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pairs[0], pairs[1]], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []  # what may belong to one list that isn't complete
        long = False  # its first LONG nodes are dealt with, and parts holds its last node
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
            rows.append(Sketches.of(batch.column(3).to_pylist()))
            if parts and parts[-1][0][-1] == rows[0][-1] and not long and sum(len(x[0]) for x in parts) + len(rows[0]) < LONG:
                parts.append(tuple(rows))
                continue
            *columns, sketches = zip(*parts, rows)
            gram, n, node = (np.concatenate(x) for x in columns)
            sketches = Sketches.joined(sketches)
            new = np.append(True, (node[1:] != node[:-1]) | (gram[1:] != gram[:-1]))
            gram, n, node, sketches = gram[new], n[new], node[new], sketches[new]
            found, begin = [], 0
            if long:
                begin = int(np.searchsorted(gram != gram[0], True))
                found.append(chain(node[:begin]))
            at = max(begin, int(np.flatnonzero(gram == gram[-1])[0]))
            found += edges(gram[begin:at], n[begin:at], node[begin:at], sketches[begin:at])
            if at == len(gram):  # the long list goes on
                at = len(gram) - 1
            else:
                long = len(gram) - at >= LONG
                if long:
                    found.append(chain(node[at:]))
                    at = len(gram) - 1
            parts = [(gram[at:], n[at:], node[at:], sketches[at:].copy())]
            yield from batch_of(found)
        if parts and not long:
            *columns, sketches = zip(*parts)
            gram, n, node = (np.concatenate(x) for x in columns)
            sketches = Sketches.joined(sketches)
            new = np.append(True, (node[1:] != node[:-1]) | (gram[1:] != gram[:-1]))
            yield from batch_of(list(edges(gram[new], n[new], node[new], sketches[new])))

    return run


def whole_sets(size: int):
    """mapInArrow over (doc_id, text, node, part, cuts, copies): the whole n-gram set of a node, in every block pair that it belongs to. own: its side of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, rows = grams(Words(*text_bytes(batch.column(1))), size)
            node = batch.column(2).to_numpy(zero_copy_only=False)
            part = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = batch.column(4).to_numpy(zero_copy_only=False)
            copies = batch.column(5).to_numpy(zero_copy_only=False)
            own = (mix(node.view(np.uint64), 8) % np.maximum(cuts, 1).astype(np.uint64)).astype(np.int64)
            for i in range(batch.num_rows):
                if signed(np.array([fingerprint(values[rows[i] : rows[i + 1]])]))[0] != node[i]:
                    continue  # another text with this doc_id
                one = pa.array([signed(values[rows[i] : rows[i + 1]])], pa.list_(pa.int64()))
                for other in range(cuts[i]):
                    yield pa.RecordBatch.from_arrays([pa.array([part[i]]), pa.array([min(own[i], other)], pa.int64()), pa.array([max(own[i], other)], pa.int64()), pa.array([node[i]]), one, pa.array([own[i]], pa.int64()), pa.array([copies[i]], pa.int64())], ["part", "i", "j", "node", "grams", "own", "copies"])

    return run


def product(node: np.ndarray, values: np.ndarray, sizes: np.ndarray, percent: int, side: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links of one block, and each node's number of linked documents: overlap counts of all pairs, accumulated over the n-grams that at least two share.

    If the block has two sides, only links from one to the other are counted; those within a side count in its own block.
    """
    m = len(node)
    who = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    counts = np.diff(np.append(starts, len(values)))
    overlap = np.zeros(m * m, np.int32)
    for d in np.unique(counts[counts > 1]):
        at = starts[counts == d]
        step = max(1, 2_000_000 // (d * d))
        for k in range(0, len(at) if d <= 64 else 0, step):
            rows = who[at[k : k + step, None] + np.arange(d)]
            np.add.at(overlap, (rows[:, :, None] * m + rows[:, None, :]).ravel(), np.int32(1))
    wide = starts[counts > 64]
    if len(wide):
        dense = overlap.reshape(m, m)
        step = max(64, 16_000_000 // (4 * m))
        width = counts[counts > 64]
        for k in range(0, len(wide), step):
            some = np.zeros((m, min(step, len(wide) - k)), np.float32)
            some[who[ranges(wide[k : k + step], width[k : k + step])], np.repeat(np.arange(some.shape[1]), width[k : k + step])] = 1
            dense += (some @ some.T).astype(np.int32)
    a, b = np.nonzero(np.triu(overlap.reshape(m, m), 1))
    both = overlap.reshape(m, m)[a, b].astype(np.int64)
    linked = 100 * both >= percent * (sizes[a] + sizes[b] - both)
    a, b = a[linked], b[linked]
    counted = (side[a] != side[b]) | (side.min() == side.max())
    n = np.zeros(m, np.int64)
    np.add.at(n, a[counted], copies[b[counted]])
    np.add.at(n, b[counted], copies[a[counted]])
    return *forest(node, a, b), n


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (the smallest index) after the edges a, b are added to those of label."""
    if not len(a):
        return label
    while True:
        least = np.minimum(label[a], label[b])
        low = label.copy()
        np.minimum.at(low, label[a], least)
        np.minimum.at(low, label[b], least)
        while (low[low] != low).any():
            low = low[low]
        low = low[label]
        if (low == label).all():
            return label
        label = low


def forest(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = merged(np.arange(len(node)), a, b)
    tied = np.flatnonzero(label != np.arange(len(node)))
    return node[tied], node[label[tied]]


def blocks(percent: int):
    """mapInArrow over (part, i, j, node, grams, own, copies), sorted within the partition by part, i, j, node: edges (a, b) of the forests, and (a, null, n) with the number of documents linked to a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks()
                node = whole.column("node").to_numpy()
                new = np.append(True, node[1:] != node[:-1])  # rows that repeat a doc_id bring a set again
                if not new.all():
                    whole, node = whole.filter(pa.array(new)).combine_chunks(), node[new]
                lists = whole.column("grams").combine_chunks()
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                side = whole.column("own").to_numpy() if key[1] != key[2] else np.zeros(len(node), np.int64)
                x, y, n = product(node, lists.flatten().to_numpy(zero_copy_only=False), sizes, percent, side, whole.column("copies").to_numpy())
                some = n > 0
                columns = [np.concatenate((x, node[some])), [*y.tolist(), *[None] * int(some.sum())], [*[None] * len(x), *n[some].tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                if tuple(keys[:, a]) != key:
                    yield from close()
                    key = tuple(keys[:, a])
                held.append(batch.slice(a, b - a).select([3, 4, 5, 6]))
        yield from close()

    return run


def ngram_components(docs: DataFrame, size: int = 4, percent: int = 85, hashes: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: the size of its set of word n-grams (words [^\\x20\\x09-\\x0D]+, A-Z lowered), the smallest doc_id that links of at least percent % similarity reach, and the number of other rows to which it has such a link itself. hashes: text_hash besides, xxhash64 of the text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    total = docs.count()
    counted = texts.mapInArrow(frequent(size, HEAVY_SHARE), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY_SHARE * total)
    heavy = np.array([r.gram for r in counted.orderBy(F.desc("n"), "gram").limit(HEAVY).collect()], np.int64).view(np.uint64)

    rows = settle(texts.mapInArrow(profile(size, percent, np.sort(heavy)), "doc_id long, node long, n long, prefix array<long>, sketch binary, text_hash long"))
    entries = rows.where("prefix is not null").select(F.explode("prefix").alias("gram"), "n", "node")
    by_size = Window.partitionBy("gram").orderBy("n", "node")
    shared = entries.withColumn("again", F.lag("node").over(by_size)).where("again is null or again <> node").drop("again")  # a node's copies
    shared = shared.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    shared = shared.where(f"100 * less >= {percent} * n or 100 * n >= {percent} * more").select("gram", "n", "node")  # the others are paired with none
    known = rows.where("sketch is not null").groupBy("node").agg(F.first("sketch").alias("sketch"))
    whole = Window.partitionBy("gram")
    shared = shared.withColumn("list", F.xxhash64(F.bit_xor(F.xxhash64("node")).over(whole), F.count("*").over(whole)))
    once = shared.select("list", "n", "node").repartition("node").dropDuplicates(["list", "node"])  # and the join needs no other exchange
    lists = once.join(known, "node").select("list", "n", "node", "sketch")
    edges = lists.repartition("list").sortWithinPartitions("list", "n", "node").mapInArrow(postings(percent), "a long, b long")
    parts = settle(components(edges))

    # a node's text is found by its smallest doc_id; of rows without one, by the text's hash
    names = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.max("n").alias("n"), F.count("*").alias("copies"))
    found = settle(parts.join(names, "node"))
    cuts = found.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / 1000)).cast("long").alias("cuts"))
    wanted = found.join(cuts, "root").select("doc_id", "text_hash", "node", F.col("root").alias("part"), "cuts", "copies")
    size_of = found.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    small = (lambda df: F.broadcast(df)) if size_of.n <= BROADCAST else (lambda df: df)
    chosen = texts.join(small(wanted.where("doc_id is not null").drop("text_hash")), "doc_id").select("doc_id", "text", "node", "part", "cuts", "copies")
    if size_of.nameless:
        own = texts.where("doc_id is null").join(small(wanted.where("doc_id is null").drop("doc_id")), "text_hash")
        chosen = chosen.unionByName(own.dropDuplicates(["text_hash"]).select(*chosen.columns))
    sets = chosen.mapInArrow(whole_sets(size), "part long, i long, j long, node long, grams array<long>, own long, copies long")
    links = settle(sets.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "node").mapInArrow(blocks(percent), "a long, b long, n long"))
    classes = components(links)

    linked = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = names.select("node", "copies", F.col("doc_id").alias("own")).join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("own").alias("component_id"))
    labels = named.join(least, "root").join(linked, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(labels, "node").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"), *(["text_hash"] if hashes else []))
