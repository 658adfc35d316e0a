"""Quality classifier: histogram gradient-boosted trees over statistics of documents.

A document becomes a row of statistics of its whole text: sizes, shares of kinds of characters and words, and how much of
it repeats (STATISTICS names them). Trees are fitted to the labels one after another: values are dealt once to BINS bins by
quantiles, a node's histograms of gradients and curvatures give its best split, and each tree steps against the gradient of
the log loss. A fitted forest is four arrays, tree by tree and level by level (node k has children 2k + 1 and 2k + 2), and
all rows walk down all trees at once, a numpy step for each level.

The forest is fitted on a bounded sample of labelled rows (SAMPLE, by hash of the doc_id; documented bound; a doc_id with
both labels counts as 0, and copies of a text count once); scoring covers every whole text. Nothing but the text is looked
at. Null texts count as empty. Without labels of both kinds every score is (ones + 1) / (labels + 2). Rows may repeat a
doc_id or have none; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import settle
from tickloom.llm.textkit import BYTE_VALUE, Rolling, Words, mix, row_of, slices, text_bytes

SAMPLE, BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 20_000, 64, 120, 4, 0.1, 1.0, 5.0
#: Bytes of text of a slice, and rows of one (each has a histogram of its bytes).
SLICE, ROWS = 1 << 20, 2000
WORD_RUNS = (1, 2, 5)
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "symbols", "punctuation", "digits", "capitals", "wide", "blanks", "newlines", "entropy",
    "word_length", "word_spread", "longest_word", "short_words", "capital_words", "initial_words", "symbol_words", "symbol_ends", "sentence_ends",
    "stutter", "top_word", "repeated_lines", "line_words", *(f"repeated_{k}" for k in WORD_RUNS),
)


def bytes_in(*codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[b for c in codes for b in (c if isinstance(c, (bytes, range)) else [c])]] = True
    return out


UPPER, LOWER, DIGIT, WIDE = bytes_in(range(65, 91)), bytes_in(range(97, 123)), bytes_in(range(48, 58)), bytes_in(range(0x80, 0x100))
MARKS, BLANK = bytes_in(b".,;:!?'\"()-"), bytes_in(b" \t\n\x0b\x0c\r")
SYMBOL = bytes_in(range(33, 127)) & ~(UPPER | LOWER | DIGIT | MARKS)
HEAD = ~bytes_in(range(0x80, 0xC0))  # bytes that begin a character
KINDS = np.stack([SYMBOL, MARKS, DIGIT, UPPER, WIDE, BLANK, bytes_in(b"\n")], axis=1).astype(np.float64)


def up_to(mask: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(mask)))


def repeated(names: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By row how many of the names stand there before, and how often the most frequent one stands there."""
    if not len(names):
        return np.zeros(n), np.zeros(n)
    own = mix(names + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 11)
    order = np.argsort(own, kind="stable")
    head = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
    count, rows = np.diff(np.append(head, len(own))), row[order[head]]
    top = np.zeros(n)
    np.maximum.at(top, rows, count)
    return np.bincount(rows, count - 1, n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    data, rows = text_bytes(texts)
    n, words = len(rows) - 1, Words(data, rows)
    sizes, count = np.diff(rows), words.per_row()
    histogram = np.bincount(np.repeat(np.arange(n), sizes) * 256 + data, minlength=256 * n).reshape(n, 256)
    some, many = np.maximum(sizes, 1), np.maximum(count, 1)
    share = np.where(histogram > 0, histogram / some[:, None], 1)
    row, at, end = row_of(words.rows, np.arange(len(words))), words.start, words.end
    by_word = lambda values: np.bincount(row, values, n) / many
    length = np.diff(up_to(HEAD[data])[np.stack([at, end])], axis=0)[0].astype(float)
    upper, lower, plain = (np.diff(up_to(m[data])[np.stack([at, end])], axis=0)[0] for m in (UPPER, LOWER | WIDE, UPPER | LOWER | WIDE | DIGIT))
    mean = by_word(length)
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    rolling = Rolling(BYTE_VALUE[data])
    names = rolling.span(at, end)
    same = np.zeros(len(words))
    same[1:] = (names[1:] == names[:-1]) & (row[1:] == row[:-1])
    first, last = data[at] if len(at) else data[:0], data[end - 1] if len(at) else data[:0]

    cuts = np.flatnonzero(data == 10)
    begin, until = np.sort(np.concatenate((rows[:-1], cuts + 1))), np.sort(np.concatenate((cuts, rows[1:])))
    in_word = up_to(~BLANK[data])
    full = in_word[until] > in_word[begin]
    begin, until = begin[full], until[full]
    owner = row_of(rows, begin)
    lines = np.bincount(owner, minlength=n)
    columns = [np.log1p(sizes), np.log1p(count), np.log1p(lines), *(histogram @ KINDS / some[:, None]).T, -(share * np.log2(share)).sum(axis=1)]
    columns += [mean, np.sqrt(np.maximum(by_word(length**2) - mean**2, 0)), np.log1p(longest), by_word(length <= 3), by_word((upper >= 2) & (lower == 0)), by_word(UPPER[first]), by_word(plain == 0), by_word(SYMBOL[last]), by_word((last == 0x2E) | (last == 0x3F) | (last == 0x21))]
    columns += [by_word(same), repeated(names, row, n)[1] / many, repeated(rolling.span(begin, until), owner, n)[0] / np.maximum(lines, 1), np.log1p(count / np.maximum(lines, 1))]
    runs = Rolling(names)
    for k in WORD_RUNS:
        start = np.flatnonzero(np.arange(len(words)) + k <= words.rows[row + 1])
        columns.append(repeated(runs.span(start, start + k), row[start], n)[0] / many)
    return np.stack(columns, axis=1)


@dataclass
class Forest:
    """base: log odds before any tree. feature, threshold, value: (trees, nodes); a node without a split leads left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.feature) or not len(x):
            return total
        tree, at = np.arange(len(self.feature)), np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            right = np.take_along_axis(x, self.feature[tree, at], 1) > self.threshold[tree, at]
            at = 2 * at + 1 + right
        return total + self.value[tree, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bin of each value, and the upper edges of the bins of each column: quantiles, each a value that occurs."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    return np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1), edges


def grow(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree (feature, threshold, value by node): level by level, each node at the split with the greatest gain."""
    n, columns = bins.shape
    nodes = (2 << DEPTH) - 1
    feature, threshold, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
    at, column = np.zeros(n, np.int64), np.arange(columns) * BINS
    for level in range(DEPTH):
        first, wide = (1 << level) - 1, 1 << level
        place = ((at - first)[:, None] * (columns * BINS) + column + bins).ravel()
        g, h = (np.bincount(place, np.repeat(v, columns), wide * columns * BINS).reshape(wide, columns, BINS) for v in (gradient, curvature))
        left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
        gain[(left_h < LEAST) | (right_h < LEAST)] = 0
        best = gain.reshape(wide, -1).argmax(axis=1)
        which, cut = best // BINS, best % BINS
        for k in np.flatnonzero(gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9):
            feature[first + k], threshold[first + k] = which[k], edges[which[k]][cut[k]]
        split = np.isfinite(threshold[at])
        right = split & (bins[np.arange(n), feature[at]] > cut[at - first])
        at = 2 * at + 1 + right
    value[:] = -RATE * np.bincount(at, gradient, nodes) / (np.bincount(at, curvature, nodes) + RIDGE)
    return feature, threshold, value


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """The forest for rows x with labels y (0 or 1)."""
    odds = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(odds / (1 - odds)))
    empty = np.zeros((0, (2 << DEPTH) - 1))
    if len(np.unique(y)) < 2:
        return Forest(base, empty.astype(np.int64), empty, empty)
    bins, edges = binned(x, BINS)
    raw, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grown.append(grow(bins, edges, p - y, p * (1 - p)))
        feature, threshold, value = (c[None] for c in grown[-1])
        raw = raw + Forest(0.0, feature, threshold, value).raw(x)
    return Forest(base, *(np.stack(c) for c in zip(*grown)))


def measured(text: int, then):
    """mapInArrow: what then makes of each batch of bounded size and its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                yield then(part, statistics(part.column(text)))

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """The forest from docs (doc_id, text) and labels (doc_id, quality). The sample of labels is of bounded size, and so sent to where the texts are."""
    labels = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    total = labels.count()
    if total > sample:
        labels = labels.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id")
    once = settle(rows.groupBy(F.xxhash64("text").alias("name"), F.length("text").alias("n")).agg(F.min_by("text", "doc_id").alias("text"), F.min("quality").alias("quality")))
    shape = "name long, quality int, x array<double>"
    found = once.select("name", "quality", "text").mapInArrow(measured(2, lambda b, x: pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["name", "quality", "x"])), shape)
    table = sorted((r.name, r.quality, tuple(r.x)) for r in found.collect())  # sample rows at most, in one order for all reruns
    return boost(np.array([r[2] for r in table]).reshape(-1, len(STATISTICS)), np.array([r[1] for r in table], float))


def score_quality(docs: DataFrame, forest: Forest, name: str = "quality") -> DataFrame:
    """docs with a score from 0 to 1 in a column of that name (one that is there already is replaced)."""
    docs = docs.drop(name)
    add = lambda b, x: pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(x))], [*b.schema.names, name])
    return docs.mapInArrow(measured(docs.columns.index("text"), add), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
