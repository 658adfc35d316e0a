"""Substring dedup by recompression, over words.

A corpus is parsed bottom-up. Each round names something for the whole corpus by a fingerprint of its content: first
the runs of one word, then, round by round, the pairs of neighbours of which the left is on the left side and the right
on the right side of a partition of all names (a bit of the name's fingerprint, drawn anew each round). What a name
stands for depends on nothing but its content, so equal substrings get the same symbols in their interior; only a symbol
at either edge can depend on what stands outside, in each round at most one.

After ROUNDS rounds each window of `length` words is represented by a *mark*: the smallest name of PHRASE symbols in a
row among those that are certain whatever stands outside the window (of single words, if long runs leave no such phrase).
Equal windows have equal marks at the same offset, so windows need comparing only where a mark is shared. Neighbouring
windows with the same mark form a *stretch* (mark, fingerprint of all its words). One row per stretch is shuffled, about
one for six words (and a few for a run of the same passage over and over): a stretch that stands earlier is removed as a whole, a mark that stands nowhere else ends there, and
only first stretches that share their mark with a different stretch are opened into single windows. Windows and stretches
count as equal if two fingerprints agree (128 bits).

Rows with a null doc_id or text have no windows. Rows with the same doc_id count as one place: they don't repeat each
other. Empty tables give empty results. Columns of docs that have the name of a result
column are replaced (names gives others); all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.places import KEY, PLACE, SPANS, TAG, Texts, judge, places, settled_runs, spans_of
from tickloom.llm.textkit import Rolling, Words, covered, mix, ranges, row_of, slices, text_bytes

ROUNDS = 3
PHRASE = 3


def window_marks(names: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of length words inside one row: where it starts, its mark, and the word at which the mark starts."""
    count = np.maximum(np.diff(rows) - length + 1, 0)
    start = ranges(rows[:-1], count)
    mark, at = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    low, high = start.copy(), start + length  # symbols low .. high - 1 are certain
    symbol, begins = mix(names, 1), np.arange(len(names))
    row = row_of(rows, begins)
    pick(mark, at, slice(None), symbol, begins, low, high, 1)
    for k in range(ROUNDS):
        if k == 0:  # runs of one word; a run at an edge may go on outside
            new = np.ones(len(symbol), bool)
            new[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
            number, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            times = np.diff(np.append(heads, len(symbol)))
            named = mix(symbol[heads] + times.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 2)
            low, high = number[low] + 1, number[high - 1]
        else:  # pairs across the partition; a right one at the left edge, or a left one at the right edge, may pair outside
            right = (mix(symbol, 100 + k) & np.uint64(1)).astype(bool)
            second = np.zeros(len(symbol), bool)
            second[1:] = right[1:] & ~right[:-1] & (row[1:] == row[:-1])
            number, heads = np.cumsum(~second) - 1, np.flatnonzero(~second)
            named = symbol[heads]
            pair = heads[number[second]]
            named[number[second]] = mix(symbol[pair] * np.uint64(0xE7037ED1A0B428DB) + symbol[pair + 1], 200 + k)
            low, high = number[low] + right[low], number[np.maximum(high - 1, 0)] + right[np.maximum(high - 1, 0)]
        low, high = np.minimum(low, len(heads) - 1), np.maximum(high, 0)
        symbol, begins, row = named, begins[heads], row[heads]
    phrase = symbol.copy()
    for k in range(1, PHRASE):
        phrase[:-k] = mix(phrase[:-k] * np.uint64(0xE7037ED1A0B428DB) + symbol[k:], 300)
    full = np.flatnonzero(high - low >= PHRASE)
    pick(mark, at, full, phrase, begins, low[full], high[full] - PHRASE + 1, 3)
    return start, mark, at


def pick(mark: np.ndarray, at: np.ndarray, where, names: np.ndarray, begins: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int) -> None:
    """Sets the mark of each window to the smallest of names[low:high], the first if there are several."""
    if not len(low):
        return
    size = high - low
    best = np.arange(len(names))
    found = np.zeros(len(low), np.int64)
    k = 0
    while True:
        now = (size >= 1 << k) & (size < 2 << k)
        a, b = best[low[now]], best[high[now] - (1 << k)]
        found[now] = np.where(names[a] <= names[b], a, b)
        if not (size >= 2 << k).any():
            break
        a, b = best[: -(1 << k)], best[1 << k :]
        best = np.where(names[a] <= names[b], a, b)
        k += 1
    mark[where], at[where] = mix(names[found], seed), begins[found]


def stretches(length: int):
    """mapInArrow: the stretches of each slice; of those alike within a slice only the first is left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy()
            words = Words(*text_bytes(batch.column(1)))
            names = words.hashes()
            start, mark, at = window_marks(names, words.rows, length)
            if not len(start):
                continue
            row = row_of(words.rows, start)
            new = np.ones(len(start), bool)
            new[1:] = (mark[1:] != mark[:-1]) | (at[1:] != at[:-1]) | (row[1:] != row[:-1])
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(start)))
            s = start[head]
            two = Rolling(mix(names, 7), 1)
            run = periodic(Rolling(names), two, mark[head], s, n, at[head], row[head], length)
            place = ids[row[head]], tags[row[head]], s - words.rows[row[head]], n, 0 * n
            if run.any():
                yield settled_runs(*place, run)
            keep = ~run
            whole = two.span(s, s + n - 1 + length)
            whole = mix(whole + (at[head] - s).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
            yield places(mark[head][keep], whole[keep], *(x[keep] for x in place))

    return run


def periodic(one: Rolling, two: Rolling, mark: np.ndarray, s: np.ndarray, n: np.ndarray, at: np.ndarray, row: np.ndarray, length: int) -> np.ndarray:
    """Which stretches are inside a run that repeats itself: all their windows start in the stretch before too, and that one's in the one before it.

    The first two stretches of a run stay, which have all its windows; so a run of any length costs a few stretches.
    """
    again = np.zeros(len(s), bool)
    if len(s) > 2:
        step = at[1:] - at[:-1]
        near = (row[1:] == row[:-1]) & (s[1:] == s[:-1] + n[:-1]) & (mark[1:] == mark[:-1]) & (step > 0)
        # shifted back by the step they lie in the stretch before
        near &= (s[1:] - step >= s[:-1]) & (s[1:] + n[1:] - step <= s[1:])
        k = np.flatnonzero(near) + 1
        begin, end, step = s[k], s[k] + n[k] - 1 + length, step[k - 1]
        again[k] = (one.span(begin, end) == one.span(begin - step, end - step)) & (two.span(begin, end) == two.span(begin - step, end - step))
    return again & np.append(False, again[:-1])


def windows(length: int, text: int):
    """mapInArrow over keyed texts with __spans: the single windows of the stretches to be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            ids, tags = batch.column(batch.num_columns + KEY).to_numpy(), batch.column(batch.num_columns + TAG).to_numpy()
            words = Words(*text_bytes(batch.column(text)))
            names = words.hashes()
            row, first, count, _ = spans_of(batch.column(batch.num_columns + SPANS))
            start = ranges(first + words.rows[row], count)
            row = np.repeat(row, count)
            if len(start):
                one, two, ones = Rolling(names), Rolling(mix(names, 7), 1), np.ones(len(start), np.int64)
                yield places(one.span(start, start + length), two.span(start, start + length), ids[row], tags[row], start - words.rows[row], ones, 0 * ones)

    return run


def repeats(texts: Texts, length: int) -> DataFrame:
    """Places whose windows stand earlier (smaller doc_id, or earlier in the same document)."""
    judged = judge(texts.plain().mapInArrow(stretches(length), PLACE))
    single = texts.with_places(judged.where("open"), "inner").mapInArrow(windows(length, texts.text), PLACE)
    return judged.where("gone").unionByName(judge(single).where("gone"))


def cut(length: int, text: int, names: tuple[str, ...]):
    """mapInArrow over (..., text, spans): the kept words of each text, joined by one space, and how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = Words(*text_bytes(batch.column(text)))
            row, start, count, _ = spans_of(batch.column(batch.num_columns + SPANS))
            start = start + words.rows[row]
            gone = covered(len(words), start, start + count - 1 + length)
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[words.rows[1:]] - total[words.rows[:-1]]
            results = [words.joined(~gone), pa.array(words.per_row()), pa.array(removed)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *results], names=[*batch.schema.names[:-4], *names])

    return run


RESULTS = ("kept_text", "n_words", "n_removed")
TYPES = (T.StringType(), T.LongType(), T.LongType())


def substring_dedup(docs: DataFrame, length: int = 20, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """docs with kept_text (the words that stay, joined by one space), n_words and n_removed.

    A word goes if a window of length consecutive words of its document covers it whose words also start earlier: in a
    document with a smaller doc_id, or earlier in the same one. Windows are judged on the input.
    """
    texts = Texts(docs.drop(*names))
    joined = texts.with_places(repeats(texts, length), "left")
    schema = T.StructType([*texts.docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, TYPES))])
    return joined.mapInArrow(cut(length, texts.text, names), schema)
