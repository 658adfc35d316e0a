"""Suffix-array dedup over bytes: a sparse, depth-limited radix sort of suffixes.

The key of a suffix is its window of `length` bytes. A sort of all suffixes would shuffle a row for each, hundreds of times
what this one does; so suffixes are sorted by way of anchors that neighbours share, and a group leaves as soon as it has
one member or is known to be equal throughout:

1. A window's anchor is the smallest gram of GRAM bytes in it (by fingerprint); equal windows have it at the same offset.
   The first digit is that of the suffix which starts at the anchor: its first GRAM bytes. Windows side by side share their
   anchor, so one row stands for about (length - GRAM) / 2 of them. An anchor's digit that stands nowhere else ends there;
   a run of windows all of whose bytes stand elsewhere too is settled as a whole. Inside a run of equal bytes, or of any
   shorter passage over and over, windows stand again a few bytes on; such a run costs a few rows, whatever its length.
2. Within the rest, the bytes around the anchor that 24 neighbouring windows have in common, cells being counted from it;
   then the same for 5 of them.
3. The window itself, for each suffix that is left.

Groups of equal keys after the last pass are exactly the repeated windows; keys are compared by two fingerprints (128
bits), the pass's and that of all bytes. Passes carry fingerprints and positions only; the texts are shuffled once, and
each later pass joins its open groups to that exchange.

Null texts are empty. Rows with a null doc_id take no part and keep their bytes. Rows with the same doc_id and text count
as one place. An empty table gives an empty result. Columns of docs that have the name of a result column are replaced
(names gives others); all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.places import KEY, PLACE, SPANS, TAG, Texts, judge, places, settled_runs, spans_of
from tickloom.llm.textkit import BYTE_VALUE, Rolling, covered, mix, ranges, row_of, slices, text_bytes

#: Bytes of an anchor, and how many neighbouring windows are one in the passes after the first.
GRAM, CELLS = 32, (24, 5)
#: Bytes of text of a slice; a dozen 8-byte values are held for each byte.
SLICE = 1 << 20


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the smallest of values[i : i + width], the first of equal ones; by minima of blocks from both sides."""
    n = len(values)
    bits = np.uint64(max(1, n.bit_length()))
    packed = (values & ~np.uint64((1 << int(bits)) - 1)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64((1 << 64) - 1))
    padded[:n] = packed
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - width + 1
    return (np.minimum(behind[:last], ahead[width - 1 : width - 1 + last]) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)


def first_digit(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy()
            whole, rows = text_bytes(batch.column(1))
            if len(rows) > 2:
                cuts = [(0, len(whole))]
            else:  # one text: a piece for each SLICE of windows
                cuts = [(k, min(k + SLICE + length - 1, len(whole))) for k in range(0, max(1, len(whole) - length + 1), SLICE)]
            for low, high in cuts:
                yield from digits(whole[low:high], rows if len(rows) > 2 else np.array([0, high - low]), low, ids, tags)

    def digits(data: np.ndarray, rows: np.ndarray, shift: int, ids: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
        count = np.maximum(np.diff(rows) - length + 1, 0)
        if not count.any():
            return
        values = BYTE_VALUE[data]
        rolling = Rolling(values)
        begin = np.arange(len(data) - gram + 1)
        grams = rolling.span(begin, begin + gram)
        start = ranges(rows[:-1], count)
        at = smallest(grams, length - gram + 1)[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(start)))
        s, at = start[head], at[head]
        row = row_of(rows, s)
        run = periodic(Rolling(values, 1), rolling, grams, s, n, at, row, length)
        place = ids[row], tags[row], s - rows[row] + shift, n, at - s
        if run.any():
            yield settled_runs(*place, run)
        keep = ~run
        yield places(grams[at[keep]], stretch(values, s[keep], (s + n - 1 + length)[keep], at[keep]), *(x[keep] for x in place), False)

    return run


def periodic(one: Rolling, two: Rolling, grams: np.ndarray, s: np.ndarray, n: np.ndarray, at: np.ndarray, row: np.ndarray, length: int) -> np.ndarray:
    """Which places are inside a run that repeats itself: all their windows start again in the next place, and that one's in the one after.

    The last two places of a run stay, which have all its windows; so a run of any length costs a few places.
    """
    again = np.zeros(len(s), bool)
    if len(s) > 2:
        a, step = slice(None, -1), at[1:] - at[:-1]
        near = (row[1:] == row[:-1]) & (s[1:] == s[:-1] + n[:-1]) & (grams[at[1:]] == grams[at[:-1]]) & (step > 0)
        # shifted by the step they lie in the next place
        near &= (s[a] + step + n[a] <= s[1:] + n[1:])
        k = np.flatnonzero(near)
        begin, end, step = s[k], s[k] + n[k] - 1 + length, step[k]
        again[k] = (one.span(begin, end) == one.span(begin + step, end + step)) & (two.span(begin, end) == two.span(begin + step, end + step))
    return again & np.append(again[1:], False)


def stretch(values: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of all bytes from start to end, and where the anchor is in them."""
    return mix(Rolling(values, 1).span(start, end) + (at - start + (1 << 20)).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def next_digit(length: int, cell: int, text: int):
    """cell 1: the last digit, each suffix for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            ids, tags = batch.column(batch.num_columns + KEY).to_numpy(), batch.column(batch.num_columns + TAG).to_numpy()
            data, rows = text_bytes(batch.column(text))
            row, first, count, at = spans_of(batch.column(batch.num_columns + SPANS))
            part = first // SLICE if len(rows) == 2 else 0 * first  # of one text only a piece at a time
            for k in np.unique(part):
                own = part == k
                begin = first[own] + rows[row[own]]
                low, high = int(begin.min()), int((begin + count[own] - 1 + length).max())
                yield from digits(data[low:high], rows[row[own]] - low, begin - low, count[own], at[own], ids[row[own]], tags[row[own]])

    def digits(data: np.ndarray, origin: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = at + first
        low = (first - at) // cell
        pieces = (first + count - 1 - at) // cell - low + 1
        k = np.repeat(low, pieces) + ranges(0 * pieces, pieces)
        origin, ids, tags, first, count, at = (np.repeat(x, pieces) for x in (origin, ids, tags, first, count, at))
        a = np.maximum(first, at + k * cell)
        b = np.minimum(first + count, at + (k + 1) * cell)
        values = BYTE_VALUE[data]
        common = Rolling(values).span(at + (k + 1) * cell - 1, at + k * cell + length)
        digit = mix(common + k.astype(np.uint64))
        yield places(digit, stretch(values, a, b - 1 + length, at), ids, tags, a - origin, b - a, at - a, False)

    return run


def repeats(texts: Texts, length: int) -> DataFrame:
    """Runs of suffixes whose first length bytes also start elsewhere."""
    gram = min(GRAM, max(1, length // 2))
    found = judge(texts.plain().mapInArrow(first_digit(length, gram), PLACE), False)
    gone = found.where("gone")
    for cell in (*(min(c, max(1, (length - gram) // 4)) for c in CELLS), 1):
        rows = texts.with_places(found.where("open"), "inner").mapInArrow(next_digit(length, cell, texts.text), PLACE)
        found = judge(rows, False)
        gone = gone.unionByName(found.where("gone"))
    return gone


RESULTS = ("kept", "n_bytes", "n_removed", "removed", "n_noted")
TYPES = (T.BinaryType(), T.LongType(), T.LongType(), T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])), T.LongType())


def cut(length: int, noted: int, text: int, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            data, rows = text_bytes(batch.column(text))
            row, start, count, _ = spans_of(batch.column(batch.num_columns + SPANS))
            start = start + rows[row]
            goes, count = count > 0, np.abs(count)
            gone = covered(len(data), start[goes], (start + count - 1 + length)[goes])
            total = np.concatenate(([0], np.cumsum(gone)))
            removed = total[rows[1:]] - total[rows[:-1]]
            seen = np.concatenate(([0], np.cumsum(covered(len(data), start[~goes], (start + count - 1 + noted)[~goes]))))
            first, last = gone.copy(), gone.copy()
            first[1:] &= ~gone[:-1]
            last[:-1] &= ~gone[1:]
            inner = rows[1:-1][(rows[1:-1] > 0) & (rows[1:-1] < len(data))]
            first[inner], last[inner - 1] = gone[inner], gone[inner - 1]
            a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
            owner = row_of(rows, a)
            runs = pa.StructArray.from_arrays([pa.array(a - rows[owner]), pa.array(b - rows[owner])], ["start", "end"])
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=batch.num_rows)))).astype(np.int32)
            kept = np.concatenate(([0], np.cumsum(np.diff(rows) - removed))).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(kept), pa.py_buffer(data[~gone])])
            results = [texts, pa.array(np.diff(rows)), pa.array(removed), pa.ListArray.from_arrays(pa.array(ends), runs), pa.array(seen[rows[1:]] - seen[rows[:-1]])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *results], names=[*batch.schema.names[:-4], *names])

    return run


def suffix_dedup(docs: DataFrame, length: int = 400, noted: int = 0, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """docs with kept (the bytes that stay), n_bytes, n_removed, removed (the maximal spans that went, in bytes) and n_noted.

    A byte goes if a string of length bytes of its text covers it that also starts anywhere else, in any text, its own
    included. Strings are judged on the input. Every occurrence goes, the first too. noted: a second, shorter length;
    bytes that such strings cover are counted as n_noted, but stay (0: none are).
    """
    texts = Texts(docs.drop(*names))
    rows = repeats(texts, length)
    if noted:  # told apart by the sign of windows; all columns of both stay in use, so that their exchanges are used again
        rows = rows.unionByName(repeats(texts, noted).withColumn("windows", -F.col("windows")))
    joined = texts.with_places(rows, "left")
    schema = T.StructType([*texts.docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, TYPES))])
    return joined.mapInArrow(cut(length, noted, texts.text, names), schema)
