"""Vectorised helpers for Arrow batches of text: words, rolling hashes, slices of bounded size.

Everything here works on one slice of one Arrow batch inside a task; nothing keeps state between slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a slice aims for; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20
MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multipliers of the two rolling hashes, and a random value for each byte.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}
POWERS = 1 << 14


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, xor): spreads every bit of x over all bits."""
    x = x + np.uint64((seed * BASES[0] + 0x632BE59BD9B4E019) & MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; what is kept between calls is a table of POWERS entries."""
    low = _powers.get(base)
    if low is None:
        low = _powers[base] = run_of(base, POWERS)
    if n <= POWERS:
        return low[:n]
    return np.multiply.outer(run_of(pow(base, POWERS, 1 << 64), -(-n // POWERS)), low).ravel()[:n]


def run_of(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any span of a sequence in constant time, from prefix sums of value * base ** position."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.base = BASES[which]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(self.base, len(values)), out=self.sums[1:])
        self.back = powers(pow(self.base, -1, 1 << 64), len(values) + 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal spans wherever they stand; the length is mixed in."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after another, and where each row begins (one more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text, so that a task's memory doesn't follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of the rows of a slice: byte spans, and the range of words of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        first[edge] = inside[edge]
        edge = offsets[1:][offsets[1:] > 0] - 1
        last[edge] = inside[edge]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.start, offsets)  # word numbers at which rows begin

    def __len__(self) -> int:
        return len(self.start)

    def per_row(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        return Rolling(BYTE_VALUE[data]).span(self.start, self.end)

    def joined(self, keep: np.ndarray) -> pa.Array:
        """The words to be kept of each row, joined by one space."""
        total = np.concatenate(([0], np.cumsum(keep)))
        start, size = self.start[keep], (self.end - self.start)[keep] + 1
        ends = np.cumsum(size)
        out = np.append(self.data, np.uint8(0))[ranges(start, size)]
        out[ends - 1] = 0x20
        last = total[self.rows[1:]]
        some = last > total[self.rows[:-1]]
        out = np.delete(out, ends[last[some] - 1] - 1)
        sizes = np.concatenate(([0], ends))
        lengths = sizes[last] - sizes[total[self.rows[:-1]]] - some
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(out))


def trimmed(word: str, inside) -> str:
    """word without what isn't inside at either end, by position: in linear time, whatever stands between."""
    low, high = 0, len(word)
    while low < high and not inside(word[low]):
        low += 1
    while high > low and not inside(word[high - 1]):
        high -= 1
    return word[low:high]


def row_of(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row to which each position belongs."""
    return np.searchsorted(rows, at, "right") - 1


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the next."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(start, count)


def covered(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True where any of the spans covers a position."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, end, -1)
    return np.cumsum(marks[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
