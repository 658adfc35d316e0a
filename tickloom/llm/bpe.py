"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Texts are cut into pre-tokens with their positions. A chunk of texts (CHUNK bytes) keeps each of its distinct
   pre-tokens once, and each text as the sequence of their numbers.
2. The distinct pre-tokens of all chunks are shuffled by content, so that all equal ones meet; each is encoded once.
3. Ids go back to the chunks that asked for them and are joined to the texts' sequences, position by position.

A chunk is named by a fingerprint of its distinct pre-tokens. The texts are read twice (for 2 and for 3), which is
cheaper than to keep the sequences. So the rows must come in the same partitions and order both times, which files and
checkpoints do but shuffles don't: unless the caller says that its texts are settled, they are checkpointed first. Decoding joins each id to the token-byte table (the vocabulary, of fixed size) and joins
the bytes in order.

Null texts count as empty and have no ids. Rows may repeat a doc_id or have none; each input row gives one output row.
An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import settle
from tickloom.llm.textkit import BYTE_VALUE, Rolling, mix, ranges, signed, slices, text_bytes

#: The pre-token pattern that pretokens() finds. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points of white space (the Unicode property). Fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK, SLICE = 16 << 20, 2 << 20
#: Ids of an output batch.
OUT = 1 << 18
#: Bytes of text for each part of the distinct words, and words whose ids a task keeps at a time (if a part has more, some are encoded again).
PART, KEPT = 64 << 20, 1_000_000
LETTER, NUMBER, OTHER, BLANK = range(4)


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@cache
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def kinds(points: np.ndarray) -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK of each code point."""
    seen = np.flatnonzero(np.bincount(points)) if len(points) else points
    of = {"L": LETTER, "N": NUMBER}
    table = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.uint8)
    table[seen] = [BLANK if p in WHITE else of.get(unicodedata.category(chr(p))[0], OTHER) for p in seen.tolist()]
    return table[points]


def pretokens(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The byte at which each pre-token begins; they cover every byte of every row."""
    if not len(data):
        return np.zeros(0, np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = kinds(points)
    n = len(points)
    edge = np.zeros(n + 1, bool)  # a row begins
    edge[np.searchsorted(place, rows)] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    kind = kind[start]
    blank = kind == BLANK
    followed = np.append(~edge[start[1:]], False)  # by a run of the same row
    # the last blank before a word goes with it if it is a space, and stands alone if not
    led = np.zeros(len(start), bool)
    led[1:] = followed[:-1] & blank[:-1] & (points[end[:-1] - 1] == 0x20)
    begins = np.zeros(n, bool)
    begins[start[~blank & ~led]] = True
    begins[start[led] - 1] = True
    begins[start[blank & ((end - start > 1) | ~followed)]] = True
    alone = blank & followed
    alone &= points[end - 1] != 0x20
    begins[end[alone] - 1] = True
    # contractions: one apostrophe, not led by a space, before letters
    mark = np.flatnonzero((kind == OTHER) & (end - start == 1) & (points[start] == 0x27) & ~led & followed)
    mark = mark[kind[np.minimum(mark + 1, len(kind) - 1)] == LETTER]
    if len(mark):
        at = start[mark]
        one = points[at + 1]
        two = points[np.minimum(at + 2, n - 1)]
        long = end[mark + 1] - at > 2
        size = np.where(np.isin(one, [0x73, 0x74, 0x6D, 0x64]), 1, 0)
        pair = long & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        size[pair] = 2
        at, size, stop = at[size > 0], size[size > 0], end[mark[size > 0] + 1]
        begins[at + 1] = False
        rest = at + 1 + size
        begins[rest[rest < stop]] = True
    return place[begins]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays (of int32, but for a last one of bytes) in one compressed value."""
    raw = np.array([len(arrays), *(len(a) for a in arrays)], np.int32).tobytes() + b"".join(a.astype(np.int32).tobytes() if a.dtype != np.uint8 else a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(value: bytes, last_bytes: bool = False) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], int.from_bytes(value[:8], "little"), "zstd", asbytes=True)
    k = int(np.frombuffer(raw, np.int32, 1)[0])
    sizes = np.frombuffer(raw, np.int32, k, 4)
    out, at = [], 4 + 4 * k
    for i, n in enumerate(sizes.tolist()):
        narrow = last_bytes and i == k - 1
        out.append(np.frombuffer(raw, np.uint8 if narrow else np.int32, n, at))
        at += n if narrow else 4 * n
    return out


class Chunk:
    """Texts that share one list of distinct pre-tokens."""

    def __init__(self):
        self.size, self.parts = 0, []

    def add(self, batch: pa.RecordBatch) -> None:
        data, rows = text_bytes(batch.column(1))
        start = pretokens(data, rows)
        names = Rolling(BYTE_VALUE[data]).span(start, np.append(start[1:], len(data)))
        found, first, number = np.unique(names, return_index=True, return_inverse=True)
        ends = np.append(start[1:], len(data))[first]
        sizes = ends - start[first]
        letters = data[ranges(start[first], sizes)]
        self.parts.append((batch.column(0), np.searchsorted(start, rows), number.astype(np.int32), found, sizes, letters))
        self.size += len(data)

    def close(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Its name, the distinct pre-tokens' fingerprints, and for all those of the parts, one after another, their number."""
        found = np.concatenate([p[3] for p in self.parts])
        names, number = np.unique(found, return_inverse=True)
        self.first = np.full(len(names), len(found))
        np.minimum.at(self.first, number, np.arange(len(found)))
        label = mix(mix(names, 3).sum(keepdims=True) + np.uint64(len(names)))
        return int(signed(label)[0]), names, number

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and bytes of the distinct pre-tokens, in order of their numbers."""
        sizes = np.concatenate([p[4] for p in self.parts])
        letters = np.concatenate([p[5] for p in self.parts])
        begin = np.cumsum(sizes) - sizes
        return sizes[self.first], letters[ranges(begin[self.first], sizes[self.first])]

    def texts(self, number: np.ndarray) -> Iterator[tuple[pa.Array, list[bytes]]]:
        begin = 0
        for ids, rows, codes, found, _, _ in self.parts:
            codes = number[begin : begin + len(found)][codes]
            begin += len(found)
            yield ids, [pack(codes[a:b]) for a, b in zip(rows, rows[1:])]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in slices(batches, limit=SLICE):
        chunk.add(batch)
        if chunk.size >= CHUNK:
            yield chunk
            chunk = Chunk()
    if chunk.parts:
        yield chunk


def distinct_words(parts: int):
    """mapInArrow: the distinct pre-tokens of each chunk, dealt by content to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            label, names, _ = chunk.close()
            sizes, letters = chunk.words()
            begin = np.cumsum(sizes) - sizes
            part = (mix(names, 4) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
            values = [pack(own, sizes[own], letters[ranges(begin[own], sizes[own])]) for own in np.split(order, heads[1:])] if len(part) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[heads], pa.int64()), pa.array([label] * len(values), pa.int64()), pa.array(values, pa.binary())], ["part", "chunk", "words"])

    return run


def encode_words(path: str):
    """mapInArrow over (part, chunk, words), sorted by part: each distinct pre-token of a part is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary  # a pre-token alone is one match of the pattern
        part, known = None, {}
        for batch in batches:
            values = []
            for own, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != part:
                    part, known = own, {}
                places, sizes, letters = unpack(value, True)
                letters, ends = letters.tobytes(), np.cumsum(sizes).tolist()
                ids, counts, begin = [], [], 0
                for end in ends:
                    word = letters[begin:end]
                    begin = end
                    have = known.get(word)
                    if have is None:
                        if len(known) >= KEPT:
                            known.clear()
                        have = known[word] = encode(word.decode())
                    ids += have
                    counts.append(len(have))
                values.append(pack(places, np.array(counts, np.int32), np.array(ids, np.int32)))
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([0] * len(values), pa.int32()), nothing, nothing, pa.array(values, pa.binary())], ["chunk", "kind", "doc_id", "words", "value"])

    return run


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: each text as the numbers of its pre-tokens in its chunk."""
    for chunk in chunks(batches):
        label, names, number = chunk.close()
        for ids, values in chunk.texts(number):
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array([label] * n, pa.int64()), pa.array([1] * n, pa.int32()), ids, pa.array([len(names)] * n, pa.int64()), pa.array(values, pa.binary())], ["chunk", "kind", "doc_id", "words", "value"])


def assemble(path: str | None):
    """mapInArrow over ids and texts of chunks, sorted by chunk, ids first: the ids of each text in order; with a path, their bytes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, table = None, [], None
        for batch in batches:
            docs, lists, total = [], [], 0
            for k in range(batch.num_rows):
                label, kind, doc, words = (batch.column(c)[k].as_py() for c in range(4))
                value = batch.column(4)[k].as_py()
                if label != chunk:
                    chunk, held, table = label, [], None
                if kind == 0:
                    held.append(unpack(value))
                    continue
                if table is None:
                    table, held = joined(held), []
                begin, counts, ids = table
                if len(begin) != words:
                    raise RuntimeError("a chunk of texts has changed between two readings of the source")
                codes = unpack(value)[0]
                docs.append(doc)
                lists.append(ids[ranges(begin[codes], counts[codes])])
                total += len(lists[-1])
                if total >= OUT:
                    yield from listed(docs, lists, path)
                    docs, lists, total = [], [], 0
            yield from listed(docs, lists, path)

    return run


def joined(held: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ids of each pre-token of a chunk begin, their number, and all ids."""
    if not held:
        return (np.zeros(0, np.int64),) * 3
    places, counts, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
    begin = np.cumsum(counts.astype(np.int64)) - counts
    places, first = np.unique(places, return_index=True)
    return begin[first], counts[first].astype(np.int64), ids


def listed(docs: list, lists: list[np.ndarray], path: str | None) -> Iterator[pa.RecordBatch]:
    if docs:
        ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
        ids = np.concatenate(lists)
        columns = [pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns + ([token_bytes(path, ids, ends)] if path else []), ["doc_id", "ids", "decoded"][: 3 if path else 2])


@cache
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token's bytes begin, their number, and all bytes."""
    tokens = sorted(ranks(path).items(), key=lambda x: x[1])
    sizes = np.zeros(tokens[-1][1] + 1, np.int64)
    sizes[[k for _, k in tokens]] = [len(t) for t, _ in tokens]
    return np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)


def token_bytes(path: str, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the tokens of each list of ids, one after another."""
    begin, sizes, letters = token_table(path)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
        raise ValueError("an id has no token")
    at = np.concatenate(([0], np.cumsum(sizes[ids])))[ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at), pa.py_buffer(letters[ranges(begin[ids], sizes[ids])])])


def encode(docs: DataFrame, path: str, parts: int | None = None, decoded: bool = False, settled: bool = False) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text by the ranks in path, without special tokens.

    decoded: also that column, as decode() adds it, while the ids are at hand. settled: docs is read from files or a
    checkpoint, with nothing but row-wise steps since, and so needs no checkpoint of its own.

    parts: into how many the distinct pre-tokens are dealt; a part's are held in one task, one part at a time. If not
    given one for PART bytes of text, and as many as shuffle partitions at least.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not settled:
        texts = settle(texts)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(least, -(-size // PART))
    dealt = lambda frame, key: (frame.repartition(parts, key) if parts > least else frame.repartition(key))
    words = dealt(texts.mapInArrow(distinct_words(parts), "part long, chunk long, words binary"), "part").sortWithinPartitions("part")
    shape = "chunk long, kind int, doc_id long, words long, value binary"
    both = words.mapInArrow(encode_words(path), shape).unionByName(texts.mapInArrow(sequences, shape))
    return dealt(both, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(assemble(path if decoded else None), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (with a column ids) and decoded, the bytes of its ids in order. An id without a token fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(count))).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            part = at // OUT
            cuts = [0, *(np.flatnonzero(np.diff(part[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:]):
                data = token_bytes(path, ids[at[a] : at[b]], at[a : b + 1] - at[a])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, data], [*batch.schema.names, "decoded"])

    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
