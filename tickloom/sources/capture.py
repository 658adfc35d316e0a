"""Packet captures: records, UDP payloads, packet headers and message frames, each a DataFrame.

A capture file is cut into ranges of bytes, each read by a task of its own. Records have no marks to find them by, so each
range guesses where its first record begins, and a guess counts only if the range before ends there. What is malformed ends
the file or the packet that it is in, as far as it came, and is counted by reason; it never fails the job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import scan
from tickloom.operators.jumps import settled

#: Magic numbers of capture files: byte order, and fractions of a second that make a microsecond. Fixed values.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
ETHERNET, COOKED = 1, 113
LARGEST = 65_535
#: Schema, highest version and templates that are accepted. Fixed values.
SCHEMA, VERSION = 2, 16
TEMPLATES = (0, 1, 2, 3, 5, 9, 10, 11, 12, 15, 16, 17, 19, 21, 22, 24, 25, 27, 28, 29, 30, 50, 51, 52, 53, 54, 55, 56, 57, 71)
#: Bytes of a range; records in a row that must look right where a range guesses its first; the place of a file's first record.
RANGE, CHAIN, FIRST = 64 << 20, 5, 24
#: Where a range ends if the file ended in it, for good or bad: no record follows.
OVER = -1
RECORDS = "file string, n long, ts_us long, size int, port int, payload binary, problem string"
FRAMES = "frame int, template int, block_length int, schema int, version int, length int, frame_problem string"


def udp_payload(frame: bytes, link: int) -> tuple[int | None, bytes | None]:
    """Destination port and payload of a UDP packet in an Ethernet frame (with VLAN tags) or a cooked one; None if it is no such."""
    if link == ETHERNET:
        at = 12
        while frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
            at += 4
        at += 2
    elif link == COOKED:
        at = 16
    else:
        return None, None
    if at >= len(frame):
        return None, None
    udp = at + (frame[at] & 15) * 4
    if udp - at < 20 or udp + 8 > len(frame):
        return None, None
    return int.from_bytes(frame[udp + 2 : udp + 4], "big"), frame[udp + 8 :]


class Header:
    """Byte order, fractions of a second that make a microsecond, and link type of a capture; none if it is no capture."""

    def __init__(self, content: bytes):
        self.known = content[:4] in MAGIC and len(content) >= FIRST
        if self.known:
            self.order, self.part = MAGIC[content[:4]]
            self.link = struct.unpack(self.order + "I", content[20:24])[0]


def records_between(head: Header, data: bytes, base: int, length: int, at: int, end: int) -> Iterator[tuple[int, tuple]]:
    """Of a file of so many bytes the records that begin in [at, end): where each ends (OVER: nothing follows), and (ts_us, size, port, payload, problem).

    data begins at the byte base and holds all that these records need.
    """
    while at < end:
        if at + 16 > length:
            yield OVER, (0, 0, None, None, "truncated")
            return
        seconds, fraction, size, _ = struct.unpack_from(head.order + "IIII", data, at - base)
        at += 16
        if size > LARGEST or at + size > length:
            yield OVER, (0, 0, None, None, "malformed" if size > LARGEST else "truncated")
            return
        port, payload = udp_payload(data[at - base : at - base + size], head.link)
        at += size
        yield at if at < length else OVER, (seconds * 1_000_000 + fraction // head.part, size, port, payload, None if payload is not None else "no payload")


def records_of(content: bytes) -> Iterator[tuple[int, int, int | None, bytes | None, str | None]]:
    """(ts_us, size, port, payload, problem) of each record; a last one with a problem if the file doesn't end well."""
    head = Header(content)
    if not head.known:
        yield 0, 0, None, None, "no capture"
        return
    for _, row in records_between(head, content, 0, len(content), FIRST, len(content)):
        yield row


def guessed(head: Header, data: bytes, base: int, length: int, low: int, high: int) -> int | None:
    """The first place in [low, high) where CHAIN records in a row, or all that is left of the file, look right."""
    raw = np.frombuffer(data, np.uint8)[low - base :].astype(np.int64)
    count = min(high - low, len(raw) - 15)
    if count <= 0:
        return None
    word = lambda k: sum(raw[k + j : k + j + count] << (8 * j if head.order == "<" else 24 - 8 * j) for j in range(4))
    second = 1_000_000 * head.part
    likely = (word(4) < second) & (word(8) <= LARGEST) & (word(8) <= word(12)) & (word(8) > 0)
    for start in np.flatnonzero(likely) + low:
        at = int(start)
        for _ in range(CHAIN):
            if at == length or at + 16 - base > len(data):
                break
            _, fraction, size, whole = struct.unpack_from(head.order + "IIII", data, at - base)
            if fraction >= second or not 0 < size <= min(LARGEST, whole) or at + 16 + size > length:
                at = -1
                break
            at += 16 + size
        if at >= 0:
            return int(start)
    return None


def bytes_of(file: str, low: int, high: int) -> tuple[Header, bytes]:
    """A file's header, and its bytes in [low, high)."""
    place = file.removeprefix("file:")
    system, name = (fs.LocalFileSystem(), "/" + place.lstrip("/")) if place.startswith("/") else fs.FileSystem.from_uri(file)
    with system.open_input_file(name) as handle:
        head = Header(handle.read_at(FIRST, 0))
        return head, handle.read_at(max(0, high - low), low)


def opened(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Each range (file, length, low, entry, first) with its file's header, its bytes and its end."""
    for batch in batches:
        for row in batch.to_pylist():
            end = min(row["length"], row["low"] + size)
            begin = row["low"] if row["entry"] is None else end if row["entry"] == OVER else max(row["entry"], row["low"])
            head, data = bytes_of(row["file"], begin, min(row["length"], end + 16 + LARGEST) if begin < end else begin)
            yield row, head, data, begin, end


def boundaries(ranges: DataFrame, size: int) -> DataFrame:
    """ranges (file, length, low, entry) with exit and n: where the record after their last begins, and how many they have; an entry that is null is guessed."""
    shape = "file string, length long, low long, entry long, exit long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, head, data, begin, end in opened(batches, size):
            entry, n = row["entry"], 0
            if entry is None and row["low"] == 0:
                entry = FIRST
            elif entry is None and head.known:
                entry = guessed(head, data, begin, row["length"], row["low"], end)
            entry = OVER if entry is None or not head.known else entry
            exit_ = entry
            if entry != OVER:
                for exit_, _ in records_between(head, data, begin, row["length"], entry, end):
                    n += 1
            if row["low"] == 0 and (not head.known or row["length"] == FIRST):
                n, exit_ = int(not head.known), OVER
            yield pa.RecordBatch.from_pylist([{**{k: row[k] for k in ("file", "length", "low")}, "entry": entry, "exit": exit_, "n": n}], pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in shape.split(", ")]))

    return ranges.select("file", "length", "low", "entry").mapInArrow(run, shape)


def located(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, length, low, entry, exit, n, first) of each range of the files: where its first record begins, where the next range's does, how many it has, and the place in the file of the first.

    Where a guess isn't what the range before says, the range is walked again from there, in rounds, until all agree. So the
    result is that of one walk through the file, whatever was guessed.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")  # no content
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(size).cast("long"))).alias("low"), F.lit(None).cast("long").alias("entry"))
    parts = max(1, min(ranges.count(), 100_000))
    found = settled(boundaries(ranges.repartition(parts), size))
    own = Window.partitionBy("file").orderBy("low")  # the ranges of one file
    while True:
        due = settled(found.withColumn("due", F.coalesce(F.lag("exit").over(own), "entry")))
        wrong = due.where("entry <> due")
        n = wrong.count()
        if not n:
            break
        again = wrong.select("file", "length", "low", F.col("due").alias("entry")).repartition(n)
        found = settled(due.where("entry = due").drop("due").unionByName(boundaries(again, size)))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def read_captures(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Records of all capture files in path: file, n (its place in the file), ts_us, size, port, payload and problem.

    An empty file has no rows. size: bytes of a range; a task holds one range at a time and what its last record needs beyond it. Bytes are read twice:
    to find where ranges begin, and for the records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, head, data, begin, end in opened(batches, size):
            if not head.known:
                yield batch_of([(row["file"], 0, 0, 0, None, None, "no capture")])
                continue
            rows = []
            for n, (_, record) in enumerate(records_between(head, data, begin, row["length"], row["entry"], end)):
                rows.append((row["file"], row["first"] + n, *record))
                if len(rows) == 10_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    ranges = located(spark, path, size).where("n > 0").select("file", "length", "low", "entry", "first")
    return ranges.repartition(max(1, min(ranges.count(), 100_000))).mapInArrow(run, RECORDS)


def number(payload: Column, at: int, size: int) -> Column:
    """A little-endian whole number at a byte of a binary column; null if it isn't all there."""
    digits = F.concat(*(F.hex(F.substring(payload, at + k + 1, 1)) for k in reversed(range(size))))
    return F.when(F.octet_length(payload) >= at + size, F.conv(digits, 16, 10).cast("decimal(20,0)").cast("bigint" if size < 8 else "decimal(20,0)"))


def packet_headers(records: DataFrame, payload: str = "payload") -> DataFrame:
    """records with channel, seq_version, packet_seq and sending_time_ns of the 16-byte header; null if it isn't all there."""
    column = F.when(F.octet_length(payload) >= 16, F.col(payload))
    return records.withColumns({"channel": number(column, 0, 1), "seq_version": number(column, 2, 2), "packet_seq": number(column, 4, 4), "sending_time_ns": number(column, 8, 8).cast("bigint")})


def frames(records: DataFrame, payload: str = "payload", skip: int = 16) -> DataFrame:
    """Messages of each packet, one row each: place, header numbers and length. A frame that is cut or too small ends its packet, with a row that has a frame_problem (truncated, malformed) and no numbers.

    After skip bytes a packet holds frames: a 4-byte header (its length, itself included, comes first), then the message
    header (block length, template, schema, version).
    """

    def walk(value: bytes | None) -> list[dict]:
        out, at = [], skip
        while value is not None and at < len(value):
            length, _, block, template, schema, version = struct.unpack("<6H", value[at : at + 12]) if at + 12 <= len(value) else (1 << 16,) * 6
            if length < 12 or at + length > len(value):
                out.append({"frame": len(out), "frame_problem": "malformed" if length < 12 else "truncated"})
                break
            out.append({"frame": len(out), "template": template, "block_length": block, "schema": schema, "version": version, "length": length - 12})
            at += length
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x.split()[0], pa.string() if x.endswith("string") else pa.int32()) for x in FRAMES.split(", ")]))
        for batch in batches:
            values = pa.array([walk(v) for v in batch.column(payload).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "__frames"])

    item = T.StructType.fromDDL(FRAMES)
    schema = T.StructType([*records.schema.fields, T.StructField("__frames", T.ArrayType(item))])
    found = records.mapInArrow(run, schema)
    return found.select(*records.columns, F.inline("__frames"))


def reject_reason(messages: DataFrame) -> DataFrame:
    """messages (as frames() gives them) with reject_reason: truncated, malformed, schema, version, block length, unknown template, or null."""
    reason = F.when(F.col("frame_problem").isNotNull(), F.col("frame_problem")).when(F.col("schema") != SCHEMA, "schema").when(F.col("version") > VERSION, "version").when(F.col("block_length") > F.col("length"), "block length").when(~F.col("template").isin(*TEMPLATES), "unknown template")
    return messages.withColumn("reject_reason", reason)


def reject_counts(messages: DataFrame) -> DataFrame:
    """How many messages are rejected for each reason, and how many are not (null)."""
    return reject_reason(messages).groupBy("reject_reason").agg(F.count("*").alias("n"))


def merge_by_time(records: DataFrame, group: str) -> DataFrame:
    """records with replay_us: each group's times moved so that all groups begin at the earliest time there is. Order by it, then file and n."""
    starts = records.groupBy(F.col(group).alias("__group")).agg(F.min("ts_us").alias("__start"))
    starts = starts.join(F.broadcast(starts.agg(F.min("__start").alias("__first"))))  # one row
    joined = records.join(starts, F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn("replay_us", F.col("ts_us") - F.col("__start") + F.col("__first")).drop("__group", "__start", "__first")


def merged_in_order(records: DataFrame, group: str, file: str = "file", n: str = "n") -> DataFrame:
    """merge_by_time() with position, from 1: the order in which a merge that always takes the file with the earliest next record gives them; ties go to the smaller file.

    Inside a file records stay in order of n, so one whose time goes back follows the record before at once. The sort is by
    ranges of (time, file, n): partition k holds what comes before partition k + 1, in order, and rows keep that order as long
    as nothing shuffles them.
    """
    rows = merge_by_time(records, group)
    rows = scan.prefix(rows, file, [n], {"__due": ("max", F.col("replay_us"))})  # what waits behind a later record
    rows = settled(rows.orderBy("__due", file, n)).withColumn("__id", F.monotonically_increasing_id())
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    joined = rows.withColumn("__at", part).join(F.broadcast(sizes), F.col("__at") == F.col("__part"))
    return joined.withColumn("position", F.col("__before") + place + 1).drop("__due", "__id", "__at", "__part", "__before")
