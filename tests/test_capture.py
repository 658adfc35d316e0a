import heapq
import random
import struct

import pytest
from pyspark.sql import functions as F

from tickloom.sources import capture


def frame(payload, port=30001, tags=0, cooked=False):
    ip = bytes([0x45]) + bytes(19)
    udp = struct.pack(">HHHH", 1, port, 8 + len(payload), 0)
    head = bytes(16) if cooked else bytes(12) + b"\x81\x00\x00\x01" * tags + b"\x08\x00"
    return head + ip + udp + payload


def message(template, block=4, schema=2, version=16, body=b"1234"):
    return struct.pack("<HHHHHH", 12 + len(body), 0xEB50, block, template, schema, version) + body


def packet(seq, *messages):
    return struct.pack("<BBHIQ", 7, 0, 3, seq, 1_700_000_000_000_000_000 + seq) + b"".join(messages)


def file(order, link, frames, nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, link)
    for k, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + k, 5000 if nano else 5, len(f), len(f)) + f
    return out


def test_records_frames_and_reasons(spark, tmp_path):
    good = [frame(packet(1, message(50), message(99)), tags=2), frame(packet(2, message(50, schema=3), message(53, version=17), message(50, block=9))), frame(packet(3, message(50)) + b"\x50\x00"), b"short"]
    (tmp_path / "a.pcap").write_bytes(file("<", 1, good))
    (tmp_path / "b.pcap").write_bytes(file(">", 113, [frame(packet(9, message(50)), cooked=True)], nano=True)[:] + b"cut")
    (tmp_path / "c.pcap").write_bytes(b"not a capture")
    rows = capture.read_captures(spark, str(tmp_path))
    found = {(r.file[-6:], r.n): r for r in rows.collect()}
    assert {k: r.problem for k, r in found.items() if r.problem} == {("a.pcap", 3): "no payload", ("b.pcap", 1): "truncated", ("c.pcap", 0): "no capture"}
    assert found["a.pcap", 0].port == 30001 and found["a.pcap", 1].ts_us == 101_000_005 == found["b.pcap", 0].ts_us + 1_000_000
    heads = {(r.packet_seq, r.channel, r.seq_version, r.sending_time_ns) for r in capture.packet_headers(rows).where("packet_seq is not null").collect()}
    assert heads == {(n, 7, 3, 1_700_000_000_000_000_000 + n) for n in (1, 2, 3, 9)}
    messages = capture.reject_reason(capture.frames(capture.packet_headers(rows)))
    got = sorted((r.packet_seq, r.frame, r.template, r.reject_reason) for r in messages.collect())
    assert got == [(1, 0, 50, None), (1, 1, 99, "unknown template"), (2, 0, 50, "schema"), (2, 1, 53, "version"), (2, 2, 50, "block length"), (3, 0, 50, None), (3, 1, None, "truncated"), (9, 0, 50, None)]
    assert {(r.reject_reason, r.n) for r in capture.reject_counts(capture.frames(capture.packet_headers(rows))).collect()} == {(None, 3), ("unknown template", 1), ("schema", 1), ("version", 1), ("block length", 1), ("truncated", 1)}


def test_merge(spark):
    rows = spark.createDataFrame([("x", 0, 100), ("x", 1, 130), ("y", 0, 900), ("y", 1, 910)], "file string, n long, ts_us long")
    assert [(r.file, r.replay_us) for r in capture.merge_by_time(rows, "file").orderBy("replay_us", "file", "n").collect()] == [("x", 100), ("y", 100), ("y", 110), ("x", 130)]


@pytest.mark.parametrize("data", [b"", b"\xd4\xc3\xb2\xa1", file("<", 1, [])[:24] + struct.pack("<IIII", 1, 1, 70000, 70000)])
def test_bad_files_end(data):
    assert [r[4] for r in capture.records_of(data)] in (["no capture"], ["malformed"])


def mixed(seed, order, nano, tail=b""):
    """Records of all lengths; some payloads hold what looks like records, some are long."""
    r = random.Random(seed)
    fake = file(order, 1, [bytes(k) for k in (9, 30, 4, 7, 12, 3, 8)], nano)[24:]
    frames = [r.choice([b"", r.randbytes(r.randrange(1, 90)), frame(r.randbytes(40)), fake, fake[5:], r.randbytes(3000)]) for _ in range(30)]
    return file(order, 1, frames, nano) + tail


@pytest.mark.parametrize("size", [900, 1 << 20])
def test_ranges_like_one_walk(spark, tmp_path, size):
    contents = {
        "a.pcap": mixed(1, "<", False),
        "b.pcap": mixed(2, ">", True, b"cut"),
        "c.pcap": mixed(3, "<", False, struct.pack("<IIII", 1, 1, 70000, 70000) + bytes(900)),
        "d.pcap": mixed(4, "<", False, struct.pack("<IIII", 1, 1, 60000, 60000) + bytes(2000)),
        "e.pcap": b"",
        "f.pcap": bytes(2000),
        "g.pcap": file("<", 1, []),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {}
    for x in capture.read_captures(spark, str(tmp_path), size).collect():
        got.setdefault(x.file[-6:], []).append((x.n, x.ts_us, x["size"], x.port, x.payload, x.problem))
    for name, content in contents.items():
        want = [(n, *row) for n, row in enumerate(capture.records_of(content))] if content else []
        assert sorted(got.get(name, [])) == want, name


def test_guesses_are_mostly_right(spark, tmp_path):
    """Of true captures, ranges find their first record themselves, and many tasks read one file."""
    r = random.Random(5)
    (tmp_path / "a.pcap").write_bytes(file("<", 1, [frame(r.randbytes(r.randrange(20, 400))) for _ in range(4000)]))
    ranges = spark.read.format("binaryFile").load(str(tmp_path)).select(F.col("path").alias("file"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(50_000).cast("long"))).alias("low"), F.lit(None).cast("long").alias("entry"))
    found = capture.boundaries(ranges, 50_000).orderBy("low").collect()
    assert len(found) > 15 and all(a.exit == b.entry for a, b in zip(found, found[1:]))
    rows = capture.read_captures(spark, str(tmp_path), 50_000)
    assert rows.count() == 4000 and rows.select(F.spark_partition_id().alias("p")).distinct().count() > 5


def test_merge_like_a_heap(spark):
    r = random.Random(6)
    files, rows = {}, []
    for name, group in (("x", "g"), ("y", "h"), ("z", "g")):
        now = r.randrange(100)
        for n in range(200):
            now += r.choice([0, 0, 1, 2, 3, -4])
            files.setdefault(name, []).append((now, group))
            rows.append((name, n, now, group))
    start = {g: min(t for _, _, t, h in rows if h == g) for g in "gh"}
    heads = [(files[f][0][0] - start[files[f][0][1]], f, 0) for f in files]
    heapq.heapify(heads)
    want = []
    while heads:
        _, f, n = heapq.heappop(heads)
        want.append((f, n))
        if n + 1 < len(files[f]):
            heapq.heappush(heads, (files[f][n + 1][0] - start[files[f][n + 1][1]], f, n + 1))
    got = capture.merged_in_order(spark.createDataFrame(rows, "file string, n long, ts_us long, g string").repartition(5), "g").collect()
    assert [(x.file, x.n) for x in got] == want and [x.position for x in got] == list(range(1, 601))
