"""Jumps, windows and episodes against plain loops and the state machine; keys are cut at several sizes."""

import random

import pytest

from tickloom.operators import conflation, episodes, jumps, recovery


def test_reached_like_a_walk(spark):
    r = random.Random(3)
    steps = [(k, p, r.choice([None, *range(p + 1, p + 6)])) for k in (1, 2, None) for p in range(300)]
    roots = [(1, 0), (1, 150), (2, 7), (None, 3), (9, 9)]
    got = jumps.reached(spark.createDataFrame(steps, "k long, place long, to long"), spark.createDataFrame(roots, "k long, place long"), "k")
    next_ = {(k, p): t for k, p, t in steps}
    want = set()
    for k, p in roots:
        while p is not None and (k, p) not in want:
            want.add((k, p))
            p = next_.get((k, p))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("hot", [50, 10**9])
def test_first_after(spark, strict, hot):
    r = random.Random(4)
    points = sorted({(r.choice([1, 1, 1, 2, None]), r.randrange(500)) for _ in range(200)}, key=repr)
    probes = [(r.choice([1, 1, 1, 2, 3, None]), r.randrange(520), n) for n in range(400)]
    got = jumps.first_after(spark.createDataFrame(probes, "k long, at long, n long"), spark.createDataFrame([(k, p, -p) for k, p in points], "k long, place long, value long"), "k", "at", "found", strict, hot)
    want = {n: max((-p for q, p in points if q == k and (p > at if strict else p >= at)), default=None) for k, at, n in probes}
    assert got.columns == ["k", "at", "n", "found"] and {x.n: x.found for x in got.collect()} == want


def windows(rows, length):
    now, out = {}, {}
    for seq, k, t in sorted(rows):
        if t is not None and (k not in now or t - now[k] >= length and (length or t > now[k])):
            now[k] = t
        out[seq] = now.get(k)
    return out


@pytest.mark.parametrize("length", [0, 1, 7, 60])
@pytest.mark.parametrize("hot", [100, 10**9])
def test_windows_like_a_loop(spark, length, hot):
    """A third of the rows have one key; times tie, go back and are missing, and one key never pauses."""
    r = random.Random(length)
    rows, now = [], 0
    for n in range(1500):
        now += r.choice([0, 1, 1, 2, 5, 90 if r.random() < 0.05 else 0])
        rows.append((n, r.choice([7, 7, 1, 2, None]), r.choice([now, now, now, now - 3, None if r.random() < 0.2 else now])))
    frame = spark.createDataFrame(rows, "seq long, k long, ms long").repartition(4)
    got = conflation.anchored_windows(frame, "k", "ms", length, hot=hot)
    assert got.columns == ["seq", "k", "ms", "opened"]
    assert {x.seq: x.opened for x in got.collect()} == windows(rows, length)
    assert conflation.anchored_windows(frame.limit(0), "k", "ms", length).count() == 0


def feed(seed, n=1200):
    """Numbered messages with losses, repeats and late copies; snapshots behind, level or ahead; resets after which numbers may begin again."""
    r = random.Random(seed)
    rows, number = [], {}
    for seq in range(n):
        k = r.choice([1, 1, 2, 3, None])
        number.setdefault(k, 0)
        op = r.choices(["book", "trade", "snapshot", "reset"], [80, 8, 10, 1])[0]
        if op == "reset":
            number[k] = r.choice([0, number[k]])
            rows.append((seq, k, op, None))
        elif op == "snapshot":
            rows.append((seq, k, op, max(0, number[k] + r.choice([-4, -2, -1, 0, 0, 0, 1, 3]))))
        else:
            number[k] += r.choice([1] * 30 + [2, 3])
            late = number[k] - r.choice([0] * 20 + [1, 2])
            rows.append((seq, k, op, late))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot", [60, 10**9])
def test_episodes_like_the_state_machine(spark, seed, hot):
    rows = feed(seed)
    frame = spark.createDataFrame(rows, "seq long, security_id long, op string, rpt_seq long").repartition(4)
    want, open_, seen, lives = [], {}, {}, {}
    by_key = {}
    for seq, k, op, number in rows:
        book = by_key.setdefault(k, recovery.Book())
        was = book.state
        outcome, _, _ = book.step(op, number)
        if op == "reset":
            lives[k] = lives.get(k, 0) + 1
        if was == "healthy" and book.state != "healthy":
            want.append((k, *open_.pop(k), seq if op != "reset" else None, seen[k]))
        if outcome == "healed":
            open_[k] = (lives.get(k, 0), seq, number, book.seen)
        if book.state == "healthy":
            seen[k] = book.seen
    want += [(k, *at, None, seen[k]) for k, at in open_.items()]
    got = [tuple(x) for x in episodes.episodes(frame, hot).collect()]
    assert len(want) > 20 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_few_rows_and_none(spark):
    shape = "seq long, security_id long, op string, rpt_seq long, security_ids int"
    assert episodes.episodes(spark.createDataFrame([], shape)).count() == 0
    rows = [(1, 1, "book", 1, 0), (2, 1, "snapshot", 0, 0), (3, 1, None, 2, 0), (None, 1, "book", 9, 0), (4, 1, "book", None, 0), (5, 1, "book", 5, 0)]
    assert [tuple(x) for x in episodes.episodes(spark.createDataFrame(rows, shape)).collect()] == [(1, 0, 2, 0, 1, 5, 2)]


def test_books_of_episodes(spark):
    shape = "seq long, security_id long, op string, rpt_seq long, side string, order_id long, action string, price long, qty long"
    book = lambda seq, n, order, action="new": (seq, 1, "book", n, "bid", order, action, 100, seq)
    snapshot = lambda seq, n: (seq, 1, "snapshot", n, *[None] * 5)
    # 3 is lost; 4 is held and replayed over the snapshot of 3; 6 and 7 are lost, and found in the next
    rows = [book(1, 1, 1), book(2, 2, 2), book(3, 4, 4), snapshot(4, 3), book(5, 4, 9), book(6, 5, 1, "delete"), book(7, 8, 8), snapshot(8, 6), snapshot(9, 8), book(10, 9, 8, "delete")]
    frame = spark.createDataFrame(rows, shape)
    orders = spark.createDataFrame([(4, 1, "bid", k, 100, 1) for k in (1, 2, 3)] + [(8, 1, "bid", 77, 1, 1)] + [(9, 1, "bid", k, 100, 1) for k in (2, 8)], "healed_seq long, security_id long, side string, order_id long, price long, qty long")
    found = episodes.episodes(frame)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 4, 3, 4, 7, 5), (1, 0, 9, 8, 8, None, 9)]
    got = episodes.episode_books(found, orders, frame)
    assert sorted((x.healed_seq, x.order_id, x.qty) for x in got.collect()) == [(4, 2, 1), (4, 3, 1), (4, 4, 3), (9, 2, 1)]
