"""Conversation repair against every sequence of edits, computed plainly, in one go and by blocks."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tickloom.llm import conversations
from tickloom.llm.conversations import START, cheapest, damage, repair, reports

SHAPE = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults_of(rows):
    seen, out = set(), ""
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        out += "b" if not last else "d" if (role, text) in seen else "." if last[0] in ".!?" else "t"
        seen.add((role, text))
    return out


def brute(rows):
    """Least (cost, audit) over all edits, by the position and the roles so far: tables of whole strings, no search."""
    n, faults = len(rows), faults_of(rows)
    ways = {(0, ""): (0, "", ())}  # rows used, roles given -> cost, audit, turns
    best = None
    for used in range(n + 1):
        todo = [r for u, r in ways if u == used]
        while todo:
            roles = min(todo, key=len)
            todo.remove(roles)
            cost, audit, turns = ways[used, roles]
            if re.fullmatch("(s?(ua)+)?", roles) and used == n and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)

            def put(key, value):
                if key not in ways or value[:2] < ways[key][:2]:
                    ways[key] = value
                    if key[0] == used and key[1] not in todo:
                        todo.append(key[1])

            fits = lambda r: re.fullmatch("(s?(ua)*u?)?", r) is not None
            for name in ("user", "assistant"):
                if fits(roles + name[0]) and len(roles) < n + 3:
                    put((used, roles + name[0]), (cost + 2, audit + "I", (*turns, (name, ""))))
            if used == n:
                continue
            _, role, text = rows[used]
            put((used + 1, roles), (cost + 3, audit + "D", turns))
            if faults[used] in ".t":
                more = faults[used] == "t"
                if role and fits(roles + role[0]):
                    put((used + 1, roles + role[0]), (cost + more, audit + "K", (*turns, (role, text))))
                for name in ("user", "assistant"):
                    if fits(roles + name[0]):
                        put((used + 1, roles + name[0]), (cost + 2 + more, audit + "R", (*turns, (name, text))))
    return best


def wanted(all_rows, rows):
    out = {}
    for conv in {r[0] for r in all_rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults = faults_of(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = brute(own)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, sha, repaired)
    return out


def some_rows(seed, n, most=7):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "yes and", "", " \t", "Long. text", "end. ", "é?", "…", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]
    out = []
    for conv in range(n):
        for k in range(r.randrange(1, most)):
            out.append((conv, r.choice([k, k, k, k + 1, None]), r.choice(roles), r.choice(texts)))
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return [*out, (lost, 1, "user", "all dropped."), (None, 1, "user", "a."), (None, None, "user", "b"), (n, 5, "user", "Same."), (n, 5, "user", "Same.")]


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block", [conversations.BLOCK, 3, 1])
def test_like_all_edits(spark, block):
    rows = some_rows(4, 120)
    frame = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS part", "'x' AS gone", "2 AS place").repartition(3)
    want = wanted(rows, damaged(rows))
    hurt = damage(frame)
    found = got(reports(hurt, F.col("gone"), block))
    assert set(found) == set(want)
    assert {k: v for k, v in found.items() if v != want[k][:8]} == {}
    parts = {}
    for r in repair(hurt, F.col("gone"), block).orderBy("conv_id", "part").collect():
        parts.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.repaired)
    assert parts == {k: list(w[8]) for k, w in want.items()}
    assert {c for w in want.values() for c in w[6]} == set("KRDI") and any(not w[6] for w in want.values())


def test_long_conversation_by_blocks(spark):
    r = random.Random(2)
    rows = [(1, k, r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice([f"t {k}.", f"t {k}.", f"t {k}", "same."])) for k in range(900)] + [(2, 1, "user", "a?")]
    frame = spark.createDataFrame(rows, SHAPE).repartition(4)
    assert got(reports(frame, None, 64)) == got(reports(frame))


def test_heuristic_never_changes_the_answer(monkeypatch):
    r = random.Random(9)
    cases = [("".join(r.choice("suat") for _ in range(n)), "".join(r.choice("..tbd") for _ in range(n))) for n in [*range(9), 200] for _ in range(20)]
    found = [next(cheapest(list(i), f)) for i, f in cases]
    monkeypatch.setattr(conversations, "UNAVOIDABLE", dict.fromkeys(".tbd", 0))
    assert found == [next(cheapest(list(i), f)) for i, f in cases]


@pytest.mark.parametrize(("initials", "faults", "want"), [("", "", (0, "")), ("u", ".", (2, "KI")), ("ua", "..", (0, "KK")), ("sua", "...", (0, "KKK")), ("s", ".", (3, "D")), ("au", "..", (4, "IKKI")), ("uu", "..", (2, "KR")), ("uau", "..t", (3, "KKD")), ("ua", "bd", (6, "DD"))])
def test_by_hand(initials, faults, want):
    assert next(cheapest(list(initials), faults))[1:] == want


def test_blocks_of_every_state():
    """The cheapest ways through two blocks, put together, are the cheapest through both."""
    r = random.Random(5)
    for _ in range(200):
        n, k = 8, r.randrange(1, 8)
        initials, faults = [r.choice("suax") for _ in range(n)], "".join(r.choice("..tbd") for _ in range(n))
        whole = {s: (c, a) for s, c, a in cheapest(initials, faults, START, last=False)}
        both = {}
        for s, c, a in cheapest(initials[:k], faults[:k], START, last=False):
            for t, d, b in cheapest(initials[k:], faults[k:], s, last=False):
                both[t] = min(both.get(t, (99, "")), (c + d, a + b))
        assert whole == both


def test_empty(spark):
    assert reports(spark.createDataFrame([], SHAPE)).count() == 0
