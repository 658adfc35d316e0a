"""Conversation structure repair: A* on the edit lattice.

A conversation is to have roles (by their initials) `(s?(ua)+)?`: one system turn at most, then users and assistants in turn.
A node of its lattice is (rows settled, state of that pattern); an edit keeps (0), reroles (2) or deletes (3) a row, or
inserts an empty turn (2). Rows whose first fault is that they are blank or duplicate must go; keeping or reroling one that is
truncated costs 1 more. The heuristic is a suffix sum over the rows ahead: 3 for each that must go, 1 for each truncated one,
which no way around it saves. It never falls by more than an edit costs, so a node is settled when it first leaves the queue,
and as the queue is keyed (cost plus heuristic, audit), it leaves with the least of its cheapest audits.

A conversation of up to BLOCK rows is repaired in one go. A longer one is dealt, in order, to blocks of BLOCK rows in several
tasks; A* gives each block the cheapest audit from each state of the pattern to each other (inserts stand before the row that
follows, so no audit of a block is the beginning of another, and the least whole is made of least parts); one small fold over
the blocks picks their states; and the texts meet only the edits of their own block. What a task holds of a long conversation
are the costs of its blocks, some 400 bytes for BLOCK rows.

Null roles and texts count as one space. Rows of one conversation go by turn (nulls first), then role, then text. Rows
without a conv_id are one conversation. A conversation without rows has zeros, an empty audit and no turns. An empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import settle

#: Rows of a conversation that are repaired in one go.
BLOCK = 1024
#: Long conversations up to this number are broadcast to find their rows; more are joined by a shuffle.
BROADCAST = 100_000
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: States of the role pattern, where each initial leads, and what an insert or a new role must be there.
START, SYSTEM, USER, DONE = range(4)
TAKES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": DONE}, {"u": USER})
ROLES = ("user", "user", "assistant", "user")
#: What completes the pattern from each state.
TAILS = ("", "II", "I", "")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Faults: none, truncated, blank, duplicate; and what is unavoidable for each.
UNAVOIDABLE = {".": 0, "t": TRUNCATED, "b": DELETE, "d": DELETE}
#: Repairs of conversations of the same shape that a task keeps.
KNOWN = 100_000
TURNS = "array<struct<role:string,text:string>>"
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id long, part long, parts long, " + ", ".join(f"{c} long" for c in REPORT) + f", audit string, repaired {TURNS}"
ARROW_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def cheapest(initials: list[str], faults: str, entry: int = START, last: bool = True) -> Iterator[tuple[int, int, str]]:
    """(state, cost, audit) at the end of the rows, cheapest first, ties by audit. last: only states in which the pattern is complete, if need be after inserts."""
    n = len(faults)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + UNAVOIDABLE[faults[i]]
    queue, settled = [(ahead[0], "", 0, entry)], set()
    while queue:
        key, audit, i, state = heapq.heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n and (not last or state in (START, DONE)):
            yield state, key, audit
            continue
        turn = TAKES[state][ROLES[state][0]]
        ways = [("I", i, turn, INSERT)] if i < n or last else []
        if i < n:
            ways.append(("D", i + 1, state, DELETE))
            if faults[i] in ".t":
                more = TRUNCATED * (faults[i] == "t")
                ways.append(("R", i + 1, turn, REROLE + more))
                if initials[i] in TAKES[state]:
                    ways.append(("K", i + 1, TAKES[state][initials[i]], KEEP + more))
        for edit, at, to, cost in ways:
            if (at, to) not in settled:
                heapq.heappush(queue, (key - ahead[i] + cost + ahead[at], audit + edit, at, to))


def edited(turns: list[tuple[str, str]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The turns (role, text) after the edits."""
    out, rows = [], iter(turns)
    for edit in audit:
        role, text = (ROLES[state], "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "R":
            role = ROLES[state]
        out.append((role, text))
        state = TAKES[state][role[:1]]
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with the same first values, together."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def some_at_a_time(rows: Iterator[tuple], columns: list[tuple[str, pa.DataType]], most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of most rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch_of(held, columns)
            held = []
    if held:
        yield batch_of(held, columns)


def batch_of(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), columns)], [name for name, _ in columns])


def as_dicts(turns: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"role": role, "text": text} for role, text in turns]


LONG, STRING = pa.int64(), pa.string()
RESULT_COLUMNS = [("conv_id", LONG), ("part", LONG), ("parts", LONG), *((c, LONG) for c in REPORT), ("audit", STRING), ("repaired", ARROW_TURNS)]


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv_id, gone, turn, role, text, blank, ends), sorted: each conversation repaired in one go."""
    known: dict[tuple, tuple[int, str]] = {}

    def repaired() -> Iterator[tuple]:
        for (conv,), rows in grouped(batches, 1):
            rows = [r[1:] for r in rows if not r[0]]
            seen, faults = set(), ""
            for _, role, text, blank, ends in rows:
                faults += "b" if blank else "d" if (role, text) in seen else "." if ends else "t"
                seen.add((role, text))
            initials = [role[:1] for _, role, *_ in rows]
            shape = (*initials, faults)
            if shape not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[shape] = next(cheapest(initials, faults))[1:]
            cost, audit = known[shape]
            turns = {r[0] for r in rows if r[0] is not None}
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            yield conv, 0, 1, gaps, *(faults.count(c) for c in "bdt"), illegal(initials), cost, audit, as_dicts(edited([(r[1], r[2]) for r in rows], audit))

    yield from some_at_a_time(repaired(), RESULT_COLUMNS)


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv_id, part, place, mark, initial, blank, ends), sorted, a row's mark after it: each block's faults and its cheapest audits between all states (cost -1: there is none)."""

    def blocks() -> Iterator[tuple]:
        for (conv, part), rows in grouped(batches, 2):
            firsts = {place for place, mark, *_ in rows if mark}
            rows = [r for r in rows if not r[1]]
            faults = "".join("b" if blank else "d" if place not in firsts else "." if ends else "t" for place, _, _, blank, ends in rows)
            initials = [r[2] for r in rows]
            costs, audits = [-1] * 16, [""] * 16
            for entry in range(4):
                for state, cost, audit in cheapest(initials, faults, entry, last=False):
                    costs[4 * entry + state], audits[4 * entry + state] = cost, audit
            yield conv, part, *(faults.count(c) for c in "bdt"), illegal(initials), initials[0], initials[-1], costs, audits

    yield from some_at_a_time(blocks(), [("conv_id", LONG), ("part", LONG), *((c, LONG) for c in REPORT[1:5]), ("head", STRING), ("tail", STRING), ("costs", pa.list_(LONG)), ("audits", pa.list_(STRING))], 50)


SUMMARY = "conv_id long, part long, " + ", ".join(f"{c} long" for c in REPORT[1:5]) + ", head string, tail string, costs array<long>, audits array<string>"


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv_id, part, head, tail, costs, ranks), sorted: each block's states, what is inserted after the last, the conversation's cost, and pairs across blocks that are illegal. ranks order the audits of a block."""

    def chosen() -> Iterator[tuple]:
        for (conv,), rows in grouped(batches, 1):
            ahead = [[0, 2 * INSERT, INSERT, 0]]  # cheapest from each state at the end, then at the ends of earlier blocks
            for *_, costs, _ in reversed(rows):
                ways = [[costs[4 * s + t] + ahead[-1][t] for t in range(4) if costs[4 * s + t] >= 0] for s in range(4)]
                ahead.append([min(w) if w else 1 << 62 for w in ways])
            ahead.reverse()
            seam, state = illegal_seams(rows), START
            for k, (part, _, _, costs, ranks) in enumerate(rows):
                ways = [t for t in range(4) if costs[4 * state + t] >= 0 and costs[4 * state + t] + ahead[k + 1][t] == ahead[k][state]]
                to = min(ways, key=lambda t: ranks[4 * state + t])
                yield conv, part, state, to, TAILS[to] if k == len(rows) - 1 else "", ahead[0][START], seam, k
                state = to

    yield from some_at_a_time(chosen(), [("conv_id", LONG), ("part", LONG), ("entry", LONG), ("exit", LONG), ("after", STRING), ("cost", LONG), ("seams", LONG), ("number", LONG)])


def illegal_seams(rows: list[tuple]) -> int:
    return sum(illegal([a[2], b[1]]) for a, b in zip(rows, rows[1:]))


FOLDED = "conv_id long, part long, entry long, exit long, after string, cost long, seams long, number long"


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv_id, part, place, role, text, entry, audit), sorted, the row with the audit first: the turns of each block."""

    def blocks() -> Iterator[tuple]:
        for (conv, part), rows in grouped(batches, 2):
            *_, entry, audit = rows[0]
            yield conv, part, as_dicts(edited([(role, text) for _, role, text, *_ in rows[1:]], audit, entry))

    yield from some_at_a_time(blocks(), [("conv_id", LONG), ("part", LONG), ("repaired", ARROW_TURNS)], 50)


def prepared(rows: DataFrame, gone: Column | None) -> DataFrame:
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rest = F.rtrim(text, F.lit(SPACES))
    there = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), there.alias("gone"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (rest == "").alias("blank"), F.substring(rest, -1, 1).isin(".", "!", "?").alias("ends"))


def split(rows: DataFrame, gone: Column | None, block: int) -> tuple[DataFrame, DataFrame | None]:
    """repair() of the conversations of up to block rows, and of the others, if there are any."""
    rows = prepared(rows, gone)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("conv_id").alias("long_id"))
    n = sizes.count()
    order = ["conv_id", "turn", "role", "text"]
    sizes = F.broadcast(sizes) if n <= BROADCAST else sizes
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = rows.join(sizes, same, "left_anti") if n else rows
    short = short.select("conv_id", "gone", "turn", "role", "text", "blank", "ends").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(whole, RESULT)
    return short, settle(repair_long(rows.join(sizes, same, "left_semi"), block)) if n else None


def repair(rows: DataFrame, gone: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, parts, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of rows (conv_id, turn, role, text).

    repaired: the turns (role, text) of the repaired conversation. One of more than block rows has them in several parts, in
    order of part; its report is in the first of them and null in the others. gone: rows that are there only to name their
    conversation.
    """
    short, long = split(rows, gone, block)
    return short if long is None else short.unionByName(long)


def reports(rows: DataFrame, gone: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of rows: the report of each conversation, and the sha256 of its repaired turns as role:text, a newline between two."""
    short, long = split(rows, gone, block)
    out = short.select("conv_id", *REPORT, "audit", F.sha2(F.coalesce(chunk(), F.lit("")), 256).alias("sha256"))
    if long is None:
        return out
    own = digests(long).withColumnRenamed("conv_id", "own_id")
    return out.unionByName(long.where("part = 0").join(own, F.col("conv_id").eqNullSafe(F.col("own_id"))).select(*out.columns))


def chunk() -> Column:
    """Turns as lines; null if there are none."""
    return F.when(F.size("repaired") > 0, F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))


def repair_long(rows: DataFrame, block: int) -> DataFrame:
    """As repair(), by blocks."""
    order, names = ["conv_id", "turn", "role", "text"], rows.select("conv_id").distinct()
    rows = rows.where("not gone").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    rows = settle(rows.withColumn("part", F.floor(F.col("place") / block)))  # places hold from here on
    light = rows.select("conv_id", "part", "place", F.lit(0).alias("mark"), F.substring("role", 1, 1).alias("initial"), "blank", "ends")
    firsts = rows.groupBy("conv_id", "role", F.md5("text").alias("name")).agg(F.min(F.struct("place", "part")).alias("f"))
    none = F.lit(None)
    marks = firsts.select("conv_id", "f.part", "f.place", F.lit(1).alias("mark"), none.cast("string").alias("initial"), none.cast("boolean").alias("blank"), none.cast("boolean").alias("ends"))
    both = light.unionByName(marks).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place", "mark")
    found = settle(both.mapInArrow(summaries, SUMMARY))

    # of the audits only their order goes to the fold; audits from different states are never compared
    ranks = F.transform("audits", lambda a: F.array_position(F.array_sort(F.array_distinct("audits")), a))
    states = found.select("conv_id", "part", "head", "tail", "costs", ranks.alias("ranks")).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(folded, FOLDED)
    piece = F.concat(F.element_at("audits", (4 * F.col("entry") + F.col("exit") + 1).cast("int")), "after").alias("piece")
    pieces = settle(joined(found, states, "conv_id", "part").withColumn("piece", piece).drop("audits", "costs"))

    edits = pieces.select("conv_id", "part", F.lit(-1).cast("long").alias("place"), none.cast("string").alias("role"), none.cast("string").alias("text"), "entry", F.col("piece").alias("audit"))
    texts = rows.select("conv_id", "part", "place", "role", "text", none.cast("long").alias("entry"), none.cast("string").alias("audit"))
    turns = edits.unionByName(texts).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(applied, f"conv_id long, part long, repaired {TURNS}")
    turns = joined(turns, pieces.select("conv_id", "part", "number"), "conv_id", "part").select("conv_id", "number", "repaired")

    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "piece"))), lambda x: x["piece"]), "")
    sums = pieces.groupBy("conv_id").agg(F.count("*").alias("parts"), *(F.sum(c).alias(c) for c in REPORT[1:4]), (F.sum("illegal") + F.max("seams")).alias("illegal"), F.max("cost").alias("cost"), audit.alias("audit"))
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    # a conversation without rows has its report, and no turns
    report = joined(joined(names, sums, "conv_id", how="left"), gaps, "conv_id", how="left").withColumn("number", F.lit(0).cast("long"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in REPORT]
    report = report.select("conv_id", "number", F.coalesce("parts", F.lit(1).cast("long")).alias("parts"), *zero, F.coalesce("audit", F.lit("")).alias("audit"))
    first = joined(report, turns.where("number = 0"), "conv_id", "number", how="left")
    others = turns.where("number > 0").select("conv_id", "number", *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in ("parts", *REPORT, "audit")), "repaired")
    return first.unionByName(others).withColumnRenamed("number", "part").withColumn("repaired", F.coalesce("repaired", F.array().cast(TURNS)))


def joined(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """A join on keys of which null is a value like any other."""
    b = b.withColumnsRenamed({k: f"other_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys]
    return a.join(b, on, how).drop(*(f"other_{k}" for k in keys))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over (conv_id, part, chunk), sorted: sha256 of each conversation's chunks, a newline between them, of which one is held at a time."""

    def conversations() -> Iterator[tuple]:
        now, digest, some = None, None, False
        for batch in batches:
            for conv, _, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or conv != now:
                    if digest is not None:
                        yield now, digest.hexdigest()
                    now, digest, some = conv, hashlib.sha256(), False
                if chunk is not None:
                    digest.update(("\n" * some + chunk).encode())
                    some = True
        if digest is not None:
            yield now, digest.hexdigest()

    yield from some_at_a_time(conversations(), [("conv_id", LONG), ("sha256", STRING)])


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of what repair() gives: over the turns as role:text, a newline between two."""
    rows = repaired.select("conv_id", "part", chunk().alias("chunk"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(hashed, "conv_id long, sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) after damage by crc32 of `conv_id:turn` modulo 20 (nulls: one space): 0 drops, 1 empties the text, 2 takes its `[.!?]`, 3 repeats the row, 4 makes it a user's. What is dropped stays as a row that is gone."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("copy")).drop("copy")


ORACLE = r"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), b AS (SELECT name, list_transform(range(length(name)), lambda k: ascii(name[k + 1])) AS codes FROM (SELECT DISTINCT name FROM h)
), c AS (  -- CRC-32, a bit at a time; all characters of a name are ASCII
  SELECT name, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), codes), lambda crc, code:
         list_reduce(list_prepend(xor(crc, CAST(code AS BIGINT)), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z:
         xor(x >> 1, CASE WHEN x % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM b
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h JOIN c USING (name)
), n AS (
  SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, lag(left(role, 1)) OVER w AS was,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS rest
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, CASE WHEN rest = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(rest, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS fault FROM n
), s AS (
  SELECT conv_id, CAST(max(turn) - min(turn) + 1 - count(DISTINCT turn) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (was || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows_ FROM f GROUP BY conv_id
), i(state, edits, cost, after) AS (  -- inserts before an edit; more than two are never cheaper
  VALUES (0, '', 0, 0), (0, 'I', 2, 2), (0, 'II', 4, 3), (1, '', 0, 1), (1, 'I', 2, 2), (1, 'II', 4, 3), (2, '', 0, 2), (2, 'I', 2, 3), (3, '', 0, 3), (3, 'I', 2, 2), (3, 'II', 4, 3)
), e(state, edit, initial, cost, after) AS (
  VALUES (0, 'D', '', 3, 0), (1, 'D', '', 3, 1), (2, 'D', '', 3, 2), (3, 'D', '', 3, 3), (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (3, 'K', 'u', 0, 2),
         (0, 'R', '', 2, 2), (1, 'R', '', 2, 2), (2, 'R', '', 2, 3), (3, 'R', '', 2, 2)
), t AS (SELECT i.state, i.edits || e.edit AS edits, e.edit AS edit, initial, i.cost + e.cost AS cost, e.after AS after FROM i JOIN e ON e.state = i.after
), p AS (  -- the cheapest way to each state after each row, ties by audit
  SELECT conv_id, 0 AS n, 0 AS state, printf('%09d', 0) AS way FROM s
  UNION ALL
  SELECT p.conv_id, p.n + 1, t.after, min(printf('%09d', CAST(left(way, 9) AS INTEGER) + t.cost + CASE WHEN fault = 't' AND t.edit <> 'D' THEN 1 ELSE 0 END) || substr(way, 10) || t.edits)
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1 JOIN t ON t.state = p.state
  WHERE t.edit = 'D' OR (fault IN ('.', 't') AND (t.edit = 'R' OR t.initial = left(f.role, 1))) GROUP BY 1, 2, 3
), z AS (
  SELECT p.conv_id, min(printf('%09d', CAST(left(way, 9) AS INTEGER) + CASE p.state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END) || substr(way, 10) || CASE p.state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END) AS way
  FROM p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.n = s.rows_ GROUP BY 1
), a AS (
  SELECT conv_id, CAST(left(way, 9) AS BIGINT) AS cost, substr(way, 10) AS audit FROM z
), l AS (
  SELECT conv_id, k, audit[k] AS edit, length(replace(left(audit, k), 'I', '')) AS n FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS k FROM a)
), o AS (
  SELECT l.conv_id, k, edit, f.role, f.text, row_number() OVER w AS place, first_value(edit = 'K' AND left(f.role, 1) = 's') OVER w AS led
  FROM l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.n = l.n AND edit <> 'I' WHERE edit <> 'D' WINDOW w AS (PARTITION BY l.conv_id ORDER BY k)
), g AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS sha FROM o GROUP BY conv_id
)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id
"""
