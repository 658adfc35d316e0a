import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm.suffixes import first_digit, suffix_dedup


def brute(rows, length):
    texts = {i: (t or "").encode() for i, t in rows}
    seen = Counter(t[s : s + length] for t in texts.values() for s in range(len(t) - length + 1))
    out = {}
    for i, t in texts.items():
        gone = set()
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone.update(range(s, s + length))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out[i] = (len(t), len(gone), [tuple(s) for s in spans], bytes(c for k, c in enumerate(t) if k not in gone))
    return out


def fixture(seed, scale):
    r = random.Random(seed)
    letters = "abcdefgh é ß\n"
    passages = ["".join(r.choice(letters) for _ in range(int(scale * r.choice([0.9, 1, 1.01, 1.5, 3])))) for _ in range(8)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(r.randrange(0, 5)):
            kind = r.random()
            if kind < 0.5:
                p = r.choice(passages)
                parts.append(p[r.randrange(0, 4) : len(p) - r.randrange(0, 4)])
            elif kind < 0.56:
                parts.append(r.choice("ab") * r.randrange(1, 2 * scale))
            else:
                parts.append("".join(r.choice(letters) for _ in range(r.randrange(1, 2 * scale))))
        rows.append((500 - 3 * i, "".join(parts)))
    return rows + [(900, None), (901, ""), (902, rows[5][1]), (903, rows[5][1]), (904, "x" * (5 * scale))]


@pytest.mark.parametrize(("seed", "length"), [(1, 400), (2, 40), (3, 7)])
def test_like_brute_force(spark, seed, length):
    rows = fixture(seed, length)
    docs = spark.createDataFrame([(i, t, "clash", 3, "x", 4, 5) for i, t in rows], "doc_id long, text string, kept string, at long, key string, tag int, spans int").withColumn("__text", F.lit(1)).repartition(5)
    found = suffix_dedup(docs, length, length * 5 // 8).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, [tuple(x) for x in r.removed], bytes(r.kept)) for r in found} == brute(rows, length)
    assert {r.doc_id: r.n_noted for r in found} == {i: x[1] for i, x in brute(rows, length * 5 // 8).items()}
    assert {(r.at, r.key, r.tag, r.spans, r["__text"], r.text) for r in found} == {(3, "x", 4, 5, 1, t) for _, t in rows}


RUNS = ["ab" * 600, "x" * 900, "abcdefghi" * 150, "q" + "ab" * 300 + "Q", "ab" * 300 + "c" + "ab" * 300, "b" + "x" * 200 + "y" + "x" * 450, "abc" * 70 + "abd" * 70, "abcdefghi" * 40 + "tail"]


@pytest.mark.parametrize("length", [400, 60, 7])
def test_runs_like_brute_force(spark, length):
    r = random.Random(length)
    texts = [*RUNS, *("".join(r.choice(["ab", "a", "abc", "x"]) * r.randrange(1, 3 * length) for _ in range(3)) for _ in range(12))]
    rows = list(enumerate(texts))
    found = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, [tuple(x) for x in r.removed], bytes(r.kept)) for r in found} == brute(rows, length)


@pytest.mark.parametrize("text", [" " * 1_000_000, "abcdefghi" * 120_000, "x" * 300 + "ab" * 500_000])
def test_a_run_costs_few_places(text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([0], pa.int32())], ["doc_id", "text", "tag"])
    found = list(first_digit(400, 32)(iter([batch])))
    assert sum(b.num_rows for b in found) < 1000 and sum(sum(b.column(4).to_pylist()) for b in found) == len(text) - 399


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(map(str, range(300)))
    got = suffix_dedup(spark.createDataFrame([(1, text), (1, text), (None, text)], schema)).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]


def test_one_long_text_in_pieces(spark, monkeypatch):
    """A text of many slices is taken piece by piece, with the same result."""
    import tickloom.llm.suffixes as module

    monkeypatch.setattr(module, "SLICE", 500)
    r = random.Random(9)
    passage = "".join(r.choice("abcd ") for _ in range(700))
    long = "".join(r.choice("abcd ") for _ in range(3000)) + passage + "".join(r.choice("abcd ") for _ in range(900)) + passage[:450] + "ab" * 600
    rows = [(1, long), (2, "x" + passage[20:]), (3, "".join(r.choice("abcd ") for _ in range(300))), (4, long[2000:5200])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {x.doc_id: (x.n_bytes, x.n_removed, [tuple(y) for y in x.removed], bytes(x.kept)) for x in module.suffix_dedup(docs, 60).collect()}
    assert got == brute(rows, 60)
