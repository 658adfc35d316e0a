import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm.substrings import stretches, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    first = {}
    texts = {i: WORD.findall(t or "") for i, t in rows if i is not None}
    for i in sorted(texts):
        for s in range(len(texts[i]) - length + 1):
            first.setdefault(tuple(texts[i][s : s + length]), (i, s))
    out = {}
    for i, words in texts.items():
        gone = set()
        for s in range(len(words) - length + 1):
            if first[tuple(words[s : s + length])] < (i, s):
                gone.update(range(s, s + length))
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def fixture(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "ß", "the", "a|b"]
    passage = [[r.choice(vocabulary) for _ in range(r.choice([19, 20, 21, 30, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(r.randrange(0, 6)):
            kind = r.random()
            if kind < 0.45:
                p = r.choice(passage)
                words += p[r.randrange(0, 3) : len(p) - r.randrange(0, 3)]
            elif kind < 0.55:
                words += [r.choice(vocabulary)] * r.randrange(1, 70)
            elif kind < 0.62:
                words += ["a", "b"] * r.randrange(1, 40)
            else:
                words += [r.choice(vocabulary) for _ in range(r.randrange(1, 60))]
        rows.append((1000 - 7 * i, r.choice([" ", "  ", "\n", "\t "]).join(words)))
    return rows + [(5000, None), (5001, ""), (5002, " \n "), (5003, rows[3][1]), (5004, rows[3][1]), (5005, "x " * 3000)]


@pytest.mark.parametrize(("seed", "length"), [(1, 20), (2, 20), (3, 5)])
def test_like_brute_force(spark, seed, length):
    rows = fixture(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("n_words", F.lit("clash")).withColumn("__mark", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs, length).collect()}
    assert got == brute(rows, length)


@pytest.mark.parametrize("length", [20, 5])
def test_runs_like_brute_force(spark, length):
    r = random.Random(length)
    runs = lambda n: " ".join(" ".join(r.choice([["a"], ["a", "b"], ["a", "b", "c"], [f"w{k}" for k in range(9)], [f"v{k}" for k in range(30)]]) * r.randrange(1, n)) for _ in range(3))
    rows = [(i, runs(2 + 4 * (i % 9))) for i in range(60)] + [(70, "a " * 400), (71, "a b " * 300), (72, "q " + "a " * 90 + "z " + "a " * 200)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length).collect()}
    assert got == brute(rows, length)


@pytest.mark.parametrize("text", ["the " * 250_000, "a b c " * 80_000, " ".join(f"w{k}" for k in range(9)) + " " + "x y " * 100_000])
def test_a_run_costs_few_stretches(text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([0], pa.int32())], ["doc_id", "text", "tag"])
    found = list(stretches(20)(iter([batch])))
    assert sum(b.num_rows for b in found) < 1000 and sum(sum(b.column(4).to_pylist()) for b in found) == len(text.split()) - 19


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert substring_dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(map(str, range(50)))
    got = substring_dedup(spark.createDataFrame([(1, text), (1, text), (None, text)], schema)).collect()
    assert [r.n_removed for r in got] == [0, 0, 0]
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest() for r in got)
