import random
import re

import numpy as np
import pytest

from tickloom.llm import ngram_join
from tickloom.llm.components import components
from tickloom.llm.ngram_join import ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def sets(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute(rows):
    own = [sets(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(own[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def fixture(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "ß", "The"]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 9, 40, 150, 400]))] for _ in range(14)]
    line = ["all", "of", "them", "have", "this", "line", "at", "the", "end"]
    rows = []
    for i in range(n):
        words = list(r.choice(bases)) if r.random() < 0.75 else [r.choice(vocabulary) for _ in range(r.randrange(0, 80))]
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            if words:
                words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.3:
            words += line
        if r.random() < 0.1:
            words = [w.upper() for w in words]
        rows.append((3 * n - 2 * i, " ".join(words)))
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, rows[0][1])]


@pytest.mark.parametrize(("seed", "long", "block"), [(1, 20_000, 1_000_000), (2, 12, 3_000)])
def test_like_brute_force(spark, monkeypatch, seed, long, block):
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = fixture(seed)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node long, n long").repartition(3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(docs).collect()) == brute(rows)


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string"
    assert ngram_components(spark.createDataFrame([], schema)).count() == 0
    got = ngram_components(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (5, "x y"), (None, "q r s")], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 1, 0), (5, 1, 5), (5, 3, 5), (5, 3, 5)]


def near_chain():
    """Three texts, of which neighbours share 0.87 of their shingles and the ends do not."""
    words = [f"w{k}" for k in range(203)]
    middle = words[:]
    first, last = words[:-14] + [f"a{k}" for k in range(14)], [f"z{k}" for k in range(14)] + words[14:]
    return " ".join(first), " ".join(middle), " ".join(last)


@pytest.mark.parametrize(("ids", "want"), [
    ((1, None, 3), [(1, 1, 1), (3, 1, 1), (None, 1, 2)]), ((1, 2, 3), [(1, 1, 1), (2, 1, 2), (3, 1, 1)]),
    ((None, 5, None), [(5, 5, 2), (None, 5, 1), (None, 5, 1)]), ((None, None, None), [(None, None, 1), (None, None, 1), (None, None, 2)]),
])
def test_links_through_rows_without_an_id(spark, ids, want):
    rows = list(zip(ids, near_chain())) + [(100 + k, f"other text number {k} of many") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in ngram_components(docs).select("doc_id", "component_id", "n_links").collect()]
    assert sorted((x for x in got if x[0] is None or x[0] < 100), key=lambda x: (x[0] or 999, x[2])) == sorted(want, key=lambda x: (x[0] or 999, x[2]))


def test_copies_without_an_id_count_as_links(spark):
    first, middle, last = near_chain()
    rows = [(1, first), (3, last)] + [(None, middle)] * 5
    got = [tuple(r) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "component_id", "n_links").collect()]
    assert sorted(got, key=lambda x: x[0] or 999) == [(1, 1, 5), (3, 1, 5)] + [(None, 1, 6)] * 5


@pytest.mark.parametrize("long", [7, 100])
def test_postings_across_batches(monkeypatch, long):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "SHORT", 3)
    monkeypatch.setattr(ngram_join, "LONG", long)
    grams = [1] * 3 + [2] * 9 + [3] + [4] * 5 + [5] * 20 + [6]
    n = len(grams)
    sketches = [bytes(64) if k % 5 else bytes([255] * 64) for k in range(n)]
    for step in (1, 2, 3, 4, 11, 50):
        columns = [pa.array(grams), pa.array([100] * n), pa.array(range(n)), pa.array(sketches, pa.binary())]
        batches = [pa.RecordBatch.from_arrays([c[k : k + step] for c in columns], ["gram", "n", "node", "sketch"]) for k in range(0, n, step)]
        label = list(range(n))
        for b in ngram_join.postings(85)(iter(batches)):
            for r in b.to_pylist():
                x, y = label[r["a"]], label[r["b"]]
                label = [min(x, y) if v in (x, y) else v for v in label]
        want = [min(j for j in range(n) if grams[j] == grams[k] and (grams.count(grams[k]) >= long or (j % 5 == 0) == (k % 5 == 0))) for k in range(n)]
        assert label == want, step


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(300, k) for k in range(301, 380)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e if x is not None}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in label.items() if k in got} == got
    assert all(k in got or k in loops for k in label)


@pytest.mark.parametrize(("seed", "long", "block"), [(1, 20_000, 1_000_000), (2, 12, 3_000)])
def test_all_links_count(spark, monkeypatch, seed, long, block):
    monkeypatch.setattr(ngram_join, "LONG", long)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = fixture(seed, 180)
    rows += rows[:20] + [(None, rows[0][1])]  # repeated in full, and a copy without an id
    own = [sets(t) for _, t in rows]
    near = lambda i, j: i != j and own[i] and own[j] and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j])
    want = sorted((d or 0, len(own[i]), sum(bool(near(i, j)) for j in range(len(rows)))) for i, (d, _) in enumerate(rows))
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.n_links) for r in got) == want
    assert max(n for *_, n in want) > 5


def test_links_of_a_chain(spark):
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(6)]  # neighbours are linked, no others
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (0, 1 if k in (0, 5) else 2) for k in range(6)}
