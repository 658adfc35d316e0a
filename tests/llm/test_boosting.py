"""Statistics, trees and scores of the quality classifier against plain computations."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import boosting
from tickloom.llm.boosting import STATISTICS, Forest, boost, fit, grow, score_quality, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    """STATISTICS of one text, character by character."""
    data, words = text.encode(), WORD.findall(text)
    n, many = max(1, len(data)), max(1, len(words))
    kinds = (boosting.SYMBOL, boosting.MARKS, boosting.DIGIT, boosting.UPPER, boosting.WIDE, boosting.BLANK, boosting.bytes_in(b"\n"))
    shares = [c / n for c in Counter(data).values()]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    lengths = [len(w) for w in words]
    mean = sum(lengths) / many
    letters = lambda w: re.sub("[^A-Za-z0-9\x80-\U0010ffff]", "", w)
    caps = lambda w: len(re.findall("[A-Z]", w)) >= 2 and not re.search("[a-z\x80-\U0010ffff]", w)
    again = lambda items: len(items) - len(set(items))
    out = [math.log1p(len(data)), math.log1p(len(words)), math.log1p(len(lines)), *(sum(bool(k[b]) for b in data) / n for k in kinds), -sum(s * math.log2(s) for s in shares)]
    out += [mean, math.sqrt(max(0, sum(x * x for x in lengths) / many - mean**2)), math.log1p(max(lengths, default=0))]
    counted = (lambda w: len(w) <= 3, caps, lambda w: "A" <= w[0] <= "Z", lambda w: not letters(w), lambda w: bool(boosting.SYMBOL[w.encode()[-1]]), lambda w: w[-1] in ".?!")
    out += [sum(bool(f(w)) for w in words) / many for f in counted]
    out += [sum(a == b for a, b in zip(words, words[1:])) / many, max(Counter(words).values(), default=0) / many, again(lines) / max(1, len(lines)), math.log1p(len(words) / max(1, len(lines)))]
    return out + [again([tuple(words[i : i + k]) for i in range(len(words) - k + 1)]) / many for k in boosting.WORD_RUNS]


def test_statistics():
    r = random.Random(3)
    parts = ["the", "The", "ABC", "AB1!", "été", "ÉÉ", "x.", "###", "a$$", "42", "|", "\n", "\n\n", " \t", "end?", "…"]
    texts = ["", " ", "\n", "a", "é", *(" ".join(r.choice(parts) for _ in range(r.randrange(1, 60))) for _ in range(200)), "same line\nsame line\n same line\n", "x" * 3000]
    got = statistics(pa.array([None, *texts]))
    assert got.shape == (len(texts) + 1, len(STATISTICS)) and np.array_equal(got[0], got[1])
    for text, row in zip(texts, got[1:]):
        assert np.allclose(row, by_hand(text)), (text, [(s, a, b) for s, a, b in zip(STATISTICS, row, by_hand(text)) if not math.isclose(a, b, abs_tol=1e-9)])
    alone = np.concatenate([statistics(pa.array([t])) for t in texts])
    assert np.array_equal(alone, got[1:])


def walked(forest, x):
    total = forest.base
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
        k = 0
        for _ in range(boosting.DEPTH):
            k = 2 * k + (2 if x[feature[k]] > threshold[k] else 1)
        total += value[k]
    return total


def test_arrays_like_walks():
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(300, 5)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boost(x, y, 20)
    assert np.allclose(forest.raw(x), [walked(forest, row) for row in x])
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.95


def test_first_split_is_the_best():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(200, 4)), 1)
    g, h = r.normal(size=200), r.uniform(0.5, 1, size=200)
    bins, edges = boosting.binned(x, boosting.BINS)
    feature, threshold, _ = grow(bins, edges, g, h)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + boosting.RIDGE) + g[~m].sum() ** 2 / (h[~m].sum() + boosting.RIDGE)
    every = [(gain(x[:, c] <= e), c, e) for c in range(4) for e in edges[c] if min(h[x[:, c] <= e].sum(), h[x[:, c] > e].sum()) >= boosting.LEAST]
    best = max(every)
    assert math.isclose(gain(x[:, feature[0]] <= threshold[0]), best[0]) and (feature[0], threshold[0]) == best[1:]


def documents(seed, n):
    r = random.Random(seed)
    words = [a + b for a in "ka mo ti ru le".split() for b in "no pi sa tu re".split()]
    out = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randrange(12, 90))]
        good = r.random() < 0.7
        if not good:
            k = r.randrange(3)
            text = [w + r.choice(["###", "$$$", "%%"]) for w in text] if k == 0 else [text[0]] * len(text) if k == 1 else [w.upper() + "!!" for w in text]
        out.append((i, " ".join(text) + ".", int(good)))
    return out


SHAPE = "doc_id long, text string, quality int"


def test_held_out_and_edge_cases(spark):
    train = spark.createDataFrame([*documents(1, 600), (9000, None, 1), (9001, "x", None), (None, "y", 1)], SHAPE).repartition(3)
    forest = fit(train.select("doc_id", "text"), train.select("doc_id", "quality"))
    odd = [(1000, None, 1), (1001, "", 1), (1002, "kano pisa " * 100_000, 0), (1003, "#" * 1_000_000, 0), (7, "kano mopi.", 1), (7, "kano mopi.", 1), (None, "kano", 1)]
    docs = spark.createDataFrame([*documents(2, 300), *odd], SHAPE).selectExpr("*", "1 AS x", "'x' AS score").repartition(3)
    got = score_quality(docs, forest, "score").collect()
    assert len(got) == 307 and all(0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.doc_id is not None and r.doc_id < 300 and not (r.doc_id == 7 and r.text == "kano mopi.")]
    assert np.mean([(r.score >= 0.3) == r.quality for r in judged]) >= 0.97
    again = fit(train.select("doc_id", "text").repartition(5), train.select("doc_id", "quality").repartition(2))
    assert all(np.array_equal(getattr(forest, c), getattr(again, c)) for c in ("feature", "threshold", "value"))


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 0), (1, 1), (2, 0)], 0.25)])
def test_without_labels_of_both_kinds(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    forest = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert np.allclose([r.quality for r in score_quality(docs, forest).collect()], score)
    assert score_quality(docs.limit(0), forest).count() == 0


def test_empty_forest():
    assert Forest(0.0, *[np.zeros((0, 31))] * 3).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_query_on_given_tables(spark):
    """Held-out labels of a given folder; the labels and folds are the query's."""
    from tickloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op13_quality_classifier"](spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").where(F.col("quality").isNotNull()).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].score, q) for i, q in labels.items() if got[i].held_out]
    pairs = [(a > b) + (a == b) / 2 for a, p in held for b, q in held if p > q]
    assert np.mean(pairs) >= 0.97
