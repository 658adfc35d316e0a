"""Very long words and texts: linear time, and the results of the plain rule."""

import hashlib
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bpe, language, toxicity
from tickloom.llm.common import trimmed
from tickloom.llm.ngram_join import ngram_components
from tickloom.llm.substrings import substring_dedup
from tickloom.llm.textkit import trimmed as trimmed_word

MEGABYTE = 1 << 20


def timed(run):
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


@pytest.mark.parametrize("inner", ["-", "*", "5", "é", "#a"])
def test_word_edges(spark, inner):
    words = ["", inner, "--a--", "a", "--", "a--b", f"..{inner}..", "a" + inner * 300 + "b", inner * 50]
    for inside, keep in ((r"\p{L}", str.isalpha), (r"\p{L}\p{N}", str.isalnum)):
        want = ["".join(w[k] for k in range(next((i for i, c in enumerate(w) if keep(c)), len(w)), max((i for i, c in enumerate(w) if keep(c)), default=-1) + 1)) for w in words]
        assert [trimmed_word(w, keep) for w in words] == want
        frame = spark.createDataFrame(list(enumerate(words)), "k int, w string")
        assert [r[0] for r in frame.orderBy("k").select(trimmed(F.col("w"), inside)).collect()] == want


@pytest.mark.parametrize("inner", ["-", "*", "5", "#"])
def test_words_of_a_megabyte(inner):
    """A run inside a word costs its length: a megabyte takes seconds, not the hours of the square."""
    model = {"langs": ["en"], "words": {}, "grams": {k: {} for k in range(1, 5)}}
    word = b"a" + inner.encode() * MEGABYTE + b"b"
    assert timed(lambda: language.Scorer(model).word(word)) < 10
    finder = toxicity.Finder({"idiot": 2.0, "moro*": 1.0})
    assert timed(lambda: finder.word(word)) < 10
    assert finder.word(b"--" * MEGABYTE + b"idiot" + b"!" * MEGABYTE) == (2.0, 1)


def test_scores_of_long_texts(spark):
    texts = ["a" + c * MEGABYTE + "b" for c in "-*5"] + ["the king " * 200_000, "idiot " * 200_000, "word" * MEGABYTE]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = language.fit(spark.createDataFrame([(1, "the king and the queen, the king", "en"), (2, "der und die und der", "de"), (3, "a" + "-" * (MEGABYTE // 4) + "b", "en")], "doc_id long, text string, lang string"))
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert found[3] == "en" and len(found) == len(texts)
    lexicon = {"lexicon": {"idiot": 2.0}, "weights": None}
    assert toxicity.score_toxicity(docs, lexicon).count() == len(texts)
    rows = spark.createDataFrame([(1, "a" + "-" * MEGABYTE + "b idiot")] * 6 + [(0, "a" + "*" * MEGABYTE + "b")] * 6, "toxic int, text string")
    assert "idiot" in toxicity.learn_lexicon(rows)


def test_no_caps_hold_all_of_the_sample(spark):
    rows = spark.createDataFrame([(k, f"eins zwei wort{k}x wort{k}x", "de") for k in range(40)], "doc_id long, text string, lang string")
    capped, whole = language.fit(rows, words=5, grams=3), language.fit(rows, words=None, grams=None, least=1)
    assert len(capped["words"]) == 5 and max(len(g) for g in capped["grams"].values()) <= 3
    assert set(whole["words"]) == {"eins", "zwei", *(f"wort{k}x" for k in range(40))} and len(whole["grams"][4]) > 40
    terms = spark.createDataFrame([(int(k % 2), f"term{k % 20}a term{k % 20}b") for k in range(400)], "toxic int, text string")
    assert len(toxicity.learn_lexicon(terms, 3)) < len(toxicity.learn_lexicon(terms, None, 1, 0.0))


def test_dedup_and_codes_of_long_texts(spark):
    words = " ".join(f"w{k}" for k in range(120_000))
    texts = [words, words[: len(words) // 2] + " tail", "x" * 3 * MEGABYTE, "same " * 300_000, "a" + "-" * MEGABYTE + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}
    half = len(texts[1].split())
    # the last half word before the tail is cut, or whole
    whole = half - 1 if texts[1].split()[-2] == words.split()[half - 2] else half - 2
    assert kept == {0: (120_000, 0), 1: (half, whole), 2: (1, 0), 3: (300_000, 299_999), 4: (1, 0)}
    classes = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert classes == {0: (119_997, 0), 1: (half - 3, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4)}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    some = docs.where("doc_id in (1, 3)")
    for r in bpe.encode(some, path, decoded=True).collect():
        assert list(r.ids) == bpe.encoding(path).encode_ordinary(texts[r.doc_id])
        assert hashlib.sha256(bytes(r.decoded)).digest() == hashlib.sha256(texts[r.doc_id].encode()).digest()
