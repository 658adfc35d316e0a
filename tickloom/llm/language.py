"""Language identification, words first: a known word speaks for languages by its frequency in each; an unknown one by its
longest known character n-grams, from LONGEST characters down to one.

The model is fitted on a bounded sample of the labelled rows (SAMPLE rows, by hash of the doc_id; documented bound), whose
words are counted by Spark; of each language it holds the WORDS most frequent words and the GRAMS most frequent n-grams of
each length (parameters of fit(); None holds all), each with the languages that have it. So its size is in proportion to the number of languages, and it is sent to
the tasks whole. Every document is scored over its whole text.

Texts that are null or have no letter get `und` and score 0. A model without languages gives `und` for all. Ties go to the
language that is first by name. Rows may repeat a doc_id or have none; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import textkit
from tickloom.llm.common import settle, trimmed
from tickloom.llm.textkit import BYTE_VALUE, Rolling, Words, ranges, row_of, slices, text_bytes

SAMPLE, WORDS, GRAMS, LONGEST = 20_000, 20_000, 5_000, 4
#: Frequency that an unseen word or n-gram counts as having, in the log.
FLOOR = -14.0
#: What a word begins and ends with.
INSIDE = r"\p{L}"
#: Times that a word stands in the sample at least.
LEAST = 2


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n): lower-case words without what is no letter at either end, in rows (lang, text)."""
    words = F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")
    words = rows.select("lang", words).select("lang", trimmed(F.col("word"), INSIDE).alias("word")).where("word <> ''")
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


def fit(rows: DataFrame, sample: int = SAMPLE, words: int | None = WORDS, grams: int | None = GRAMS, least: int = LEAST) -> dict:
    """The model from rows (doc_id, text, lang); null languages are not learned. words, grams: of a language and, for n-grams, length (None: all of the sample's); least: times that a word must stand in the sample."""
    rows = rows.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    total = rows.count()
    if total > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    counts = settle(word_counts(rows))
    own = Window.partitionBy("lang")
    sums = dict(counts.groupBy("lang").agg(F.sum("n")).collect())
    langs = sorted(sums)
    best = most_frequent(counts.where(F.col("n") >= least), "word", words)
    place = {lang: k for k, lang in enumerate(langs)}
    known = gathered((r.word, place[r.lang], np.log(r.n / sums[r.lang])) for r in best.select("lang", "word", "n").toLocalIterator())
    # of a word's characters, which are taken apart once: a substring would be sought from the word's start each time
    letters = F.regexp_extract_all(F.concat(F.lit("^"), "word", F.lit("$")), F.lit("(?s)."), F.lit(0))
    pieces = []
    for size in range(1, LONGEST + 1):
        of = counts.select("lang", "n", F.explode(F.flatten(F.transform(F.array(letters), runs_of(size)))).alias("gram"))
        of = of.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        pieces.append(most_frequent(of.withColumn("all", F.sum("n").over(own)), "gram", grams))
    parts = {size: gathered((r.gram, place[r.lang], np.log(r.n / r["all"])) for r in of.select("lang", "gram", "n", "all").toLocalIterator()) for size, of in enumerate(pieces, 1)}
    return {"langs": langs, "words": known, "grams": parts}


def runs_of(size: int):
    """From an array of letters to all runs of that many (a shorter word is one)."""

    def run(letters: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(letters) - size + 1, F.lit(1)))
        return F.transform(first, lambda i: F.array_join(F.slice(letters, i, F.lit(size)), ""))

    return run


def most_frequent(counts: DataFrame, name: str, most: int | None) -> DataFrame:
    """Of each language the most frequent rows (lang, name, n); None: all."""
    if most is None:
        return counts
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), name))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


#: Of a word or n-gram: the languages that have it, and by how much its log frequency there is above FLOOR.
Entry = tuple[np.ndarray, np.ndarray]


def gathered(rows) -> dict[str, Entry]:
    found: dict[str, list] = {}
    for name, lang, value in rows:
        found.setdefault(name, []).append((lang, value - FLOOR))
    return {name: (np.array([x for x, _ in own], np.int32), np.array([x for _, x in own], np.float32)) for name, own in found.items()}


class Scorer:
    """Log frequencies of words in each language; those of words seen before in the task are kept, up to KEPT."""

    KEPT = 200_000

    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.known = {}

    def word(self, raw: bytes) -> Entry | None:
        """None if the word has no letter."""
        if raw in self.known:
            return self.known[raw]
        word = textkit.trimmed(raw.decode("utf-8", "replace").lower(), str.isalpha)
        found = None
        if word:
            found = self.words.get(word)
            if found is None:
                found = self.unseen(f"^{word}$")
        if len(self.known) >= self.KEPT:
            self.known.clear()
        self.known[raw] = found
        return found

    def unseen(self, word: str) -> Entry:
        """The mean over the word of the longest known n-gram at each place, at half weight: it says less than the word."""
        langs, values, n, at = [], [], 0, 0
        while at < len(word):
            for size in range(min(LONGEST, len(word) - at), 0, -1):
                found = self.grams[size].get(word[at : at + size])
                if found is not None:
                    langs.append(found[0])
                    values.append(found[1])
                    n += 1
                    at += max(1, size - 1)
                    break
            else:
                at += 1
        if not n:
            return NOTHING
        return np.concatenate(langs), np.concatenate(values) / np.float32(2 * n)


NOTHING: Entry = (np.zeros(0, np.int32), np.zeros(0, np.float32))


def score(model: dict):
    """mapInArrow over (doc_id, text): lang_pred and score, the share of the probability that the language has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        langs = np.array([*model["langs"], "und"])
        many = len(langs) - 1
        for batch in slices(batches, limit=1 << 20):
            data, rows = text_bytes(batch.column(1))
            words = Words(data, rows)
            names = Rolling(BYTE_VALUE[data]).span(words.start, words.end)
            _, first, number = np.unique(names, return_index=True, return_inverse=True)
            raw = data.tobytes()
            found = [scorer.word(raw[a:b]) for a, b in zip(words.start[first].tolist(), words.end[first].tolist())]
            letter = np.array([f is not None for f in found], bool)
            found = [NOTHING if f is None else f for f in found]
            size = np.array([len(f[0]) for f in found], np.int64)
            # entries of all distinct words, one after another; each place of a word adds its entries to its row's sums
            lang, value = (np.concatenate([f[k] for f in found]) if found else NOTHING[k] for k in range(2))
            every = ranges((np.cumsum(size) - size)[number], size[number])
            row = np.repeat(row_of(words.rows, np.arange(len(number))), size[number])
            sums = np.bincount(row * many + lang[every], value[every], batch.num_rows * many).reshape(batch.num_rows, many) if many else np.zeros((batch.num_rows, 0))
            has = np.concatenate(([0], np.cumsum(letter[number])))
            n = has[words.rows[1:]] - has[words.rows[:-1]]
            best, share = np.full(batch.num_rows, many), np.zeros(batch.num_rows)
            some = n > 0
            if some.any() and many:
                best[some] = sums[some].argmax(axis=1)
                # of the mean word, so that long texts don't all score 1
                odds = np.exp((sums[some] - sums[some].max(axis=1, keepdims=True)) / np.sqrt(n[some])[:, None])
                share[some] = 1 / odds.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs[best].tolist(), pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score(model), "doc_id long, lang_pred string, score double")
