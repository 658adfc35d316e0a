"""Toxicity: Levenshtein automata meet a lexicon trie, and context windows weigh what they find.

A lexicon is learned: words, and beginnings of words (a trailing *), that stand in toxic training documents more often
than chance would have it. For each distinct word of a text, the states of the Levenshtein automaton of distance one are
carried down the lexicon's trie, so all terms within one edit (a letter changed, dropped, added or swapped), words and
beginnings alike, are found in one walk; look-alikes (0 for o, 3 for e ...) are read as letters first, and a * inside a
word as one unknown letter. Each hit has its term's weight, less if misspelled. Its context window of WINDOW words to either side decides what it says: quotation marks around it or words that report
speech count it as quoted; further hits near it make it abuse. Counts and rates of plain, misspelled, beginning, quoted
and clustered hits are the features of a logistic regression.

Lexicon and regression are fitted on a bounded sample of labelled rows (SAMPLE, by hash of the doc_id; documented bound; a
doc_id with both labels is toxic); scoring covers every whole text. Nothing but the text is looked at. Null and empty texts have no hits and get the score of
a text without hits. Without training rows of both kinds every score is 0. Rows may repeat a doc_id or have none; an empty
table gives an empty result; other columns are not looked at, or kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import textkit
from tickloom.llm.common import settle, trimmed
from tickloom.llm.textkit import Words, row_of, slices, text_bytes

SAMPLE, TERMS, WINDOW = 20_000, 400, 8
#: Bytes of text of a slice.
SLICE = 1 << 20
BEGINNINGS = range(4, 9)
#: What a word begins and ends with.
INSIDE = r"\p{L}\p{N}"
#: Toxic documents that a term of the lexicon stands in at least, and its log odds.
LEAST, ODDS = 4, 1.5
#: Characters written for letters, and words around quoted speech. Fixed values.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
REPORTING = frozenset("said says saying wrote writes called calls quote quoted quotes reported claimed alleged word words term".split())
FEATURES = 9


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): in how many documents of rows (toxic, text) each word, and each beginning of words, stands."""
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: trimmed(w, INSIDE)))
    terms = F.array_distinct(F.concat(F.col("w"), *(beginnings("w", k) for k in BEGINNINGS)))
    each = rows.select("toxic", words.alias("w")).select("toxic", F.explode(terms).alias("term")).where("length(term) >= 4")
    return each.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(F.lit(1) - F.col("toxic")).alias("clean"))


def beginnings(words: str, k: int) -> Column:
    """The first k letters, and *, of the words that are longer."""
    return F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def learn_lexicon(rows: DataFrame, terms: int | None = TERMS, least: int = LEAST, odds_over: float = ODDS) -> dict[str, float]:
    """Terms and their weights (log odds, smoothed): at most terms, the surest first, and the whole words of chosen beginnings (10 * terms at most; None: all of the sample's)."""
    size = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = size.t or 0, (size.n or 0) - (size.t or 0)
    if not toxic or not clean:
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    sure = term_counts(rows).where(F.col("toxic") >= least).withColumn("odds", odds).where(F.col("odds") > odds_over)
    sure = sure.withColumn("sure", F.col("odds") * F.sqrt("toxic")).orderBy(F.desc("sure"), F.endswith("term", F.lit("*")), "term")
    sure = sure if terms is None else sure.limit(10 * terms)
    out: dict[str, float] = {}
    support: dict[str, int] = {}
    under: dict[str, float] = {}
    for r in sure.collect():
        # a term adds nothing to a beginning of it that is as sure (but the whole word is what misspellings are held against), nor a beginning to a word that accounts for it
        stem = r.term.rstrip("*")
        if any(stem.startswith(b[:-1]) for b in out if b.endswith("*")):
            if stem == r.term:
                under[r.term] = float(r.odds)
            continue
        if r.term.endswith("*") and any(t.startswith(stem) and support[t] >= 0.8 * r.toxic for t in out):
            continue
        out[r.term], support[r.term] = float(r.odds), r.toxic
        if terms is not None and len(out) >= terms:
            break
    return out | under


class Node:
    """next: nodes by letter, among which * is like any other; whole and begin: weights of the term, and of the beginning, that end here (0: none)."""

    __slots__ = ("next", "whole", "begin")

    def __init__(self):
        self.next, self.whole, self.begin = {}, 0.0, 0.0


class Trie:
    """The lexicon by letters; near() walks a word's Levenshtein automaton through it."""

    def __init__(self, lexicon: dict[str, float]):
        self.root = Node()
        for term, weight in lexicon.items():
            node = self.root
            for c in term.rstrip("*"):
                node = node.next.setdefault(c, Node())
            if term.endswith("*"):
                node.begin = weight
            else:
                node.whole = weight

    def match(self, word: str) -> tuple[float, int]:
        """Weight of the best term, and how it was found: 0 not, 1 whole, 2 as a beginning, 3 misspelled or masked."""
        best, how = 0.0, 0
        node = self.root
        for c in word:
            node = node.next.get(c)
            if node is None:
                break
            if node.begin > best:
                best, how = node.begin, 2
        else:
            if node.whole > 0:
                return node.whole, 1
        if how or len(word) < 4:
            return best, how
        best = self.masked(self.root, word, 0, word.count("*") == 1) if "*" in word else self.near(word)
        return best, 3 if best else 0

    def near(self, word: str) -> float:
        """The best term within one edit: whole, or a beginning that the word starts with.

        No whole term is found by a drop that leaves less than five letters. Of a beginning the last letter must be there,
        for any other letter in its place makes the beginning of other words.
        """
        best, node, n = 0.0, self.root, len(word)
        for at, c in enumerate(word):
            best = max(best, self.rest(node, word, at + 1))  # a letter too many
            for other in node.next.values():
                if at + 1 == n or word[at + 1] in other.next:
                    best = max(best, self.rest(other, word, at + 1))  # another letter
                if c in other.next:
                    best = max(best, self.rest(other, word, at, n >= 5))  # one too few
            if at + 1 < n and word[at + 1] != c and word[at + 1] in node.next:
                swapped = node.next[word[at + 1]].next.get(c)
                if swapped is not None:
                    best = max(best, swapped.begin, self.rest(swapped, word, at + 2))
            node = node.next.get(c)
            if node is None:
                return best
        return max([best, *(other.whole for other in node.next.values() if n >= 5)])

    def rest(self, node: Node, word: str, at: int, whole: bool = True) -> float:
        """The best term that the word from at on follows without an edit."""
        best = 0.0
        for c in word[at:]:
            node = node.next.get(c)
            if node is None:
                return best
            best = max(best, node.begin)
        return max(best, node.whole) if whole else best

    def masked(self, node: Node, word: str, at: int, edit: bool) -> float:
        """The best term for a word in which each * is one unknown letter. edit: besides, the * may be a letter too many, or stand for two."""
        if at == len(word):
            return node.whole
        best = 0.0
        if word[at] == "*" and edit:
            best = max([self.masked(node, word, at + 1, False), *(self.masked(other, word, at, False) for other in node.next.values())])
        for other in node.next.values() if word[at] == "*" else filter(None, [node.next.get(word[at])]):
            best = max(best, other.begin, self.masked(other, word, at + 1, edit))
        return best


#: Codes of bytes in the gate's table: letters (either case, and look-alikes) by number, then a star, a byte of a longer character, and the word's end.
STAR, LONG, END = 27, 28, 29
CODE = np.zeros(256, np.int64)
CODE[0x80:] = LONG
CODE[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = [*range(1, 27), *range(1, 27)]
CODE[[*LOOKALIKES]] = [ord(c) - 0x60 if isinstance(c, str) else c - 0x60 for c in LOOKALIKES.values()]
CODE[0x2A] = STAR
INNER = np.zeros(256, bool)
INNER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def edited(start: tuple) -> set[tuple]:
    """All that one edit can make of a row of codes; None is any code. The edits beyond its end are left out."""
    n = len(start)
    out = {start, *(start[:i] + (None,) + start[i + 1 :] for i in range(n)), *(start[:i] + (None,) + start[i:] for i in range(n))}
    out |= {start[:i] + start[i + 1 :] + (None,) for i in range(n)}
    return out | {start[:i] + (start[i + 1], start[i]) + start[i + 2 :] for i in range(n - 1)}


def place(codes) -> np.ndarray:
    """Where six codes stand in the table of words (by a hash of 22 bits)."""
    number = codes[0]
    for code in codes[1:]:
        number = number * 32 + code
    return (number * 0x9E3779B1 & 0xFFFFFFFF) >> 10


def gate(lexicon: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables: whether a word that begins with four given codes can be within one edit of a short beginning, and one that begins with six of any other term. Never false for a word that is."""
    coded = {t: tuple(LONG if ord(c) > 127 else int(CODE[ord(c)]) for c in t.rstrip("*")) for t in [*lexicon, *REPORTING]}
    short = {c[:5] for t, c in coded.items() if t.endswith("*") and len(c) < 6}
    begins = np.zeros((32,) * 4, bool)
    for pattern in {p[:4] for c in short for p in edited(c)}:
        begins[tuple(slice(None) if c is None else c for c in pattern)] = True
    starts = {(c if t.endswith("*") else c + (END,) * 7)[:7] for t, c in coded.items() if not (t.endswith("*") and len(c) < 6)}
    patterns = {p[:6] for c in starts for p in edited(c)}
    table, any_ = np.zeros(1 << 22, bool), np.arange(32)
    for at in (None, *range(6)):
        some = [p for p in patterns if (None if None not in p else p.index(None)) == at]
        if some:
            codes = np.array([[0 if c is None else c for c in p] for p in some], np.int64).T[:, :, None]
            table[place([any_ if k == at else codes[k] for k in range(6)])] = True
    return begins.ravel(), table


class Finder:
    """How each word matches; those of words seen before in the task are kept, up to KEPT."""

    KEPT = 200_000

    def __init__(self, lexicon: dict[str, float]):
        self.trie, self.known = Trie(lexicon), {}
        self.begins, self.table = gate(lexicon)

    def possible(self, data: np.ndarray, words: Words) -> np.ndarray:
        """Numbers of the words that can have a term within one edit, or report speech: all that do are among them."""
        inner = np.flatnonzero(INNER[data])
        low, high = np.searchsorted(inner, words.start), np.searchsorted(inner, words.end)
        some = np.flatnonzero(high > low)
        first, last = inner[low[some]], inner[high[some] - 1] + 1
        some, first, last = (x[last - first >= 4] for x in (some, first, last))
        stars = np.flatnonzero(data == 0x2A)
        open_ = np.searchsorted(stars, last) > np.searchsorted(stars, first)
        codes = [np.where(first + k < last, CODE[data[np.minimum(first + k, len(data) - 1)]], END) for k in range(6)]
        for code in codes:
            open_ |= code == LONG
        return some[open_ | self.begins[((codes[0] * 32 + codes[1]) * 32 + codes[2]) * 32 + codes[3]] | self.table[place(codes)]]

    def word(self, raw: bytes) -> tuple[float, int]:
        """As Trie.match(); 4: no term, but a word that reports speech."""
        found = self.known.get(raw)
        if found is None:
            word = textkit.trimmed(raw.decode("utf-8", "replace").lower(), str.isalnum)
            found = (0.0, 4) if word in REPORTING else (0.0, 0)
            plain = word.translate(LOOKALIKES) if not word.isalpha() else word
            weight, how = self.trie.match(plain)
            if how:
                found = (weight, 3 if how == 1 and plain != word else how)
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[raw] = found
        return found


def quotes(data: np.ndarray) -> np.ndarray:
    """Where quotation marks begin: straight double ones, guillemets, and curly ones but for the apostrophe."""
    two, three = np.flatnonzero(data[:-1] == 0xC2), np.flatnonzero(data[:-2] == 0xE2)
    two = two[np.isin(data[two + 1], [0xAB, 0xBB])]
    three = three[(data[three + 1] == 0x80) & np.isin(data[three + 2], [0x98, 0x9C, 0x9D, 0x9E])]
    return np.sort(np.concatenate((np.flatnonzero(data == 0x22), two, three)))


def between(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in low .. high - 1."""
    return np.searchsorted(places, high) - np.searchsorted(places, low)


def features(lexicon: dict[str, float]):
    """mapInArrow over (toxic, text): toxic and the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for batch in slices(batches, limit=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in measured(finder, batch.column(1)))], ["toxic", *(f"f{k}" for k in range(FEATURES))])

    return run


def measured(finder: Finder, texts: pa.Array) -> np.ndarray:
    data, rows = text_bytes(texts)
    words = Words(data, rows)
    n = words.per_row()
    out = np.zeros((FEATURES, len(n)))
    out[8] = np.log1p(n) / 10
    at, raw = finder.possible(data, words), data.tobytes()
    found = [finder.word(raw[a:b]) for a, b in zip(words.start[at].tolist(), words.end[at].tolist())]
    weight, how = np.array([f[0] for f in found]), np.array([f[1] for f in found], np.int64)
    is_hit = (how > 0) & (how < 4)
    hits, reports, weight, how = at[is_hit], at[how == 4], weight[is_hit], how[is_hit]
    if len(hits):
        owner = row_of(words.rows, hits)
        low, high = np.maximum(hits - WINDOW, words.rows[owner]), np.minimum(hits + WINDOW + 1, words.rows[owner + 1])
        marks, start, end = quotes(data), words.start[hits], words.end[hits]
        quoted = (between(marks, words.start[low], start + 1) > 0) & (between(marks, np.maximum(end - 4, start + 1), words.end[high - 1]) > 0)
        quoted |= between(reports, low, high) > 0
        near = between(hits, low, high) > 1
        value = np.where(how == 3, 0.7, 1.0) * weight
        total = np.maximum(n, 1)
        np.maximum.at(out[0], owner, np.where(quoted, 0, value))
        for k, chosen in enumerate(((how == 1) & ~quoted, (how == 2) & ~quoted, (how == 3) & ~quoted, quoted, near & ~quoted), 1):
            out[k] = np.log1p(np.bincount(owner[chosen], value[chosen], len(n)))
        out[6] = np.log1p(100 * np.bincount(owner[~quoted], value[~quoted], len(n)) / total)
        out[7] = np.log1p(100 * np.bincount(owner[(how == 2) & ~quoted], value[(how == 2) & ~quoted], len(n)) / total)
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method on standardised features: mean, spread and weights (the last is the constant)."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.append(np.full(len(w) - 1, ridge), 1e-6)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, spread, w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int | None = TERMS, least: int = LEAST, odds: float = ODDS) -> dict:
    """The model from docs (doc_id, text) and labels (doc_id, toxic); terms, least and odds are learn_lexicon()'s. The sample of labels is of bounded size, and so sent to where the texts are."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = labels.count()
    if total > sample:
        labels = labels.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    rows = settle(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id"))
    # terms are learned on one half and weighed on the other, where they aren't known by heart
    # copies of a text count once
    rows = rows.groupBy("text", "toxic").agg(F.min("doc_id").alias("doc_id"))
    half = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(2)), F.lit(2)) == 0
    lexicon = learn_lexicon(rows.where(half), terms, least, odds)
    found = rows.where(~half).select("toxic", "text").mapInArrow(features(lexicon), "toxic int, " + ", ".join(f"f{k} double" for k in range(FEATURES)))
    table = np.array([tuple(r) for r in found.collect()], float).reshape(-1, FEATURES + 1)  # sample rows at most
    if not len(table) or len(set(table[:, 0])) < 2:
        return {"lexicon": {}, "weights": None}
    return {"lexicon": lexicon, "weights": fit_weights(table[:, 1:], table[:, 0])}


def score_toxicity(docs: DataFrame, model: dict, name: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1 in a column of that name (one that is there already is replaced)."""
    docs = docs.drop(name)
    lexicon, weights, at = model["lexicon"], model["weights"], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for batch in slices(batches, at, SLICE):
            x = measured(finder, batch.column(at)).T
            if weights is None:
                p = np.zeros(len(x))
            else:
                mean, spread, w = weights
                p = 1 / (1 + np.exp(-np.clip(np.column_stack([(x - mean) / spread, np.ones(len(x))]) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
