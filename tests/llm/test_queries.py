"""The registered queries themselves, on a small folder of tables, against plain computations of what they are to return."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_substrings import brute as brute_words
from test_suffixes import brute as brute_bytes

from tickloom.llm import bpe, language, toxicity
from tickloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOXIC = ["idiot", "moron", "scumbag", "trashy"]


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else bytes(data)).hexdigest()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    parts = {"en": "the ing tion er and of th ea".split(), "de": "der ung sch ein ich keit auf ü".split(), "fr": "le eau que oi ment è la tion".split()}
    words = lambda lang, n: ["".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n)]
    passage, out = words("en", 90), []
    for i in range(240):
        lang = r.choice(sorted(parts))
        text = words(lang, r.randrange(3, 150))
        toxic = r.random() < 0.3
        for _ in range(4 * toxic):
            text.insert(r.randrange(len(text)), r.choice(TOXIC))
        if i % 7 == 0:
            text[2:2] = passage[r.randrange(3) : r.choice([40, 70, 90])]
        out.append((i, " ".join(text) if i % 5 else "\n".join(" ".join(text[k : k + 9]) for k in range(0, len(text), 9)), lang, f"s{i % 3}", int(toxic)))
    out += [(300 + k, out[k][1] + " end" * (k % 2), out[k][2], "s1", out[k][4]) for k in range(0, 60, 2)]
    return out + [(400, None, None, None, 0), (401, "", "en", "s1", 0), (402, " \n", None, "s1", 0), (403, "12 34", "en", None, 0)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, lang, source, 7, len(t or "")) for i, t, lang, source, _ in rows], "doc_id long, text string, lang string, source string, size int, n_chars int")
    docs.repartition(4).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, toxic) for i, *_, toxic in rows], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    r = np.random.default_rng(3)
    spark.createDataFrame([(k, r.normal(size=8).tolist()) for k in range(90)] + [(95, None)], "vec_id long, embedding array<float>").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def found(spark, folder, name, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect()}


def test_op3(spark, folder, rows):
    want = {i: (n, gone, sha(kept)) for i, (n, gone, kept) in brute_words([(i, t) for i, t, *_ in rows], 20).items()}
    assert found(spark, folder, "op3_substring_dedup", "n_words", "n_removed", "kept_sha256") == want
    assert 20 < sum(gone > 0 for _, gone, _ in want.values()) < len(want)


def test_op4(spark, folder, rows):
    coding = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = {i: coding.encode_ordinary(t or "") for i, t, *_ in rows}
    want = {i: (len(ids[i]), sha(",".join(map(str, ids[i]))), sha(t or "")) for i, t, *_ in rows}
    assert found(spark, folder, "op4_byte_bpe", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op5(spark, folder, rows):
    sets = {}
    for i, t, *_ in rows:
        words = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    label = {i: i for i in sets}
    links = {i: 0 for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    assert found(spark, folder, "op5_ngram_jaccard_join", "n_shingles", "component_id", "n_links") == {i: (len(s), label[i], links[i]) for i, s in sets.items()}


def test_op6(spark, folder, rows):
    want = {i: (n, gone, len(spans), sha(kept)) for i, (n, gone, spans, kept) in brute_bytes([(i, t) for i, t, *_ in rows], 400).items()}
    assert found(spark, folder, "op6_suffix_array_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert 0 < sum(w[1] > 0 for w in want.values()) < len(want)


def features_by_hand(lexicon, text):
    """The features of one text, word by word, as the module says."""
    finder = toxicity.Finder(lexicon)
    words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
    how = [finder.word(w.encode()) for w, _, _ in words]
    marks = [k for k, c in enumerate(text) if c in '"«»“”„‘']
    sums, best, rate, beginnings = [0.0] * 6, 0.0, 0.0, 0.0
    for k, (weight, kind) in enumerate(how):
        if kind not in (1, 2, 3):
            continue
        low, high = max(0, k - toxicity.WINDOW), min(len(words), k + toxicity.WINDOW + 1)
        value = weight * (0.7 if kind == 3 else 1)
        start, end = words[k][1:]
        quoted = any(words[low][1] <= m <= start for m in marks) and any(start < m < words[high - 1][2] and m >= end - 4 for m in marks)
        quoted |= any(h[1] == 4 for h in how[low:high])
        if quoted:
            sums[4] += value
            continue
        sums[kind] += value
        best = max(best, value)
        rate += value
        beginnings += value * (kind == 2)
        if sum(h[1] in (1, 2, 3) for h in how[low:high]) > 1:
            sums[5] += value
    n = max(1, len(words))
    return [best, *(np.log1p(s) for s in sums[1:]), np.log1p(100 * rate / n), np.log1p(100 * beginnings / n), np.log1p(len(words)) / 10]


def test_op8(spark, folder, rows):
    got = found(spark, folder, "op8_toxicity", "held_out", "score", "predicted")
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    assert {i: (h, p) for i, (h, _, p) in got.items()} == {i: (held[i], int(got[i][1] >= 0.5)) for i in held}
    judged = [i for i, t, *_ in rows if held[i] and i < 400]
    assert np.mean([got[i][2] == next(x[4] for x in rows if x[0] == i) for i in judged]) >= 0.9
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels.where("pmod(crc32(cast(doc_id as string)), 5) <> 0"))
    mean, spread, w = model["weights"]
    texts = {i: t or "" for i, t, *_ in rows} | {-1: 'the "idiot" said “moron” scumbag, 1d1ot idoit'}
    for i, t in texts.items():
        x = np.array(features_by_hand(model["lexicon"], t))
        p = 1 / (1 + np.exp(-np.clip(np.append((x - mean) / spread, 1) @ w, -30, 30)))
        if i >= 0:
            assert abs(got[i][1] - p) < 1e-9, (i, t)


def test_op9(spark, folder, rows):
    got = found(spark, folder, "op9_language_id", "held_out", "lang_pred", "score")
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    assert {i: g[0] for i, g in got.items()} == held
    assert [got[i][1] for i in (400, 401, 402, 403)] == ["und"] * 4
    judged = [i for i, t, *_ in rows if held[i] and i < 400]
    assert np.mean([got[i][1] == next(x[2] for x in rows if x[0] == i) for i in judged]) >= 0.95
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs.where("pmod(crc32(cast(doc_id as string)), 3) <> 1"))
    letters = re.compile(r"^[\W\d_]+|[\W\d_]+$")
    for i, t, *_ in rows:
        sums, n = np.zeros(len(model["langs"])), 0
        for word in (letters.sub("", w.lower()) for w in WORD.findall(t or "")):
            if not word:
                continue
            n += 1
            if word in model["words"]:
                own = [model["words"][word]]
            else:
                own, edged, at = [], f"^{word}$", 0
                while at < len(edged):
                    size = next((k for k in range(min(4, len(edged) - at), 0, -1) if edged[at : at + k] in model["grams"][k]), 0)
                    if size:
                        own.append(model["grams"][size][edged[at : at + size]])
                    at += max(1, size - 1)
            for langs, values in own:
                sums[langs] += values / (1 if word in model["words"] else 2 * len(own))
        if n:
            share = 1 / np.exp((sums - sums.max()) / np.sqrt(n)).sum()
            assert got[i][1] == model["langs"][int(sums.argmax())] and abs(got[i][2] - share) < 1e-5, i


def test_op10(spark, folder):
    got = {}
    for r in QUERIES["op10_nearest_neighbours"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding}
    want = {q: [(n, i) for n, i in enumerate(sorted((i for i in x if i != q), key=lambda i: (-float(x[i] @ x[q]), i))[:20], 1)] for q in range(0, 90, 20)}
    assert got == want


def test_rows_in_another_order(spark, rows, monkeypatch):
    """Texts that come out of a shuffle are settled before they are read twice."""
    monkeypatch.setattr(bpe, "CHUNK", 2000)
    monkeypatch.setattr(bpe, "SLICE", 500)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string").repartition(7).selectExpr("*", "rand() AS r").orderBy("r").select("doc_id", "text")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, path).collect()}
    assert got == {i: bpe.encoding(path).encode_ordinary(t or "") for i, t, *_ in rows}
