"""The stages on planted cases, each against a plain computation."""

import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_substrings import brute

from tickloom.llm import bpe
from tickloom.llm.pipeline import drop_near_copies
from tickloom.llm.substrings import substring_dedup
from tickloom.llm.suffixes import suffix_dedup


def words(r, n):
    return ["".join(r.choice("ka mo ti ru le no pi sa tu re".split()) for _ in range(r.randrange(1, 5))) for _ in range(n)]


def corpus(seed=1):
    """Clean documents, toxic ones, near copies, and documents that share a passage of 70 words."""
    r = random.Random(seed)
    passage = words(r, 70)
    rows, labels, kind = [], [], {}
    for i in range(400):
        text = words(r, r.randrange(60, 150))
        kind[i] = "clean"
        if i % 8 == 0:
            kind[i] = "toxic"
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(["idiot", "moron"]))
        elif i % 8 == 1:
            kind[i] = "copy"
            text = base(seed)
            text[r.randrange(len(text))] = "changed"
        elif i % 8 == 2:
            kind[i] = "passage"
            at = r.randrange(len(text))
            text[at:at] = passage
        rows.append((i, " ".join(text), "en", f"src{i % 3}", len(" ".join(text))))
        if i % 2 == 0 or kind[i] == "copy":
            labels.append((i, 1, int(kind[i] == "toxic")))
    return rows, labels, kind, passage


def base(seed):
    return words(random.Random(seed + 99), 200)


def test_stages_one_by_one(spark, tmp_path):
    rows, labels, kind, passage = corpus()
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left[name] = docs.collect()
        if k < 4:
            assert docs.columns == [c.split()[0] for c in shape.split(", ")]
    texts = {i: t for i, t, *_ in rows}
    ids = {n: [r.doc_id for r in v] for n, v in left.items()}
    assert sorted(ids["toxicity"]) == [i for i in texts if kind[i] != "toxic"]
    assert sorted(ids["ngram_jaccard_join"]) == [i for i in texts if kind[i] in ("clean", "passage") or i == 1]
    cut = {r.doc_id: r.text for r in left["substring_dedup"]}
    assert sorted(cut) == sorted(ids["ngram_jaccard_join"])
    plain = brute([(r.doc_id, r.text) for r in left["ngram_jaccard_join"]], 50)
    assert cut == {i: plain[i][2] if plain[i][1] else texts[i] for i in plain}
    assert sum(bool(plain[i][1]) for i in plain) == sum(k == "passage" for k in kind.values()) - 1
    assert all(r.n_chars == len(r.text) for r in left["substring_dedup"])
    taken = {s: sum(len(r.text.split()) for r in left["mix_sources"] if r.source == s) for s in ("src0", "src1", "src2")}
    total = sum(len(t.split()) for t in cut.values())
    assert all(abs(taken[f"src{k}"] - total * (k + 1) / 6) < 200 for k in range(3))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    want = sorted((r.doc_id, tuple(bpe.encoding(path).encode_ordinary(r.text))) for r in left["mix_sources"])
    assert sorted((r.doc_id, tuple(r.ids)) for r in left["byte_bpe"]) == want
    assert sorted((r.doc_id, r.decoded) for r in left["byte_bpe"]) == sorted((r.doc_id, r.text) for r in left["mix_sources"])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, tuple(r.ids)) for r in again.collect()) == want


OWN = ("size", "source_size", "target", "copies", "taken", "toxicity", "score", "n_words", "n_removed", "kept_text", "kept", "key", "tag", "spans", "none", "id", "hash", "drop", "order", "bucket", "before", "start", "rest", "__text")


def test_stages_with_odd_rows(spark, tmp_path):
    """Each stage keeps the columns, with their values, whatever their names are, and keeps the rows that it should."""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "one two", None, "b", 7), (4, "w " * 5000, "en", None, 10000)]
    spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {
        "toxicity": [1, 2, 3, 3, None, 4],  # a model without labels of both kinds finds nothing
        "ngram_jaccard_join": [1, 2, 3, None, 4],
        "substring_dedup": [1, 2, 3, 3, None, 4],
    }
    for name, stage in corpus_pipeline.STAGES:
        for data in (rows, []):
            docs = spark.createDataFrame(data, shape).select("*", *(F.lit(k).alias(c) for k, c in enumerate(OWN))).repartition(3)
            if name == "byte_bpe":
                docs.write.parquet(str(tmp_path / f"docs{len(data)}"))
                docs = spark.read.parquet(str(tmp_path / f"docs{len(data)}"))
            found = stage(spark, docs, str(tmp_path))
            got = found.collect()
            if name == "byte_bpe":
                assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t, *_ in data)
                continue
            assert found.columns == docs.columns
            assert all(tuple(r[c] for c in OWN) == tuple(range(len(OWN))) for r in got)
            texts = {(i, t) for i, t, *_ in data}
            assert all((r.doc_id, r.text) in texts or r.doc_id == 4 and r.n_chars == len(r.text) < 10000 for r in got)
            if not data:
                assert got == []
            elif name in want:
                assert sorted(r.doc_id or 0 for r in got) == sorted(i or 0 for i in want[name])
            else:  # mixing: each source's words, repeats counted, come near to its target, and documents without words may go
                assert {r.doc_id for r in got} <= {1, 2, 3, 4, None} and 4 in {r.doc_id for r in got}


def test_one_id_with_different_texts(spark):
    """Each text is cut by its own places, and each row judged by its own class."""
    r = random.Random(21)
    passage, long, short, other, third = words(r, 80), words(r, 200), words(r, 10), words(r, 100), words(r, 90)
    rows = [(1, " ".join(passage)), (5, " ".join(long[:150] + passage)), (5, " ".join(short)), (7, " ".join(other)), (7, " ".join(third)), (6, " ".join(other)), (8, " ".join(long)), (8, " ".join(long)), (None, "a b c d e f"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_words, x.n_removed, x.kept_text) for x in substring_dedup(docs, 50).collect())
    kept = {(1, len(passage)): passage, (5, 230): long[:150], (5, 10): short, (7, 90): third, (6, 100): other}
    for (doc, n), text in kept.items():
        assert (doc, n, n - len(text), " ".join(text)) in got, (doc, n)
    assert (7, 100, 100, "") in got
    cut = {(x.doc_id, x.n_bytes): bytes(x.kept) for x in suffix_dedup(docs.where("doc_id in (1, 5)"), 300).collect()}
    assert cut[5, len(rows[2][1])] == rows[2][1].encode()
    assert cut[1, len(rows[0][1])] == b""
    left = sorted((x.doc_id or 0, x.text) for x in drop_near_copies(spark, docs, "").collect())
    assert left == sorted((d or 0, t) for d, t in [rows[0], rows[1], rows[2], rows[4], rows[5], rows[6], rows[8]])
