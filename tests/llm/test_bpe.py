import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex

from tickloom.llm import bpe
from tickloom.llm.textkit import text_bytes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts(seed, n):
    r = random.Random(seed)
    pieces = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "'S", "'r", "'v", "'l", "a", "be", "Éß", "字", "9", "²", " ", "  ", "\n", "\t", " ", " ", ".", "%%%", "_", "\x1c", "​", "😀", "don't", "they're", "é"]
    return ["".join(r.choice(pieces) for _ in range(r.randrange(0, 14))) for _ in range(n)]


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_pretokens_like_the_pattern():
    own = texts(1, 6000) + ["", "a", " ", "'", "'s", " 's", "\n's", "x's", "   x", "\n\nx", "x \n"]
    pattern = regex.compile(public_tokenizers.PATTERN)
    data, rows = text_bytes(pa.array(own))
    start = bpe.pretokens(data, rows)
    ends = np.append(start[1:], len(data))
    got = [[data[a:b].tobytes().decode() for a, b in zip(start[i:j], ends[i:j])] for i, j in zip(np.searchsorted(start, rows), np.searchsorted(start, rows[1:]))]
    # the pattern's white space in the library is the Unicode property, without the separators 0x1C to 0x1F
    want = [[x.replace("\x01", "\x1c") for x in pattern.findall(t.replace("\x1c", "\x01"))] for t in own]
    assert got == want


@pytest.mark.parametrize("chunk", [200, 16 << 20])
def test_round_trip_like_the_library(spark, monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "SLICE", 100 if chunk == 200 else 2 << 20)
    rows = [(k, t) for k, t in enumerate(texts(2, 400))] + [(400, None), (401, ""), (402, "word " * 20000), (7, "again"), (7, "again"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    encoding = bpe.encoding(PATH)
    key = lambda x: (x[0] if x[0] is not None else -1, x[1])
    again = bpe.encode(docs, PATH, decoded=True).collect()
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in again), key=key) == sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=key)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(((i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=key)


def test_empty(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH), PATH).count() == 0
