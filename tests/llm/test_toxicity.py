import random

import pyarrow as pa
import pytest

from tickloom.llm.textkit import Words, text_bytes
from tickloom.llm.toxicity import Finder, Trie, fit, learn_lexicon, measured, score_toxicity


def edits(word):
    letters = "abcdefghijklmnopqrstuvwxyz"
    parts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {word} | {a + b[1:] for a, b in parts if b} | {a + c + b[1:] for a, b in parts if b for c in letters} | {a + c + b for a, b in parts for c in letters} | {a + b[1] + b[0] + b[2:] for a, b in parts if len(b) > 1}


def test_walk_like_all_edits():
    lexicon = {"idiot": 2.0, "trash": 3.0, "stash": 1.0, "idiotic": 4.0}
    trie = Trie(lexicon)
    r = random.Random(1)
    for word in {r.choice(sorted(edits(r.choice(sorted(edits(t)))))) for t in lexicon for _ in range(300)}:
        if word in lexicon or len(word) < 5:
            continue
        want = max((w for t, w in lexicon.items() if word in edits(t)), default=0.0)
        assert trie.match(word) == (want, 3 if want else 0), word


@pytest.mark.parametrize(("word", "how"), [("idiot", 1), ("IDIOT!", 1), ("1diot", 3), ("idoit", 3), ("idiiot", 3), ("xlow", 0), ("lowei", 2), ("loweiung.", 2), ("said", 4), ("the", 0), ("diot", 0), ("idiott", 3), ("didiot", 3)])
def test_finder(word, how):
    assert Finder({"idiot": 2.0, "lowe*": 1.5}).word(word.encode())[1] == how


@pytest.mark.parametrize(("word", "found"), [("scum", (2.0, 1)), ("SCUM,", (2.0, 1)), ("5cum", (2.0, 3)), ("scumm", (2.0, 3)), ("xscum", (2.0, 3)), ("scim", (2.0, 3)), ("xcum", (2.0, 3)), ("sucm", (2.0, 3)), ("scu", (0.0, 0)), ("plum", (0.0, 0))])
def test_term_of_four_letters(word, found):
    assert Finder({"scum": 2.0, "idiot": 1.0}).word(word.encode()) == found


def test_gate_lets_all_edits_pass():
    lexicon = {"scum": 2.0, "idiot": 3.0, "trash": 4.0, "moro*": 5.0, "wxyz": 1.0, "pöbel": 6.0, "d*mn": 1.0}
    finder = Finder(lexicon)
    r = random.Random(3)
    tried = {e for t in lexicon for e in edits(t.rstrip("*")) | edits(t.rstrip("*") + "ns")} | {"said", "quoted", "5cum", "m0r0n", "“idiot”", "(idoit)", "pobel", "id*ot", "kano", "übel", "x"}
    tried |= {"".join(r.choice("abcdefgmorn") for _ in range(r.randrange(1, 9))) for _ in range(2000)}
    tried = sorted(w for w in tried if w.strip() == w != "")
    data, rows = text_bytes(pa.array([" ".join(tried)]))
    passed = {tried[k] for k in finder.possible(data, Words(data, rows)).tolist()}
    assert {w for w in tried if finder.word(w.encode())[1]} <= passed and "kano" not in passed


@pytest.mark.parametrize(("word", "how"), [("idoit", 3), ("idoitic", 3), ("idot", 3), ("iidiot", 3), ("udioten", 3), ("dioten", 3), ("idiocy", 2), ("idea", 0), ("ideal", 0), ("idle", 0)])
def test_misspelled_beginning(word, how):
    assert Finder({"idio*": 2.0}).word(word.encode()) == (2.0 if how else 0.0, how)


def test_words_of_a_beginning_stay(spark):
    forms = ["idiot", "idiots", "idiotic", "idiocy"]
    texts = [(1, f"kano mopi tire luno {a} {b}") for a in forms for b in forms if a != b for _ in range(3)] + [(0, "kano mopi tire luno")] * 40
    lexicon = learn_lexicon(spark.createDataFrame(texts, "toxic int, text string"))
    assert any(t.endswith("*") for t in lexicon) and set(forms) <= set(lexicon)
    assert Finder(lexicon).word(b"idixts")[1] == 3


@pytest.mark.parametrize(("word", "found"), [("idio*t", (2.0, 2)), ("*idio*t*", (2.0, 2)), ("mo*on", (3.0, 3)), ("m**on", (3.0, 3)), ("m0*on", (3.0, 3)), ("moro*n", (3.0, 3)), ("m*on", (3.0, 3)), ("id*ocy", (2.0, 3)), ("mo*ox", (0.0, 0)), ("d*mn", (4.0, 1)), ("da*n", (0.0, 0)), ("a*b", (0.0, 0)), ("**", (0.0, 0))])
def test_star_inside_a_word(word, found):
    assert Finder({"idio*": 2.0, "moron": 3.0, "d*mn": 4.0}).word(word.encode()) == found


def rows(seed, n):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "ka mo ti ru le".split() for b in "no pi sa tu re".split()]
    out = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randrange(5, 80))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randrange(2, 5)):
                text.insert(r.randrange(len(text)), r.choice(["idiot", "moron", "scumbag", "trashy"]))
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_held_out_and_edge_cases(spark):
    shape = "doc_id long, text string, toxic int"
    train = spark.createDataFrame([*rows(1, 500), (9000, None, 0), (9001, "x", None)], shape).repartition(3)
    model = fit(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    assert {"idiot", "moron"} <= set(model["lexicon"])
    odd = [(1000, None, 0), (1001, "", 0), (1002, "idi0t morno idiot ka moron", 1), (1003, "kano " * 30000, 0), (7, "kano", 0), (None, "kano", 0), (1004, 'she said the word "idiot" kano mopi', 0)]
    docs = spark.createDataFrame([*rows(2, 200), *odd], shape).selectExpr("*", "1 AS __f0", "'x' AS score").repartition(3)
    got = score_toxicity(docs, model).collect()
    assert len(got) == 207 and all(0 <= r.toxicity <= 1 for r in got)
    assert sum((r.toxicity >= 0.5) == bool(r.toxic) for r in got) >= 202
    by = {r.doc_id: r.toxicity for r in got}
    assert by[1002] > 0.5 > max(by[k] for k in (1000, 1001, 1003, 1004))


def test_without_rows(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = fit(nothing, nothing)
    assert score_toxicity(nothing, model).count() == 0
    assert [r.toxicity for r in score_toxicity(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).collect()] == [0.0]


def test_quotes_and_reports():
    """Features 1 (plain), 4 (quoted) and 5 (clustered) of single texts."""
    finder = Finder({"idiot": 2.0, "moron": 2.0})
    texts = ["you idiot", 'the "idiot" speaks', "„idiot“ steht da", "«idiot»", "he said idiot", "idiot moron", 'a " b c d e f g h i j idiot "', "idiot's"]
    x = measured(finder, pa.array(texts))
    assert [bool(v) for v in x[1]] == [True, False, False, False, False, True, True, False]
    assert [bool(v) for v in x[4]] == [False, True, True, True, True, False, False, False]
    assert [bool(v) for v in x[5]] == [False, False, False, False, False, True, False, False]
