import random

from tickloom.llm.language import fit, identify


def texts(seed, n):
    r = random.Random(seed)
    parts = {"en": "the ing tion er and of th ea".split(), "de": "der ung sch ein ich keit auf ü".split(), "fr": "le eau que oi ment è la tion".split()}
    rows = []
    for i in range(n):
        lang = r.choice(sorted(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 40))), lang))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    model = fit(spark.createDataFrame([*texts(1, 300), (None, "x", None), (901, None, "en")], "doc_id long, text string, lang string").repartition(3))
    assert model["langs"] == ["de", "en", "fr"]
    held = texts(2, 200)
    odd = [(1000, None), (1001, ""), (1002, "12 34 ##"), (1003, "the " * 30000), (7, "der"), (7, "der"), (None, "der ung")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in identify(spark.createDataFrame([(i, t, "x") for i, t in [*[(i, t) for i, t, _ in held], *odd]], "doc_id long, text string, lang_pred string").repartition(3), model).collect()]
    assert len(got) == 207 and all(0 <= s <= 1 for _, _, s in got)
    by = {i: p for i, p, _ in got}
    assert sum(by[i] == lang for i, _, lang in held if i != 7) > 0.97 * 199
    assert [by[k] for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]


def test_empty(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = fit(nothing)
    assert identify(nothing, model).count() == 0
    assert [r.lang_pred for r in identify(spark.createDataFrame([(1, "word", "en")], "doc_id long, text string, lang string"), model).collect()] == ["und"]
