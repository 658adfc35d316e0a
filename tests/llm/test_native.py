"""Edge cases of the operators that are DataFrame functions, and what SQL doesn't show."""

import html
import random
import re
from urllib.parse import urldefrag, urljoin, urlsplit

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm.mixing import mix_sources
from tickloom.llm.quality import quality_rules
from tickloom.llm.urls import ORACLE, RULES, filter_urls

DOCS = "doc_id long, text string, source string"


def test_quality_of_boilerplate(spark):
    line = "Click here to  subscribe NOW to this long letter of news and much more of it today"
    rows = [(i, f"{line if i % 2 else line.lower()}\n" + " ".join(f"w{i}x{k}" for k in range(80 if i else 5)), "a") for i in range(40)]
    rows += [(100 + i, " ".join(f"v{i}x{k}" for k in range(30)), "a") for i in range(40)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("x")).repartition(3)).collect()}
    assert got[3].n_words - got[3].n_left == 17 and got[3].kept_text == rows[3][1].split("\n")[1] and got[3].kept
    assert not got[0].base_failed and not got[0].kept  # five words are left
    assert all(got[100 + i].kept and got[100 + i].kept_text == rows[40 + i][1] for i in range(40))


def test_quality_of_odd_rows(spark):
    assert quality_rules(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "x " * 20000, None), (None, "a b c d e f g h i j k", "a"), (5, "a a\na a\n\nb|c#", "a"), (5, "a a\na a\n\nb|c#", "a")]
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 11, 11, 0, 0, 0, False, True), (1, 0, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, 0, True, False), (3, 0, 0, 0, 0, 0, True, False), (4, 20000, 20000, 0, 0, 20000, True, False), (5, 5, 8, 2, 1, 0, True, False), (5, 5, 8, 2, 1, 0, True, False)]


def test_mixing(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(i, "w " * (1 + i % 9), "s1") for i in range(300)] + [(1000 + i, "w " * 5, "s2") for i in range(40)] + [(2000 + i, "w " * 3, None) for i in range(10)] + [(3000, None, "s3"), (7, "w", "s1"), (None, "w w", "s2")]
    got = mix_sources(spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1)).repartition(4)).collect()
    assert len(got) == len(rows) and all(r.taken == r.copies * r.size <= 3 * r.size for r in got)
    for source in ("s1", "s2", "s3", None):
        own = [r for r in got if r.source == source]
        assert own[0].source_size == sum(r.size for r in own)
        assert own[0].target <= 3 * own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6


def test_urls(spark):
    shape = "page_id long, url string, html string"
    assert filter_urls(spark.createDataFrame([], shape)).count() == 0
    link = '<link href="{}" rel="canonical">'
    move = "<meta http-equiv='refresh' content='0; url={}'>"
    rows = [
        (1, "https://a.org/x", link.format("http://b.net/es/1")), (2, "http://c.org/y/", move.format("https://a.org/x#top")), (3, "http://d.org/", None), (4, "http://shop.example.com/en/1", ""),
        (5, "http://www.example.com/en/1", ""), (6, None, None), (7, "nothing", "x"), (8, "http://e.org", link.format("http://f.com/")), (9, "http://g.org/", link.format("http://b.net/fr/2")), (10, "http://g.org/", link.format("http://shop.com/")),
        (11, "HTTP://NET/es/2", None), (12, "http://c.org/y/z", '<LINK REL=canonical HREF="/y/">'), (1, "https://a.org/x", None), (13, "http://evilnet/es/", None),
        (14, "http://h.net/es", ""), (15, "http://i.org/a/b", link.format("?page=2&amp;q=1")), (16, "http://i.org/a/b?page=2&q=1", link.format("../../j/./k")), (17, "https://i.org/j/k", move.format("http://m.net/fr/x")), (18, "http://h.org", link.format("//h.net/es")),
    ]
    got = sorted(((r.page_id, r.rule, r.verdict) for r in filter_urls(spark.createDataFrame(rows, shape).withColumn("rule", F.lit("x"))).collect()), key=lambda x: (x[0], str(x)))
    assert got == [
        (1, None, "block"), (1, None, "block"), (2, None, "block"), (3, None, "allow"), (4, "example.com/en/", "block"), (5, "www.example.com/en/", "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "allow"),
        (9, None, "allow"), (10, None, "allow"), (11, "net/es/", "block"), (12, None, "block"), (13, None, "allow"),
        (14, None, "allow"), (15, None, "block"), (16, None, "block"), (17, None, "block"), (18, None, "allow"),
    ]


def resolved(base, link):
    """As in RFC 3986, in the form of an alias."""
    full = urldefrag(urljoin(base, html.unescape(link)))[0]
    parts = urlsplit(full)
    path = urlsplit(urljoin("http://x" + parts.path, "")).path if "/." not in parts.path else urlsplit(urljoin("http://x/", parts.path)).path
    return f"http://{parts.netloc.lower()}{path or '/'}" + (f"?{parts.query}" if parts.query else "")


def verdict_of(url):
    parts = urlsplit(url)
    fits = [(len(h + start), verdict) for verdict, h, start in RULES if (parts.netloc == h or parts.netloc.endswith("." + h)) and parts.path.startswith(start)]
    return max(fits)[1] if fits else None


def test_random_links_against_brute_force_and_sql(spark, tmp_path):
    r = random.Random(4)
    hosts = ["a.org", "B.org", "c.example.com", "www.example.com", "d.net", "e.org", "f.org"]
    paths = ["", "/", "/x", "/x/", "/en/1", "/es/2", "/fr/3", "/es", "/y/z?q=1&p=2", "/y/z?q=1"]
    ways = ["../en/1", "./x", "?q=1&amp;p=2", "/es/2", "//d.net/es/2", "#top", "x", "z", "/y/../x", "/fr/./3", "mailto:me"]
    for n in (3, 40, 120):
        urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(n)]
        rows = []
        for i, url in enumerate(urls):
            to = r.choice([*ways, *r.choices(urls, k=6)])
            rows.append((i, url, r.choice([None, "<p>", f'<link rel="canonical" href="{to}">', f"<META HTTP-EQUIV=refresh content='0; URL={to}'>"] if i % 3 else ["<a href=/es/2>"])))
        folder = tmp_path / str(n)
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(folder / "pages.parquet"))
        frame = spark.read.parquet(str(folder / "pages.parquet"))
        got = sorted(tuple(x) for x in filter_urls(frame).select("page_id", "host", "path", "rule", "verdict").collect())
        db = duckdb.connect()
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        assert got == sorted(db.sql(ORACLE).select("page_id, host, path, rule, verdict").fetchall())
        group = {}
        for _, url, page in rows:
            ends = [resolved(url, "")]
            found = re.search(r"(?:href=|URL=)[\"']?([^\"'\s>]+)", page or "")
            if found and not page.startswith("<a") and not found[1].startswith(("mailto", "#")):
                ends.append(resolved(url, found[1]))
            merged = set().union(*(group.get(e, {e}) for e in ends))
            group |= {e: merged for e in merged}
        for page_id, _, _, rule, verdict in got:
            own = verdict_of(f"http://{urlsplit(urls[page_id]).netloc.lower()}{urlsplit(urls[page_id]).path}")
            all_ = {verdict_of(e) for e in group[resolved(urls[page_id], "")]}
            assert verdict == (own or ("block" if "block" in all_ and "allow" not in all_ else "allow")), (page_id, urls[page_id])


def test_names_that_clash(spark):
    rows = [(1, "a b c\nd e", "s", 5, "x", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, words int, bucket string, `order` int").withColumns({"lines": F.lit(1), "key": F.lit(2), "bad": F.lit(3), "id": F.lit(4)})
    for found in (quality_rules(frame), mix_sources(frame)):
        row = found.first().asDict()
        assert (row["words"], row["bucket"], row["order"], row["lines"], row["key"], row["bad"], row["id"]) == (5, "x", 7, 1, 2, 3, 4)
    pages = spark.createDataFrame([(1, "http://a.org/", "", 5, 6)], "page_id long, url string, html string, node int, alias int")
    assert (filter_urls(pages).first().node, filter_urls(pages).first().alias) == (5, 6)


def test_lines_of_repeated_ids(spark):
    """Each row keeps count of its own lines, also if another row has its doc_id."""
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{line}\nw{i} x{i}", "a") for i in range(9)] + [(3, " ".join(f"v{k}" for k in range(12)), "a")]
    got = sorted((r.doc_id, r.n_words, r.n_left) for r in quality_rules(spark.createDataFrame(rows, DOCS)).collect())
    assert (3, 12, 12) in got and (3, 14, 2) in got and (0, 14, 2) in got


def test_null_ids_share_no_bucket(spark):
    rows = [(None, f"w{i} x", "a") for i in range(2000)]
    mixed = mix_sources(spark.createDataFrame(rows, DOCS), weight=lambda number: F.lit(1), epochs=3)
    assert {r.copies for r in mixed.collect()} == {1}
    plan = mix_sources(spark.createDataFrame(rows + [(1, "y", "b")] * 500, DOCS)).collect()
    assert len(plan) == 2500 and all(r.taken == r.copies * r["size"] for r in plan)


@pytest.mark.parametrize(("rows", "weights"), [
    ([(1, "w " * 10, "a")] * 1000 + [(2, "w " * 10, "b")] * 1000, (2, 1)),  # a third of them once more
    ([(k % 3, "w " * 7, "a") for k in range(900)] + [(None, "w w", "b")] * 500 + [(9, None, "c")], (1, 3)),
])
def test_equal_rows_meet_the_target(spark, rows, weights):
    """Of equal rows only one fills what is left: each source is within a document of its target."""
    mixed = mix_sources(spark.createDataFrame(rows, DOCS).repartition(5), weight=lambda number: F.when(number == 1, weights[0]).when(number == 2, weights[1]).otherwise(1)).collect()
    assert len(mixed) == len(rows)
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1e-6
        assert len({r.copies for r in own}) <= 2


def test_equal_rows_like_sql(spark, tmp_path):
    import duckdb

    from tickloom.llm.mixing import ORACLE

    rows = [(1, "w " * 10, "a")] * 100 + [(2, "w " * 10, "b")] * 90 + [(k, "w " * (k % 7), None) for k in range(60)]
    frame = spark.createDataFrame(rows, DOCS)
    frame.coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(map(repr, db.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE})").fetchall()))
    got = sorted(repr(tuple(r)) for r in mix_sources(frame.repartition(3)).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert got == want


def test_many_sources_are_numbered_by_name(spark):
    from tickloom.llm.mixing import numbered, with_starts

    names = [f"s{k:05d}" for k in range(3000)] + [None]
    got = {r.source: r.number for r in numbered(spark.createDataFrame([(n,) for n in names], "source string").repartition(7)).collect()}
    assert got == {n: k for k, n in enumerate(names, 1)}
    r = random.Random(4)
    rows = [(key, f"{k:03x}", r.randrange(9)) for key in "ab" for k in range(0, 4096, 3)]
    found = {(x.key, x.bucket): x.start for x in with_starts(spark.createDataFrame(rows, "key string, bucket string, sum long"), 3).collect()}
    sums = {"a": 0, "b": 0}
    for key, bucket, n in rows:
        assert found[key, bucket] == sums[key]
        sums[key] += n
