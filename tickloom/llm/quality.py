"""Quality rules in DataFrame functions: measures of each document, and the frequency of its lines across documents.

Lines are normalised (A-Z lowered, white space collapsed) and hashed. A line that stands in more than `share` of a host's
documents (its source), and in more than `least`, is boilerplate there and is taken out; a document of which less than
`remain` of the words are left is depleted, and rejected. Counting is a two-step aggregation on (host, line, document) and
(host, line), so a hot host or line is pre-aggregated where it is read; no text is shuffled.

Null texts have no words or lines. A null host is a host of its own. Rows that repeat a doc_id count once for a line; each
loses those of its own lines that are boilerplate for any of them; rows with a null doc_id don't count and lose no lines. An empty table gives an empty result.
Columns of docs that have the name of a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, settle

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SPLIT = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept_text", "kept")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.btrim(F.translate(line, UPPER, LOWER), F.lit(BLANKS)), SPLIT, " ")


def measures(docs: DataFrame, width: int = 5, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """docs with the base measures, under the first six of names."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed = names[:6]
    given = docs.columns
    words, lines, grams, ordered, near, places = fresh(docs.select("*", *(F.lit(0).alias(n) for n in names)), "words", "lines", "grams", "ordered", "near", "places")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn(words, F.transform(words_of(text), lambda x: F.xxhash64(x)))
    docs = docs.withColumns({lines: F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != ""), n_words: F.size(words).cast("long")})
    w = F.col(words)
    some = F.when(F.col(n_words) >= width, F.sequence(F.lit(0), (F.col(n_words) - width).cast("int"))).otherwise(F.array().cast("array<int>"))
    docs = docs.withColumns({
        grams: F.transform(some, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width)))),
        word_chars: F.length(F.translate(text, BLANKS, "")).cast("long"),
        n_symbols: (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        n_dup_lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    # places of windows that occur twice or more; each step is a column, since a lambda would work it out for each element
    twice = F.size(F.array_distinct(grams)) < F.size(grams)
    docs = docs.withColumn(ordered, F.when(twice, F.array_sort(F.transform(grams, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    around = lambda i, x: F.get(ordered, i - 1)["x"].eqNullSafe(x["x"]) | F.get(ordered, i + 1)["x"].eqNullSafe(x["x"])
    docs = docs.withColumn(near, F.transform(ordered, lambda x, i: F.when(around(i, x), x["i"])))
    docs = docs.withColumn(places, F.array_sort(F.array_compact(near)))
    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    total = F.aggregate(places, start, lambda s, p: F.struct((s["n"] + F.least(F.lit(width), p - s["last"])).alias("n"), p.alias("last")))
    docs = docs.withColumn(n_repeat_words, F.coalesce(total["n"], F.lit(0)).cast("long"))
    failed = (F.col(n_words) < 10) | (100 * F.col(n_repeat_words) > 20 * F.col(n_words))
    return docs.select(*given, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed.alias(base_failed))


def boilerplate(docs: DataFrame, share: float, least: int) -> DataFrame:
    """(id, bad): the hashes of those lines of each document that are too frequent in its host."""
    host = F.coalesce(F.col("source"), F.lit("\x00")).alias("host")
    rows = docs.where("doc_id is not null").select("doc_id", host, F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line"))
    rows = rows.select("doc_id", "host", normalised(F.col("line")).alias("line")).where("line <> ''")
    lines = settle(rows.select("doc_id", "host", F.xxhash64("line").alias("h")))
    count = lines.groupBy("host", "h", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("k")).where(F.col("k") > least)
    size = docs.where("doc_id is not null").select("doc_id", host).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    frequent = count.join(size, "host").where(F.col("k") > F.lit(share) * F.col("docs")).select("host", "h")
    found = lines.join(frequent, ["host", "h"])
    return found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("h").alias("bad"))


def quality_rules(docs: DataFrame, share: float = 0.03, least: int = 5, remain: float = 0.3, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """docs with the base measures, base_failed, n_left (words without boilerplate), kept_text (text without it) and kept, under these or other names."""
    docs = docs.drop(*names)
    n_words, base_failed, (n_left, kept_text, kept) = names[0], names[5], names[6:]
    id_, bad, counts = fresh(docs.select("*", *(F.lit(0).alias(n) for n in names)), "id", "bad", "counts")
    found = boilerplate(docs, share, least).select(F.col("id").alias(id_), F.col("bad").alias(bad))
    measured = measures(docs, names=names)
    # hashes and words of the lines go through the join, so that texts need not where nobody asks for kept_text
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), normalised), lambda x: x != "")
    sized = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("n")))
    joined = measured.withColumn(counts, sized).join(found, measured["doc_id"] == found[id_], "left")
    stays = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col(bad), F.xxhash64(normalised(x))))
    joined = joined.withColumn(kept_text, F.when(F.col(bad).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")))
    gone = F.aggregate(F.filter(counts, lambda x: F.array_contains(F.col(bad), x["h"])), F.lit(0), lambda total, x: total + x["n"])
    joined = joined.withColumn(n_left, F.col(n_words) - F.coalesce(gone, F.lit(0)).cast("long"))
    depleted = F.col(n_left) < remain * F.col(n_words)
    return joined.select(*measured.columns, n_left, kept_text, (~F.col(base_failed) & ~depleted).alias(kept))


#: The same in DuckDB, for doc_id, the measures, n_left and kept.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), tokens AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w
), grams AS (
  SELECT doc_id, i, [w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d] AS g, lead(i, 4) OVER d AS last
  FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, lag(i, 1, -5) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE last IS NOT NULL) WHERE n > 1
), repeats AS (
  SELECT doc_id, sum(least(5, i - before)) AS n FROM twice GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM w
), named AS (
  SELECT doc_id, host, line, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM lines
), known AS (
  SELECT doc_id, host, line, array_to_string(words, ' ') AS h, len(words) AS n FROM named WHERE len(words) > 0
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM known GROUP BY doc_id
), bad AS (
  SELECT k.host, k.h FROM (SELECT host, h, count(DISTINCT doc_id) AS n FROM known GROUP BY host, h) k
  JOIN (SELECT host, count(DISTINCT doc_id) AS docs FROM w GROUP BY host) s ON k.host = s.host
  WHERE k.n > 5 AND k.n > CAST(0.03 AS DOUBLE) * s.docs
), gone AS (
  SELECT k.doc_id, sum(k.n) AS n FROM known k JOIN bad b ON k.host = b.host AND k.h = b.h GROUP BY k.doc_id
), all_measures AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(words) - coalesce(g.n, 0) AS BIGINT) AS n_left
  FROM w LEFT JOIN repeats r ON w.doc_id = r.doc_id LEFT JOIN dups d ON w.doc_id = d.doc_id LEFT JOIN gone g ON w.doc_id = g.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_left < CAST(0.3 AS DOUBLE) * n_words) AS kept, n_left
FROM all_measures
"""
