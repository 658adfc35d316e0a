"""URL filters in DataFrame functions: host and path rules, and redirect equivalence.

A rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins (of two as long, an
allow). Pages that no rule fits get the decision of their aliases: URLs that redirect to each other (meta refresh) or name
each other canonical are edges, their connected components (without collecting any) are sets of aliases, and rules are
applied to all URLs of a component, crawled or not. A component with a blocked URL is blocked, unless one of its URLs is
explicitly allowed; a page with neither is allowed.

Links are resolved against the page's URL as browsers do (relative paths, dots, queries alone, entities for &). URLs are the
same alias if they agree but for scheme, fragment, an empty query, the case of the host, and dots in the path; an empty path
is /.

Null URLs, and those without ://, have an empty host and path; no rule fits them, and they are no aliases. Rows may repeat
a page_id or URL. Null html has no links. An empty table gives an empty result. Columns of pages that have the name of a
result column are replaced; all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh, settle
from tickloom.llm.components import components
from tickloom.llm.quality import LOWER, UPPER

#: (verdict, host, path) of the rules. Fixed values.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
RESULTS = ("host", "path", "rule", "verdict")
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>"""
REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def split_url(frame: DataFrame, url: str) -> DataFrame:
    """frame with host and path of a column."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return frame.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def longest(rules, host: Column, path: Column) -> Column:
    """The rule that wins, or null. The rules are a list that someone wrote, and so a part of the plan."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    found = None
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return out if found is None else found


def alias_key(url: Column) -> Column:
    """The URL in the form in which aliases are compared; null if it has no host."""
    rest = F.regexp_extract(url, r"^[^?#]*?://([^#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"^[^?]*(\?.+)$", 1)
    step = lambda done, part: F.when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))
    plain = F.concat(F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 30), F.lit(""), step), F.when(F.rlike(path, F.lit(r"/\.\.?$")), "/").otherwise(""))
    path = F.when(F.contains(path, F.lit("/.")), plain).otherwise(path)
    return F.when(host != "", F.concat(F.lit("http://"), host, F.when(path == "", "/").otherwise(path), query))


def links(pages: DataFrame) -> DataFrame:
    """(a, b): alias keys of each page and of what it names canonical or redirects to."""
    some = pages.select("url", "html").where("instr(url, '://') > 0 and (contains(lower(html), 'canonical') or contains(lower(html), 'refresh'))")
    found = F.array(F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract("html", REFRESH, 0), TARGET, 1))
    some = some.select("url", F.explode(found).alias("to")).withColumn("to", F.regexp_replace(F.regexp_replace("to", "&(amp|#38);", "&"), "#.*$", "")).where("to <> ''")
    scheme = F.regexp_extract("url", r"^([^:/?#]*)://", 1)
    site = F.regexp_extract("url", r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract("url", r"^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1), "([^/])/$", "$1")
    to = (
        F.when(F.rlike("to", F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.col("to"))
        .when(F.startswith("to", F.lit("//")), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.startswith("to", F.lit("/")), F.concat(site, F.col("to")))
        .when(F.startswith("to", F.lit("?")), F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.col("to")))
        .otherwise(F.concat(folder, F.lit("/"), F.col("to")))
    )
    return some.select(alias_key(F.col("url")).alias("a"), alias_key(to).alias("b")).where("a is not null and b is not null and a <> b")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict (allow or block)."""
    pages = pages.drop(*RESULTS)
    alias, node, blocked, won = fresh(pages.select("*", *(F.lit(0).alias(n) for n in RESULTS)), "alias", "node", "blocked", "won")
    aliases = components(links(pages))
    judged = split_url(aliases, "node").withColumn("won", longest(rules, F.col("host"), F.col("path")))
    said = lambda verdict: F.max(F.coalesce(F.col("won.verdict") == verdict, F.lit(False)))
    decided = judged.groupBy("root").agg(said("allow").alias("allowed"), said("block").alias("blocked")).where("blocked and not allowed")
    decided = settle(aliases.join(decided, "root").select(F.col("node").alias(node), F.lit(True).alias(blocked)).distinct())

    out = split_url(pages.withColumn(alias, alias_key(F.col("url"))), "url").withColumn(won, longest(rules, F.col("host"), F.col("path")))
    out = out.join(decided, F.col(alias) == F.col(node), "left")
    verdict = F.coalesce(F.col(f"{won}.verdict"), F.when(F.col(blocked), "block"), F.lit("allow"))
    return out.select(*pages.columns, "host", "path", F.col(f"{won}.rule").alias("rule"), verdict.alias("verdict"))


#: The same in DuckDB, aliases included: all that each link's ends reach, by recursion.
ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), s AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(verdict, h, start)
), raw AS (
  SELECT url, regexp_replace(regexp_replace(unnest([
           regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical["'']?[^>]*>'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
           regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh["'']?[^>]*>'), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]), '&(amp|#38);', '&', 'g'), '#.*$', '') AS t
  FROM pages WHERE instr(url, '://') > 0
), linked AS (
  SELECT url AS a, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]*)://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) || t
    WHEN starts_with(t, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || t
    ELSE regexp_replace(regexp_extract(url, '^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)', 1), '([^/])/$', '\1') || '/' || t END AS b
  FROM raw WHERE t <> ''
), u AS (
  SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT b FROM linked
), cut AS (
  SELECT url, regexp_extract(url, '^[^?#]*?://([^#]*)', 1) AS rest FROM u
), parts AS (
  SELECT url, translate(regexp_extract(rest, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(rest, '^[^?]*(\?.+)$', 1) AS query FROM cut
), keys AS (
  SELECT url, host, CASE WHEN path = '' THEN '/' WHEN contains(path, '/.') THEN
           list_reduce(string_split(path, '/'), lambda d, x: CASE x WHEN '..' THEN regexp_replace(d, '/[^/]*$', '') WHEN '.' THEN d ELSE d || '/' || x END)
           || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END ELSE path END AS path, query
  FROM parts WHERE host <> ''
), named AS (
  SELECT url, host, path, 'http://' || host || path || query AS node FROM keys
), edges AS (
  SELECT a.node AS a, b.node AS b FROM linked l JOIN named a ON l.a = a.url JOIN named b ON l.b = b.url
), ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT a, a AS b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), judged AS (
  SELECT n.node, max_by(r.verdict, length(h || start)) AS verdict FROM (SELECT DISTINCT node, host, path FROM named) n
  JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY n.node
), blocked AS (
  SELECT reach.a AS node FROM reach JOIN judged ON reach.b = judged.node GROUP BY reach.a HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
), won AS (
  SELECT page_id, url, host, path, max_by({'verdict': r.verdict, 'rule': h || start}, length(h || start)) FILTER (h IS NOT NULL) AS w
  FROM s LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start)
  GROUP BY page_id, url, host, path
)
SELECT page_id, w.host AS host, w.path AS path, w.w.rule AS rule, coalesce(w.w.verdict, CASE WHEN b.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM won w LEFT JOIN named n ON w.url = n.url LEFT JOIN blocked b ON n.node = b.node
"""
