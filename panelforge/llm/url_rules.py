"""URL filter with redirect equivalence.

A page's url is judged by the longest allow or block rule that fits its host and path. A url that no rule fits
takes the decision of its aliases: the urls of its connected component over edges from every url to its canonical form (scheme,
fragment, tracking parameters, ``www.`` and ``m.``, a last ``/``, ``.html`` or ``index.html`` left out) and over redirect and canonical-link
edges, which are read from the pages (``<link rel=canonical>``, refresh in ``<meta>``; a relative target is taken from the page's
url) or given as a table. Rules judge every url of a component, whether it is a page or not; one explicit allow among them outweighs
any block, and a component without a ruled url is allowed. Of rules of equal length that fit a url the last of the list wins.

A null url and one without ``://`` have an empty host and path, no aliases and the verdict allow. Repeated pages are
judged alike; other columns of the table are ignored. Very long pages are searched whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import settled
from panelforge.llm.components import components

#: (verdict, host, path) of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL_LINK = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical(url: Column) -> Column:
    """The form that a url's aliases share; null without a host."""
    name = F.regexp_replace(host(url), r"^(www|m)\.", "")
    way = F.regexp_replace(path(url), r"(/index\.html?|\.html?|/)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host(url) != "", F.concat(name, way, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def without_dots(way: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` segments."""
    parts = F.slice(F.split(way, "/"), F.lit(2), F.size(F.split(way, "/")))
    step = lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.when(way.rlike(r"(?s)/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise("")
    return F.when(way.rlike(r"(?s)/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(way)


def resolved(target: Column, base: Column) -> Column:
    """A link's target as an absolute url, seen from the url ``base``; null for other schemes without ``//`` and where base has no host."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    way = path(base)
    bare, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
    folder = F.when(way == "", F.lit("/")).otherwise(F.regexp_extract(way, r"(?s)^(.*/)", 1))
    inside = (
        F.when(target.startswith("/"), F.concat(site, without_dots(bare), rest))
        .when(bare != "", F.concat(site, without_dots(F.concat(folder, bare)), rest))
        .when(target.startswith("?"), F.concat(site, way, rest))
        .otherwise(F.concat(site, way, query))
    )
    return (
        F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(host(base) == "", F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(~target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), inside)
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct (from_url, to_url) of pages and the urls that they redirect or point to as canonical."""
    targets = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL_LINK), F.lit(1)), F.regexp_extract_all("html", F.lit(REFRESH), F.lit(1)))
    found = pages.select("url", F.explode(targets).alias("target"))
    return found.select(F.col("url").alias("from_url"), resolved(F.col("target"), F.col("url")).alias("to_url")).where("to_url is not null").distinct()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; redirects: more edges (from_url, to_url), absolute or relative to from_url."""
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("from_url", resolved(F.col("to_url"), F.col("from_url")).alias("to_url"))).distinct()
    links = settled(links, "links")
    ends = pages.select("url").union(links.select("from_url")).union(links.select("to_url")).distinct()
    url = F.col("url")
    judged = ends.select("url", canonical(url).alias("form"), rule(host(url), path(url), rules)["verdict"].alias("own")).where("form is not null")
    # A form has no ``://``, so it is no url; marked, it can't be taken for one.
    forms = judged.select(url.alias("a"), F.concat(F.lit("form "), "form").alias("b"))
    of = components(forms.union(links.select(F.col("from_url").alias("a"), F.col("to_url").alias("b"))))
    judged = judged.join(of.withColumnRenamed("node", "url"), "url")
    flag = lambda v: F.coalesce(F.max(F.col("own") == v), F.lit(False))
    # Only a component that blocks matters: whatever else no rule fits is allowed.
    decided = judged.groupBy("component").agg(flag("allow").alias("allowed"), flag("block").alias("blocked")).where("blocked and not allowed")
    blocked = settled(judged.where("own is null").join(decided, "component").select("url", F.lit("block").alias("spread")), "blocked")
    own = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path")).withColumn("ruled", rule(F.col("host"), F.col("path"), rules))
    return own.join(blocked, "url", "left").select("page_id", "host", "path", "ruled.rule", F.coalesce("ruled.verdict", "spread", F.lit("allow")).alias("verdict"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    form = lambda url: f"""CASE WHEN regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1) <> '' THEN
        regexp_replace(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '^(www|m)\\.', '')
        || regexp_replace(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(/index\\.html?|\\.html?|/)$', '')
        || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract({url}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'),
             lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&'), ''), '') END"""  # noqa: E731
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v}|{h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"""
WITH RECURSIVE own AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {form("url")} AS alias,
    list_concat(
      list_transform(list_filter(regexp_extract_all(html, '(?i)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\brel\\s*=\\s*["'']?canonical\\b')), lambda t: regexp_extract(t, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
      list_transform(list_filter(regexp_extract_all(html, '(?i)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')), lambda t: regexp_extract(t, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1))) AS targets
  FROM pages),
judged AS (SELECT *, CASE {fits} END AS fit FROM own),
directed AS (SELECT alias AS a, {form("target")} AS b FROM (SELECT alias, unnest(targets) AS target FROM own)),
edges AS (SELECT a, b FROM directed WHERE a <> b UNION SELECT b, a FROM directed WHERE a <> b),
reach(a, b) AS (SELECT alias, alias FROM judged WHERE alias IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
flags AS (SELECT r.a AS alias, bool_or(coalesce(starts_with(j.fit, 'allow'), false)) AS allowed, bool_or(coalesce(starts_with(j.fit, 'block'), false)) AS blocked
  FROM reach r JOIN (SELECT DISTINCT alias, fit FROM judged) j ON r.b = j.alias GROUP BY r.a)
SELECT j.page_id, j.host, j.path, split_part(j.fit, '|', 2) AS rule,
  CASE WHEN j.fit IS NOT NULL THEN split_part(j.fit, '|', 1) WHEN f.blocked AND NOT f.allowed THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN flags f ON j.alias = f.alias
"""


ORACLE_SQL = _sql()
