"""URL filter: block and allow rules by host and path, and redirect equivalence.

Each url's host is matched with all its parent domains at once against a table of rules; the longest rule that fits wins,
and an explicit rule settles the url. Urls without a rule take the decision of their aliases: pages that redirect to each
other or name each other as canonical form connected components, found by a distributed algorithm, and a component with
a blocked member blocks its other members, unless a rule allows one explicitly.

The rule table is broadcast while it has at most BROADCAST_RULES rows and is joined by shuffle beyond that.

Defined cases: a null url or one without "://" has an empty host and path, no rule and the verdict allow; repeated rows
are judged once each; links to pages outside the table count as edges, and such pages' own rules count too; links of
null or unparsable urls are ignored; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import materialize
from terrane.llm.components import connected_components

#: (verdict, host, path) rules of the production table.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BROADCAST_RULES = 100_000

_LINK = r"(?i)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_REFRESH = r"(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?\s*[\d.]*\s*[;,]\s*url\s*=\s*['\"]?([^\"'>]+)"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and rule_verdict to the distinct rows of (host, path); null where no rule fits.

    A host is joined by each of its parent domains, and the path by prefixes of those lengths that the domain's rules
    have, so both joins are by equality. Of rules of equal length, the one of the longer host wins, then allow.
    """
    clean = rules.where("rule_host IS NOT NULL AND verdict IS NOT NULL").withColumn("rule_path", F.coalesce("rule_path", F.lit("")))
    clean = clean.groupBy(_ascii_lower(F.col("rule_host")).alias("rule_host"), "rule_path").agg(F.min("verdict").alias("rule_verdict"))
    lengths = clean.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    if clean.count() <= BROADCAST_RULES:
        clean, lengths = F.broadcast(clean), F.broadcast(lengths)
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path").where("host <> ''").distinct()
    near = asked.withColumn("rule_host", F.explode(parents)).join(lengths, "rule_host").withColumn("n", F.explode("lengths"))
    near = near.where(F.length("path") >= F.col("n")).withColumn("rule_path", F.substring("path", F.lit(1), F.col("n")))
    hit = near.join(clean, ["rule_host", "rule_path"])
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "allow").alias("ok"), F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")
    best = hit.groupBy("host", "path").agg(F.max(order).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def edges_in(pages: DataFrame) -> DataFrame:
    """(a, b): urls of pages and of what they redirect to or name as canonical."""
    link = F.concat_ws("", *(F.regexp_extract("html", _LINK, i) for i in (1, 2, 3)))
    refresh = F.regexp_extract("html", _REFRESH, 1)
    target = F.explode(F.array(F.replace(F.trim(link), F.lit("&amp;"), F.lit("&")), F.replace(F.trim(refresh), F.lit("&amp;"), F.lit("&"))))
    found = pages.where("url IS NOT NULL AND html IS NOT NULL").where(F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b")).select("url", target.alias("to")).where("to <> ''")
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    folder = F.regexp_extract(path_of(F.col("url")), r"(?s)^(.*/)", 1)
    whole = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(scheme, F.lit("://"), host_of(F.col("url")), F.col("to")))
        .otherwise(F.concat(scheme, F.lit("://"), host_of(F.col("url")), F.when(folder == "", "/").otherwise(folder), F.col("to")))
    )
    return found.select(F.col("url").alias("a"), whole.alias("b"))


def _key(url: Column) -> Column:
    """What makes two urls the same page: host, path and query; scheme and fragment don't matter."""
    return F.concat(host_of(url), path_of(url), _query_of(url))


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, by (rule, alias or default). ``edges`` holds more (a, b) pairs of urls,
    such as HTTP redirects."""
    url = F.col("url")
    parsed = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    links = edges_in(pages)
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    links = materialize(links.where(F.col("a").contains("://") & F.col("b").contains("://")).distinct(), "urls-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("url"))
    nodes = ends.select(_key(url).alias("key"), host_of(url).alias("host"), path_of(url).alias("path")).dropDuplicates(["key"])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "urls-nodes")
    matched = materialize(match_rules(parsed.select("host", "path").unionByName(nodes.select("host", "path")), rules), "urls-rules")
    a, b = (nodes.select(F.col("key").alias(f"k{x}"), F.col("node").alias(x)) for x in "ab")
    graph = links.select(_key(F.col("a")).alias("ka"), _key(F.col("b")).alias("kb")).join(a, "ka").join(b, "kb").select("a", "b")
    components = connected_components(graph, name="urls-components")
    placed = nodes.join(matched, ["host", "path"], "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed.select("key", "component", "rule_verdict"), "urls-placed")
    blocked = materialize(placed.where("rule_verdict = 'block'").select("component").distinct(), "urls-blocked")
    aliases = materialize(placed.join(blocked, "component", "left_semi").select("key", F.lit("block").alias("alias_verdict")), "urls-aliases")
    out = parsed.join(matched, ["host", "path"], "left").withColumn("key", _key(url)).join(aliases, "key", "left")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit(default)).alias("verdict"), by.alias("decided_by"))


_SQL_HOST = "translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_PATH = "coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_SQL_KEY = f"{_SQL_HOST} || {_SQL_PATH} || coalesce(regexp_extract({{0}}, '(?s)^.*?://[^?#]*(\\?[^#]*)?', 1), '')"
_SQL_RULE = "FROM {0} JOIN r ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p)"

JUDGE_SQL = f"""
WITH RECURSIVE r(v, h, p) AS (VALUES {", ".join(str(x) for x in RULES)}),
u AS (SELECT page_id, url, row_number() OVER () AS rk, {_SQL_HOST.format("url")} AS host, {_SQL_PATH.format("url")} AS path, {_SQL_KEY.format("url")} AS key FROM pages),
t AS (SELECT url, unnest([
        regexp_extract(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\\brel\\s*=\\s*["'']?canonical\\b'))[1], '(?i)\\bhref\\s*=\\s*["'']?([^"''>]+)', 1),
        regexp_extract(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b'))[1], '(?i)[;,]\\s*url\\s*=\\s*["'']?([^"''>]+)', 1)
      ]) AS raw FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
w AS (SELECT url, replace(trim(raw), '&amp;', '&') AS x, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme FROM t WHERE coalesce(trim(raw), '') <> ''),
l AS (SELECT url AS a, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN x WHEN starts_with(x, '//') THEN scheme || ':' || x
        WHEN starts_with(x, '/') THEN scheme || '://' || {_SQL_HOST.format("url")} || x
        ELSE scheme || '://' || {_SQL_HOST.format("url")} || CASE regexp_extract({_SQL_PATH.format("url")}, '(?s)^(.*/)', 1) WHEN '' THEN '/' ELSE regexp_extract({_SQL_PATH.format("url")}, '(?s)^(.*/)', 1) END || x END AS b FROM w),
e AS (SELECT {_SQL_KEY.format("a")} AS a, {_SQL_KEY.format("b")} AS b FROM l WHERE contains(a, '://') AND contains(b, '://')),
n AS (SELECT DISTINCT {_SQL_KEY.format("x")} AS key, {_SQL_HOST.format("x")} AS host, {_SQL_PATH.format("x")} AS path FROM (SELECT a AS x FROM l UNION ALL SELECT b FROM l)),
nm AS (SELECT key, arg_max(v, length(h) + length(p)) AS v {_SQL_RULE.format("n")} GROUP BY key),
al(key) AS (SELECT key FROM nm WHERE v = 'block' UNION SELECT CASE WHEN e.a = al.key THEN e.b ELSE e.a END FROM al JOIN e ON e.a = al.key OR e.b = al.key),
m AS (SELECT rk, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v {_SQL_RULE.format("u")} GROUP BY rk)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN al.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NOT NULL THEN 'rule' WHEN al.key IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM u LEFT JOIN m USING (rk) LEFT JOIN al ON al.key = u.key
"""
