"""URL verdicts by rules, passed on to aliases through redirect and canonical-link edges.

A rule decides for a URL it fits. Other URLs share the fate of their aliases: all URLs that redirects
and canonical links connect form a component, found by distributed connected components; a component
with a blocked member and no allowed one is blocked. An allow always comes first: a URL's own rule
over its component, and within a component allow over block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.shared import components, hot_join, lower_ascii, saved

#: (verdict, host/path prefix). Fixed values.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: So many rules may be broadcast; more take a shuffle join.
MOST_BROADCAST = 1_000_000
#: Query parameters that don't change what a URL shows.
TRACKING = r"(?i)(?<=[?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&#]*&?"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL without scheme, fragment, tracking parameters and a last slash; null without ://."""
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), TRACKING, "")
    return F.when(url.contains("://"), F.concat(host_of(url), F.regexp_replace(rest, r"[/?&]+$", "")))


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, ...) with host, path, rule and own: the verdict of the longest rule that fits, else null.

    rules are (verdict, rule); a rule host/path fits its host and all subdomains, where the URL's path
    starts with the rule's path. Of equal rules with both verdicts, allow counts.
    """
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rules = rules.groupBy("rule").agg(F.min("verdict").alias("own")).filter(F.col("rule").contains("/"))
    rules = rules.select("rule", "own", F.regexp_extract("rule", "^[^/]*", 0).alias("rule_host"), F.regexp_extract("rule", "(?s)/.*$", 0).alias("rule_path"))
    rules = F.broadcast(rules) if rules.count() <= MOST_BROADCAST else rules
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host", "path").distinct()
    fits = hosts.select("host", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "own"), F.struct(F.length("rule"), "rule")).alias("best")).select("host", "path", "best.rule", "best.own")
    return urls.join(best, ["host", "path"], "left")


def resolved(link: Column, base: Column) -> Column:
    """The link of a page at base as an absolute URL, dot segments taken out; null for other schemes' links and where base has no ://."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "(?s)^.*/", 0))
    target, rest = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)[?#].*$", 0)
    whole = F.when(target.startswith("/"), target).when(target == "", path).otherwise(F.concat(folder, target))

    def step(done: Column, x: Column) -> Column:
        return F.when(x == ".", done).when(x == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(x)))

    plain = F.array_join(F.aggregate(F.split(whole, "/"), F.expr("cast(array() as array<string>)"), step), "/")
    path_only = F.concat(root, F.when(whole.rlike(r"(^|/)\.\.?(/|$)"), plain).otherwise(whole), rest)
    absolute = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
    return F.when(base.contains("://"), absolute.when(link.startswith("//"), F.concat(F.regexp_extract(base, "(?s)^.*?:", 0), link)).otherwise(path_only))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's URL and each one that a canonical link or a refresh of it names, relative ones resolved."""
    link = F.regexp_extract_all("html", F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""), 1)
    refresh = F.regexp_extract_all("html", F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*([^"'\s>]+)"""), 1)
    found = pages.select("url", F.explode(F.concat(link, refresh)).alias("to"))
    return found.select(F.col("url").alias("a"), resolved(F.col("to"), F.col("url")).alias("b")).dropna()


def judge(pages: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict.

    edges (a, b) are URLs that redirect or point to one another; URLs that agree without scheme,
    fragment and tracking parameters are the same node. The verdict is the rule's; without a rule,
    block if the page's component has a blocked URL and no allowed one, else allow. Null URLs, and
    those without ://, have an empty host and path, no rule and no alias, and are allowed. Repeated
    rows are judged each; other columns are ignored; an empty table gives an empty result.
    """
    named = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = saved(judged(named, rules).withColumn("node", F.coalesce(canonical(F.col("url")), F.lit(""))), "pages")
    links = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).filter("contains(x, '://') AND contains(y, '://')")
    links = saved(links.select("x", "y", canonical(F.col("x")).alias("a"), canonical(F.col("y")).alias("b")), "alias-edges")
    groups = components(links.select("a", "b").filter("a <> b"), "aliases") if links.take(1) else None
    ends = judged(links.select(F.explode(F.array("x", "y")).alias("url")).distinct(), rules).withColumn("node", canonical(F.col("url")))
    votes = rows.select("node", "own").unionByName(ends.select("node", "own"))
    nodes = votes.groupBy("node").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked"))
    nodes = nodes.join(rows.groupBy("node").agg(F.count("*").alias("weight")), "node", "left")
    if groups is not None:
        nodes = nodes.join(groups, "node", "left")
        nodes = nodes.withColumn("component", F.coalesce("component", "node"))
        fate = nodes.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
        nodes = nodes.select("node", "weight", "component").join(fate, "component")
    nodes = nodes.select("node", F.coalesce("weight", F.lit(0)).alias("weight"), F.when((F.coalesce("blocked", F.lit(0)) > 0) & (F.coalesce("allowed", F.lit(0)) == 0) & (F.col("node") != ""), "block").otherwise("allow").alias("fate"))
    nodes = saved(nodes.filter("weight > 0"), "nodes")
    return hot_join(rows, nodes, "node", "weight", rows.count()).select("page_id", "host", "path", "rule", F.coalesce("own", "fate").alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages.select("page_id", "url"), alias_edges(pages), spark.createDataFrame(RULES, "verdict string, rule string"))


_RULES_SQL = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in RULES)

#: Without edges, which the test pages don't hold: nodes are URLs that agree but for scheme, fragment and tracking.
ORACLE = rf"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages
),
rules AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, rule[len(split_part(rule, '/', 1)) + 1:] AS t FROM (VALUES {_RULES_SQL}) x(verdict, rule)),
m AS (SELECT r, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS own FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t) GROUP BY r),
n AS (
  SELECT p.*, rule, own, host || regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&#]*&?', '\1', 'gi'), '[/?&]+$', '') AS node
  FROM p LEFT JOIN m USING (r)
)
SELECT page_id, host, path, rule,
  coalesce(own, CASE WHEN host <> '' AND bool_or(own = 'block') OVER (PARTITION BY node) AND NOT coalesce(bool_or(own = 'allow') OVER (PARTITION BY node), FALSE) THEN 'block' ELSE 'allow' END) AS verdict
FROM n
"""
