"""URL verdicts that redirects and canonical links carry from page to page; built-in functions only.

A rule is a host and a path; it fits the host and its subdomains where the
url's path starts with the rule's, and the longest fitting rule decides. Urls
joined by redirect or canonical-link edges are aliases: connected components
over these edges give a page without a rule the block of an alias, unless any
alias is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import connected_components, durable

#: Rules are broadcast up to so many rows; beyond that they are joined by a shuffle.
SMALL_RULES = 100_000
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path; both empty for a null url and one without ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))
    return df.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def decide(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, ruled of the distinct places that a rule fits. rules: rule (like `net/`), verdict.

    Of rules of one length the first in order of text decides; of one rule given twice, allow.
    """
    known = rules.where("rule is not null").groupBy("rule").agg(F.min("verdict").alias("ruled"))
    at = F.instr("rule", "/")
    known = known.select("rule", "ruled", F.when(at > 0, F.expr("left(rule, instr(rule, '/') - 1)")).otherwise(F.col("rule")).alias("suffix"), F.when(at > 0, F.expr("substr(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("prefix"))
    if known.limit(SMALL_RULES + 1).count() <= SMALL_RULES:
        known = F.broadcast(known)
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = places.select("host", "path").distinct().select("host", "path", F.explode(ends).alias("suffix")).join(known, "suffix").where(F.startswith("path", "prefix"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "ruled")).alias("best"))
    return best.select("host", "path", "best.rule", "best.ruled")


def page_edges(pages: DataFrame) -> DataFrame:
    """u, v: each page's url and what its canonical link or refresh names. Relative links are resolved on the host; others without a scheme are left out."""
    def target(tag: str, value: str) -> F.Column:
        return F.regexp_extract(F.regexp_extract("html", tag, 0), value, 1)

    canonical = target(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = target(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    links = pages.where("url is not null and html is not null").select("url", F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''")
    site = F.regexp_extract("url", r"(?s)^(.*?:)//[^/?#]*", 0)
    scheme = F.regexp_extract("url", r"(?s)^(.*?:)//", 1)
    full = F.when(F.startswith("to", F.lit("//")), F.concat(scheme, "to")).when(F.startswith("to", F.lit("/")), F.concat(site, "to")).when(F.contains("to", F.lit("://")), F.col("to"))
    return links.select(F.col("url").alias("u"), full.alias("v")).where("v is not null")


def node(url: str) -> F.Column:
    """A url without its fragment, its scheme and host in lower case: what a redirect can name."""
    head = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    return F.concat(F.translate(head, UPPER, LOWER), F.regexp_extract(F.expr(f"substr({url}, length(regexp_extract({url}, '(?s)^.*?://[^/?#]*', 0)) + 1)"), r"(?s)^[^#]*", 0))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row. redirects: further edges u, v between urls.

    A rule that fits decides. Else an allow rule of any alias allows, else a
    block rule of any alias blocks, else the page is allowed; so are null urls
    and urls without ://. Repeated rows stay; extra columns are ignored; no
    rows give no rows.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("u", "v"))
    edges = durable(edges.where("u is not null and v is not null").select(node("u").alias("u"), node("v").alias("v")).distinct())
    placed = parts(pages.select("page_id", "url")).withColumn("node", node("url"))
    ends = parts(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node")
    ruled = durable(decide(placed.select("host", "path").union(ends.select("host", "path")), rules))
    comps = durable(connected_components(edges))
    marks = comps.join(ends, "node").join(ruled, ["host", "path"])
    marks = marks.groupBy("root").agg(F.min("ruled").alias("carried"))  # allow comes before block
    carried = comps.join(marks, "root").select("node", "carried")
    out = placed.join(ruled, ["host", "path"], "left").join(carried, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "carried", F.lit("allow")).alias("verdict"))


def op2_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages, spark.createDataFrame(RULES, "rule string, verdict string"))


OP2_SQL = r"""
WITH RECURSIVE rules(rule, ruled) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
placed AS (SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
tags AS (SELECT url, unnest([
  regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
  regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is')]) AS t FROM pages),
links AS (SELECT url AS a, CASE WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || t WHEN starts_with(t, '/') THEN regexp_extract(url, '^.*?://[^/?#]*', 0, 's') || t WHEN contains(t, '://') THEN t END AS b
  FROM tags WHERE t <> ''),
edges AS (SELECT DISTINCT translate(regexp_extract(a, '^.*?://[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(a, length(regexp_extract(a, '^.*?://[^/?#]*', 0, 's')) + 1), '^[^#]*', 0, 's') AS a, translate(regexp_extract(b, '^.*?://[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(b, length(regexp_extract(b, '^.*?://[^/?#]*', 0, 's')) + 1), '^[^#]*', 0, 's') AS b FROM links WHERE b IS NOT NULL),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
named AS (SELECT DISTINCT b AS url, coalesce(translate(regexp_extract(b, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(b, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM reach),
fits AS (SELECT p.host, p.path, r.rule, r.ruled, row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.rule) DESC, r.rule) AS k
  FROM (SELECT host, path FROM placed UNION SELECT host, path FROM named) p
  JOIN rules r ON ('.' || p.host) LIKE ('%.' || split_part(r.rule, '/', 1)) AND starts_with(p.path, substr(r.rule, instr(r.rule, '/')))),
best AS (SELECT host, path, rule, ruled FROM fits WHERE k = 1),
carried AS (SELECT r.a AS url, min(b.ruled) AS verdict FROM reach r JOIN named n ON n.url = r.b JOIN best b ON b.host = n.host AND b.path = n.path GROUP BY r.a)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.ruled, c.verdict, 'allow') AS verdict
FROM placed p LEFT JOIN best b ON b.host = p.host AND b.path = p.path LEFT JOIN carried c ON c.url = translate(regexp_extract(p.url, '^.*?://[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(p.url, length(regexp_extract(p.url, '^.*?://[^/?#]*', 0, 's')) + 1), '^[^#]*', 0, 's')
"""
