"""URL filters with redirect equivalence.

Rules name a host, with all its subdomains, and a prefix of the path; the longest fitting rule judges a
url.  Pages whose canonical link or refresh redirect names another url are aliases of it: connected components
over those edges carry a block to the members that no rule judges, unless a member is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, documents

#: (action, host, path), as the contract gives them.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*['"]?([^"'>\s]*)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null without one.  The list of rules becomes part of the plan,
    so it must be short (``judged`` takes a table); of rules equally long an allowing one counts.
    """
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def judged(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``rows`` (host, path and more) with the longest fitting ``rule`` and its ``action``.

    Rules of a table (action, host, path) of any length meet the urls by the host and each of its parent domains; each different host and path
    is judged once.  Rows of the table with a null are no rules.
    """
    if not isinstance(rules, DataFrame):
        rule, action = judge(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": rule, "action": action})
    labels = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = rows.select("host", "path").distinct()
    r = rules.select(F.col("action").alias("_qw_act"), F.col("host").alias("_qw_host"), F.col("path").alias("_qw_path")).dropna()
    met = urls.select("host", "path", F.explode(above).alias("_qw_host")).join(r, "_qw_host").where(F.col("path").startswith(F.col("_qw_path")))
    name = F.concat("_qw_host", "_qw_path")
    best = F.max(F.struct(F.length(name), F.col("_qw_act") == "allow", name.alias("rule"), F.col("_qw_act").alias("action"))).alias("best")
    found = met.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.action")
    return rows.join(found, ["host", "path"], "left")


def node_of(url: Column) -> Column:
    """The url that a request asks for: scheme and host in lower case, no fragment, at least the path ``/``; null
    without ``://``."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` of every canonical link and refresh redirect; relative targets are resolved."""
    url, html = F.col(url_col), F.col(html_col)
    tags = F.regexp_extract_all(html, F.lit(_TAG), F.lit(0))

    def target(tag: Column) -> Column:
        link = F.concat(*[F.regexp_extract(tag, _HREF, i) for i in (1, 2, 3)])
        return F.when(tag.rlike(r"(?is)^<link\b.*\brel\s*=\s*(?:[\"'][^\"']*\bcanonical\b|canonical\b)"), link).when(
            tag.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"), F.regexp_extract(tag, _REFRESH, 1)
        )

    found = (
        pages.where(html.rlike("(?i)canonical|refresh") & F.contains(url, F.lit("://")))
        .select(url.alias("url"), F.explode(F.filter(F.transform(tags, target), lambda t: F.length(t) > 0)).alias("to"))
        .withColumn("to", F.replace(F.trim("to"), F.lit("&amp;"), F.lit("&")))
    )
    site = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    place = path_of(F.col("url"))

    def resolve(to: Column) -> Column:
        return (
            F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
            .when(to.startswith("//"), F.concat(F.regexp_extract("url", r"(?s)^(.*?:)//", 1), to))
            .when(to.startswith("/"), F.concat(site, to))
            .when(to.startswith("#"), F.col("url"))
            .when(to.startswith("?"), F.concat(site, place, to))
            .otherwise(F.concat(site, F.lit("/"), F.regexp_extract(place, r"(?s)^/(.*/)?", 1), to))
        )

    # as lambdas, so that the code generated for the few rows that come here stays small
    ends = F.transform(F.concat(F.array("url"), F.transform(F.array("to"), resolve)), node_of)
    return found.select(ends[0].alias("src"), ends[1].alias("dst")).where("src is not null and dst is not null")


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, edges: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row a page: id, url, host, path, rule, verdict, propagated.  ``rules`` is a short list, or a table of any length (``judged``).

    ``edges`` (src, dst: urls) adds aliases that a crawler's log knows.  A url that no rule fits is blocked
    if its component has a blocked and no explicitly allowed member, else allowed; a null url, or one without
    ``://``, has empty host and path and is allowed.  Pages that repeat a url are judged alike; a null page names no alias, very
    long ones are read whole, other columns are not read.  An empty table gives an empty result.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = judged(rows, rules).withColumnRenamed("action", "_qw_action").withColumn("_qw_node", node_of(F.col("url")))
    links = alias_edges(pages, url_col, html_col)
    if edges is not None:
        more = edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
        links = links.unionByName(more.where("src is not null and dst is not null"))
    parts = connected_components(links)
    parts = parts.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))})
    said = judged(parts, rules).withColumnRenamed("action", "said")
    blocked = (
        said.groupBy("component").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
        .where("blocked and not coalesce(allowed, false)").select("component")
    )
    aliases = said.where("said is null").join(blocked, "component", "left_semi").select(F.col("node").alias("_qw_node"), F.lit(True).alias("_qw_blocked"))
    return rows.join(aliases, "_qw_node", "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("_qw_action", F.when(F.col("_qw_blocked"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("_qw_blocked", F.lit(False)).alias("propagated"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``; nulls, odd urls and repeated rows as ``filter_urls`` says."""
    return filter_urls(documents(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql_node(u: str) -> str:
    rest = rf"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return (
        f"CASE WHEN contains({u}, '://') THEN lower(regexp_extract({u}, '(?s)^(.*?)://', 1)) || '://' || {_sql_host(u)} || "
        f"CASE WHEN starts_with({rest}, '/') THEN {rest} ELSE '/' || {rest} END END"
    )


def _sql_host(u: str) -> str:
    return f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"


def _sql_path(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


_FIRST = """(SELECT {what} FROM rules r WHERE (h = r.host OR ends_with(h, '.' || r.host)) AND starts_with(p, r.path)
    ORDER BY length(r.host || r.path) DESC, action LIMIT 1)"""
OP2_SQL = rf"""
WITH RECURSIVE rules(action, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
tags AS (
    SELECT url, unnest(regexp_extract_all(html, '{_TAG}')) AS tag FROM pages WHERE contains(url, '://')
), found AS (
    SELECT url, replace(trim(CASE
        WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*(?:["''][^"'']*\bcanonical\b|canonical\b)') THEN
            regexp_extract(tag, '{_HREF.replace("'", "''")}', 1) || regexp_extract(tag, '{_HREF.replace("'", "''")}', 2)
            || regexp_extract(tag, '{_HREF.replace("'", "''")}', 3)
        WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN
            regexp_extract(tag, '{_REFRESH.replace("'", "''")}', 1) END), '&amp;', '&') AS t
    FROM tags
), whole AS (
    SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
        WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t
        WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t
        WHEN starts_with(t, '#') THEN url
        WHEN starts_with(t, '?') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || {_sql_path("url")} || t
        ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' || regexp_extract({_sql_path("url")}, '(?s)^/(.*/)?', 1) || t END AS dst
    FROM found WHERE length(t) > 0
), one AS (
    SELECT {_sql_node("url")} AS a, {_sql_node("dst")} AS b FROM whole
), edges AS (
    SELECT a, b FROM one WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM one WHERE a IS NOT NULL AND b IS NOT NULL
), reach(a, b) AS (
    SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), said AS (
    SELECT a, {_FIRST.format(what="r.action")} AS act
    FROM (SELECT DISTINCT a, {_sql_host("b")} AS h, {_sql_path("b")} AS p FROM reach)
), aliases AS (
    SELECT a FROM said GROUP BY a HAVING bool_or(act = 'block') AND NOT coalesce(bool_or(act = 'allow'), false)
), u AS (
    SELECT page_id, {_sql_node("url")} AS node, {_sql_host("url")} AS h, {_sql_path("url")} AS p FROM pages
)
SELECT page_id, h AS host, p AS path, {_FIRST.format(what="r.host || r.path")} AS rule,
       coalesce({_FIRST.format(what="r.action")}, CASE WHEN node IN (SELECT a FROM aliases) THEN 'block' ELSE 'allow' END) AS verdict
FROM u
"""
