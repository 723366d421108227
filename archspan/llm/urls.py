"""URL filters with redirect equivalence.

Rules by host and path judge a url first: the longest rule that fits. Urls
without a rule follow their aliases: pages and the targets of their canonical
links and refresh redirects are nodes, connected components of these links are
classes, and a class that holds a blocked url is blocked for each member that no
rule allows itself. Everything else is allowed.

A node is host, path and query: schemes and fragments are not told apart, "." and
".." are resolved, and an empty path is "/". Rules see host and path as they are
written. Targets are resolved against the page's url: absolute ones,
"//host/path", "/path", "?query", "path" and "../path"; targets of other schemes
(mailto:) and fragments are no links, and "&amp;" is "&".

Rules are a short list (up to RULES). DataFrame functions alone are used; they
take a page's html whole, however long it is.

Cases: null url, or one without "://": host and path empty, no rule, no links,
allowed; null html has no links; of rules of equal length that fit, the one of
the longer host wins; repeated rows give repeated results; an empty table gives
an empty result; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

RULES = 1000
CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b[^>]*>"""
TARGET = r"""(?i)url\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null where none does."""
    if len(rules) > RULES:
        raise ValueError("too many rules for one expression")
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        then = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*([?][^#]*)", 1)


def plain_path(path: Column) -> Column:
    """A path that starts with "/" or is empty, with "." and ".." resolved."""
    parts = F.split(path, "/")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))  # noqa: E731 - the root stays
    step = lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x)))
    folded = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(folded, "/"), F.when(folder | (F.size(folded) == 1), "/").otherwise(""))


def node_of(host: Column, path: Column, query: Column) -> Column:
    return F.concat(host, F.when(path.rlike(r"(^|/)[.][.]?(/|$)"), plain_path(path)).when(path == "", "/").otherwise(path), query)


def resolved(to: Column, host: Column, path: Column) -> Column:
    """The node that a target names on a page of host and path; null for no link."""
    own, rest = F.regexp_extract(to, "(?s)^([^?#]*)", 1), query_of(to)
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), node_of(host_of(to), path_of(to), query_of(to)))
        .when(to.startswith("//"), node_of(host_of(F.concat(F.lit("x:"), to)), path_of(F.concat(F.lit("x:"), to)), rest))
        .when((to == "") | to.startswith("#") | to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(own == "", node_of(host, path, rest))
        .when(own.startswith("/"), node_of(host, own, rest))
        .otherwise(node_of(host, F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1)), own), rest))
    )


def aliases(pages: DataFrame) -> DataFrame:
    """(u, v): the nodes of a page and of what its canonical links and refresh redirects name."""
    tags = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all("html", F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, TARGET, 1)),
    )
    found = pages.where("url LIKE '%://%' AND html RLIKE '(?i)canonical|refresh'").select("url", F.explode(tags).alias("to"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    to = resolved(F.replace("to", F.lit("&amp;"), F.lit("&")), host, path)
    return found.select(node_of(host, path, query_of(F.col("url"))).alias("u"), to.alias("v")).where("v IS NOT NULL")


def place_of(node: Column) -> tuple[Column, Column]:
    """Host and path of a node."""
    return F.regexp_extract(node, "(?s)^([^/]*)", 1), F.regexp_extract(node, "(?s)^[^/]*([^?]*)", 1)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each page. redirects: further alias urls (source, target)."""
    url = lambda c: node_of(host_of(F.col(c)), path_of(F.col(c)), query_of(F.col(c)))
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(F.col("url").contains("://"), url("url")).alias("node"))
    judged = judged.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    links = aliases(pages)
    if redirects is not None:
        links = links.unionByName(redirects.where("source LIKE '%://%' AND target LIKE '%://%'").select(url("source").alias("u"), url("target").alias("v")))
    links = common.durable(links.distinct(), "aliases")
    own = judged.select("page_id", "host", "path", "node", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("own"))
    if links.isEmpty():
        common.forget(links)
        return own.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    found = common.durable(connected_components(links), "classes")
    common.forget(links)
    blocked = found.where(fitting(*place_of(F.col("node")), rules)["verdict"] == "block")
    bad = found.join(blocked.select("component").distinct(), "component", "left_semi").select("node", F.lit("block").alias("by_alias"))
    out = own.join(bad, "node", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "by_alias", F.lit("allow")).alias("verdict"))


# The contract's rules.
CONTRACT_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_FIT = "\n".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}"
    for h, p, v in sorted(CONTRACT_RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
)
_HOST = f"translate(regexp_extract(coalesce({{0}}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_PATH = "regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract({0}, '(?s)^[^?#]*([?][^#]*)', 1)"
_DOTS = r"'(^|/)[.][.]?(/|$)'"


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _node(host: str, path: str, query: str) -> str:
    steps = f"list_transform(string_split({path}, '/'), lambda x: [x])"
    folded = f"list_reduce({steps}, lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, x) END)"
    plain = f"array_to_string({folded}, '/') || CASE WHEN list_extract(string_split({path}, '/'), -1) IN ('.', '..') OR len({folded}) = 1 THEN '/' ELSE '' END"
    return f"({host} || CASE WHEN regexp_matches({path}, {_DOTS}) THEN {plain} WHEN {path} = '' THEN '/' ELSE {path} END || {query})"


ORACLE = f"""
WITH RECURSIVE p AS (SELECT page_id, html, url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_QUERY.format("coalesce(url, '')")} AS q FROM pages),
nodes AS (SELECT *, CASE WHEN contains(url, '://') THEN {_node("host", "path", "q")} END AS node FROM p),
t AS (SELECT host, path, node, replace(unnest(list_concat(
        list_transform(regexp_extract_all(html, '{_sql(CANONICAL)}'), lambda x: regexp_extract(x, '{_sql(HREF)}', 1)),
        list_transform(regexp_extract_all(html, '{_sql(REFRESH)}'), lambda x: regexp_extract(x, '{_sql(TARGET)}', 1)))), '&amp;', '&') AS target FROM nodes
      WHERE html IS NOT NULL AND node IS NOT NULL),
w AS (SELECT *, regexp_extract(target, '(?s)^([^?#]*)', 1) AS own, {_QUERY.format("target")} AS rest,
        CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN 'x:' || target END AS whole FROM t),
x AS (SELECT node, rest, whole IS NULL AND (target = '' OR starts_with(target, '#') OR regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:')) AS none,
        CASE WHEN whole IS NULL THEN host ELSE {_HOST.format("whole")} END AS h,
        CASE WHEN whole IS NOT NULL THEN {_PATH.format("whole")} WHEN own = '' THEN path WHEN starts_with(own, '/') THEN own
             WHEN path = '' THEN '/' || own ELSE regexp_extract(path, '(?s)^(.*/)', 1) || own END AS pa FROM w),
l AS (SELECT node AS u, {_node("h", "pa", "rest")} AS v FROM x WHERE NOT none),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach AS (SELECT u AS a, u AS b FROM e UNION SELECT reach.a, e.v FROM reach JOIN e ON reach.b = e.u),
n AS (SELECT a, regexp_extract(b, '(?s)^([^/]*)', 1) AS host, regexp_extract(b, '(?s)^[^/]*([^?]*)', 1) AS path FROM reach),
bad AS (SELECT DISTINCT a FROM (SELECT a, CASE {_FIT} ELSE NULL END AS fit FROM n) WHERE fit.verdict = 'block'),
j AS (SELECT page_id, host, path, node, CASE {_FIT} ELSE NULL END AS fit FROM nodes)
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.verdict, CASE WHEN bad.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN bad ON bad.a = j.node
"""
