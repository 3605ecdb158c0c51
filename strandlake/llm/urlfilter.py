"""URL rules and their spread over redirect equivalence, with DataFrame functions only.

A rule (verdict, host, path) fits its host and all subdomains if the URL's path starts
with the rule's; the longest fitting rule decides.  Pages without a rule take part in
redirect equivalence: URLs joined by canonical links, meta refreshes of any delay or by URL
normalisation (scheme, default port, fragment, tracking parameters, closing slash) form
components, found by distributed connected components.  In a component an explicitly
allowed URL has precedence, then a blocked one blocks its aliases; all else is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import connected_components, stash

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*\d+\s*;\s*url\s*=\s*["']?([^"'\s>]+)"""
TRACKING = r"(?<=[?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*&?"


def _rest(url: Column) -> Column:
    """What follows the first ://, or empty."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null.  At most MAX_RULES rules."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """A URL as a node: host and the rest without scheme, default port and fragment."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    return F.when(F.locate("://", url) > 0, F.concat(host, F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)))


def normal_address(node: Column) -> Column:
    """The node without tracking parameters, an emptied query and a closing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(node, TRACKING, ""), "[?&]$", ""), "/$", "")


def resolve(target: Column, url: Column) -> Column:
    """An absolute form of a link target found on the page at url."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme = F.substring_index(url, "://", 1)
    base = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.concat(F.regexp_extract(path_of(url), "^(.*/)", 1))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """Distinct (u, v): addresses of pages joined by links or normalisation."""
    url = F.col("url")
    node = address(url)
    link = lambda pattern: F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
    marked = F.col("html").rlike("(?i)canonical|http-equiv")
    targets = F.array(F.when(marked, address(resolve(link(CANONICAL), url))), F.when(marked, address(resolve(link(REFRESH), url))))
    found = pages.where("url is not null").select(node.alias("u"), F.array_compact(targets).alias("t")).where("u is not null")
    direct = found.select("u", F.explode("t").alias("v"))
    everywhere = found.select("u").union(direct.select(F.col("v")))
    return direct.union(everywhere.select("u", normal_address(F.col("u")).alias("v"))).where("u != v").distinct()


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) of pages (page_id, url, html).

    rule is null where none fits; alias_of is the component's md5 key, null for a URL
    without aliases.  A null URL or one without :// has an empty host and path and gets the
    default; a null html has no links; repeated rows are judged each; other columns are
    ignored; an empty table gives no rows.  Of a page, however long, the first link of each kind
    counts; .. in its target and <base> are not resolved.
    """
    pages = pages.select("page_id", "url", "html")
    edges = stash(alias_edges(pages))
    key = lambda c: F.md5(F.col(c).cast("binary"))
    parts = connected_components(edges.select(key("u").alias("u"), key("v").alias("v")))
    nodes = edges.select(F.col("u").alias("n")).union(edges.select("v")).distinct()
    at = F.concat(F.lit("x://"), F.col("n"))
    ruled = nodes.select(key("n").alias("node"), fitting_rule(host_of(at), path_of(at), rules)["verdict"].alias("said"))
    member = stash(parts)
    said = member.join(ruled, "node").groupBy("component").agg(F.max(F.col("said") == "allow").alias("allowed"), F.max(F.col("said") == "block").alias("blocked"))
    spread = member.join(said, "component").select(
        "node", "component", F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block")).alias("spread")
    )
    url = F.coalesce(F.col("url"), F.lit(""))
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.md5(address(url).cast("binary")).alias("node"))
    judged = judged.withColumn("hit", fitting_rule(F.col("host"), F.col("path"), rules))
    return judged.join(spread, "node", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "spread", F.lit(default)).alias("verdict"), F.col("component").alias("alias_of")
    )
