"""URL filter by rules and redirect equivalence, DataFrame operations only.

Rules give a page its verdict where one fits. Decisions spread to aliases: nodes are URLs under the syntactic
normalisation of the generic URL syntax (scheme and host in lower case, no default port, no fragment, no dot segments, "/"
for an empty path); nothing else makes two URLs one. Redirect and canonical-link edges, all that a page's HTML declares,
join nodes into components; comments, scripts and text areas declare nothing; references are resolved against the page or its base element, with character references
decoded. A page without a rule takes its component's decision: allow if any member is explicitly
allowed, else block if any member is blocked, else allow.

A null url, or one without "://", has empty host and path, no rule, no aliases, and is allowed. Null or very long HTML is
read whole. Rules of equal length: the later in text order counts. Repeated rows stay. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, lower_ascii
from .components import connected_components

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*["']?\s*([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
#: what a browser does not read as markup: comments, and the text of scripts and text areas
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b[^>]*>|\z)|<textarea\b.*?(?:</textarea\b[^>]*>|\z)"
#: fixed values: character references that occur in URLs; & comes last, so nothing is decoded twice
REFERENCES = (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def without_dots(path: Column) -> Column:
    """path without its "." and ".." segments."""
    fold = lambda p: F.aggregate(
        F.split(F.when(p.rlike(r"/\.\.?$"), F.concat(p, F.lit("/"))).otherwise(p), "/"),
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == ".", acc).when((s == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(s == "..", acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.array_join(fold(path), "/")).otherwise(path)


def node_of(url: Column) -> Column:
    """Normal form of an absolute URL; null where there is none."""
    scheme, query = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    parts = F.struct(scheme.alias("scheme"), host_of(url).alias("host"), path_of(url).alias("path"), query.alias("query"))

    def joined(u: Column) -> Column:
        port = F.when(u["scheme"] == "http", ":(80)?$").when(u["scheme"] == "https", ":(443)?$").otherwise("$^")
        path = F.when(u["path"] == "", "/").otherwise(bind(u["path"], without_dots))
        return F.concat(u["scheme"], F.lit("://"), F.regexp_replace(u["host"], port, F.lit("")), path, u["query"])

    return F.when(url.contains("://"), bind(parts, joined))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on the page at base; null for one to the page itself or of another kind."""
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return bind(
        ref,
        lambda r: F.when((r == "") | r.startswith("#"), None)
        .when(r.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), r)
        .when(r.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(r.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), r))
        .when(r.startswith("/"), F.concat(F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), r))
        .when(r.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), r))
        .otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), r)),
    )


def decoded(ref: Column) -> Column:
    for entity, char in REFERENCES:
        ref = F.replace(ref, F.lit(entity), F.lit(char))
    return ref


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of all canonical links and immediate redirects declared in the pages' HTML. Each pattern is a
    projection of its own, as what a CASE refers to often is computed as often."""
    p = pages.select("url", "html").where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    p = p.select("url", F.regexp_replace("html", HIDDEN, "").alias("html"))
    found = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all("html", F.lit(REFRESH), F.lit(1)))
    p = p.select("url", "html", found.alias("found")).where(F.size("found") > 0)
    p = p.select("url", F.regexp_extract("html", BASE, 1).alias("base"), F.explode(F.array_distinct("found")).alias("ref"))
    p = p.select("url", decoded(F.col("base")).alias("base"), decoded(F.col("ref")).alias("ref"))
    p = p.select("url", F.coalesce(resolve(F.col("url"), F.col("base")), F.col("url")).alias("base"), "ref")
    p = p.select("url", resolve(F.col("base"), F.col("ref")).alias("to"))
    return p.select(node_of(F.col("url")).alias("src"), node_of(F.col("to")).alias("dst")).where("dst is not null and src != dst")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null. rules: (verdict, "host/path")."""
    out = []
    for verdict, rule in rules:
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
        out.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*out)))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_verdict. links: (src, dst) nodes; by default those in the HTML."""
    links = page_links(pages) if links is None else links
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = judged.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    judged = judged.withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules))
    components = connected_components(links)
    seen = judged.where("node is not null").groupBy("node").agg(
        F.max((F.col("own.verdict") == "allow")).alias("allowed"), F.max((F.col("own.verdict") == "block")).alias("blocked")
    )
    named = seen.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    decided = named.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")).where("allowed or blocked")
    decided = decided.select("component", F.when(F.coalesce("allowed", F.lit(False)), "allow").otherwise("block").alias("alias_verdict"))
    by_node = named.select("node", "component").join(decided, "component").select("node", "alias_verdict")
    out = judged.join(by_node, "node", "left")
    return out.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_verdict",
    )
