"""URL filters with redirect equivalence.

A rule is (verdict, host, path prefix). It fits its host and all subdomains when the url's path starts with
the prefix; of the rules that fit, the one with the longest string wins, of equally long ones allow
wins, and of those the first by host and path; long and short rule lists give the same answers. Urls joined by redirect or canonical-link edges form one class (distributed connected components);
a block on any member reaches every alias that no rule of its own decides. Edges come from the
pages' canonical links and meta refreshes and, if given, from a table of redirects. A url's own allow rule takes
precedence over a block that would reach it, and urls outside any blocked class are allowed.

An alias is identified by host, path and query: scheme and fragment do not matter.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is allowed.
Repeated rows are judged each. Edges with a null or unparsable end are ignored; without edges the rules
alone decide. Extra columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.components import connected_components
from quern.sources.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Up to so many rules become one CASE expression; more are joined by host suffix.
MAX_COMPILED = 200
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def alias_of(url: Column) -> Column:
    """What two urls of one page have in common; null where there is no host."""
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), _part(url, 3)))


def _ordered(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))


def match_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds `rule` and `rule_verdict` (null where none fits) to a table with `host` and `path`."""
    if len(rules) > MAX_COMPILED:
        return _match_by_join(urls, rules)
    name = verdict = F.lit(None).cast("string")
    for kind, host, prefix in reversed(_ordered(rules)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        name = F.when(fits, F.lit(host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return urls.withColumns({"rule": name, "rule_verdict": verdict})


def _match_by_join(urls: DataFrame, rules) -> DataFrame:
    """For long lists: distinct (host, path) meet the rules on the host's suffixes."""
    table = urls.sparkSession.createDataFrame([(k, h, p, len(h + p)) for k, h, p in rules], "kind string, rule_host string, prefix string, size int")
    pages = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        pages.withColumn("suffix", F.explode(suffixes))
        .join(table, F.col("suffix") == F.col("rule_host"))
        .where("startswith(path, prefix)")
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.col("size")).alias("longest"), (F.col("kind") != "allow").alias("blocks"), "rule_host", "prefix", "kind")).alias("best"))
    )
    joined = urls.join(best, ["host", "path"], "left")
    return joined.withColumns({"rule": F.concat("best.rule_host", "best.prefix"), "rule_verdict": F.col("best.kind")}).drop("best")


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) urls from canonical links and meta refreshes in the pages' html."""
    tag = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
    refresh = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
    every = lambda tags, value: F.transform(F.regexp_extract_all(html_col, F.lit(tags), F.lit(0)), lambda t: F.regexp_extract(t, value, 1))
    links = every(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    moved = every(refresh, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    has = F.lower(F.col(html_col))
    raw = pages.where(has.contains("canonical") | has.contains("refresh")).select(
        F.col(url_col).alias("source"), F.explode(F.concat(links, moved)).alias("raw")
    )
    raw = raw.withColumn("raw", F.regexp_replace("raw", "(?i)&(amp|#38|#x26);", "&"))
    return raw.where("raw <> '' and source is not null").select("source", _absolute(F.col("source"), F.col("raw")).alias("target"))


def _absolute(source: Column, link: Column) -> Column:
    """A link as its page's browser reads it: with the page's scheme, host, folder or path where it has none, and without dot segments."""
    scheme, host, path = F.regexp_extract(source, r"(?s)^(.*?)://", 1), _part(source, 1), _part(source, 2)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    site = F.concat(scheme, F.lit("://"), host)
    url = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(site, path, link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )
    parts = F.split(F.regexp_extract(url, PARTS, 2), "/")
    none = F.expr("cast(array() as array<string>)")
    kept = F.aggregate(parts, none, lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))))
    # a path that ends in a dot segment names its folder
    whole = F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    dotted = F.regexp_extract(url, PARTS, 2).rlike(r"(^|/)\.\.?(/|$)")
    return F.when(dotted, F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), whole, F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1))).otherwise(url)


def blocked_aliases(edges: DataFrame, rules=RULES, scratch: Scratch | None = None) -> DataFrame:
    """(alias) of the urls whose class holds a url that a rule blocks."""
    scratch = scratch or Scratch(edges.sparkSession, "urls")
    ends = scratch.cut(edges.select(alias_of(F.col("source")).alias("a"), alias_of(F.col("target")).alias("b")), "ends")
    groups = connected_components(ends, "a", "b", scratch)
    split = r"(?s)^([^/?#]*)([^?#]*)"
    nodes = groups.withColumns({"host": F.regexp_extract("node", split, 1), "path": F.regexp_extract("node", split, 2)})
    judged = match_rules(nodes, rules)
    bad = judged.where("rule_verdict = 'block'").select(F.col("component").alias("bad")).distinct()
    return judged.join(bad, F.col("component") == F.col("bad")).select(F.col("node").alias("alias"))


def filter_urls(pages: DataFrame, edges: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages`; `edges` holds (source, target) urls."""
    url = F.col(url_col)
    own = match_rules(pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), alias_of(url).alias("alias")), rules)
    blocked = blocked_aliases(edges, rules).withColumn("reached", F.lit(True))
    verdict = F.coalesce("rule_verdict", F.when(F.col("reached"), "block").otherwise("allow"))
    return own.join(blocked, "alias", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op1_redirect_filter(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """`redirects` may hold further (source, target) urls, such as those of HTTP answers 301 to 308."""
    edges = alias_edges(pages)
    return filter_urls(pages, edges if redirects is None else edges.union(redirects.select("source", "target")))
