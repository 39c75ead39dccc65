"""URL filters whose decisions reach the aliases of a page, in DataFrame operations.

A rule names a host and a path prefix. It fits its host and all subdomains; the longest
fitting rule decides. Pages without a rule take the decision of their aliases, the connected
component of their URL in a graph whose nodes are URLs as they are written and whose edges are

* the canonical link and the meta refresh of a page, resolved against its URL;
* recorded redirects;
* the redirect of every URL named so far to its plain spelling: `http`, host in lower case
  without leading `www.` and `m.`, no fragment, no tracking parameters, no closing slash.

Rules are applied to every node, pages or not. Among aliases an explicit allow goes before a
block; without either the page is allowed.

Of several canonical links in a page the first counts, likewise of refreshes. `rel` is a list
of names in any order and case; comments are no markup; a tag ends at its first `>`. Targets
may be relative, with dot segments; `base` elements are not read, targets with a scheme but
no `://` are no links. Named references for `& < > " '` and numeric ones below 128 are read.

A null url and one without `://` or without a host have no rule, no links and no aliases. A
null html has no links. Repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import staged
from docledger.llm.components import components

#: Fixed by the task: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: What follows the first `://`: host, path, query.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
COMMENT = r"(?s)<!--.*?(-->|\z)"
LINK, META = r"(?is)<link\s[^>]*>", r"(?is)<meta\s[^>]*>"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
# References and the signs they stand for; the ampersand comes last.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def part(url: Column, group: int) -> Column:
    """Host, path or query, whichever `group` says; empty for a null url or one without `://`."""
    return F.coalesce(F.regexp_extract(url, PARTS, group), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return part(url, 2)


def longest_rule(host: Column, path: Column, rules: tuple) -> Column:
    """Struct (name, verdict) of the longest rule that fits, or null."""
    decision = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path)
        )
        name = F.struct(F.lit(rule_host + rule_path).alias("name"), F.lit(verdict).alias("verdict"))
        decision = F.when(fits, name).otherwise(decision)
    return decision


def plain(url: Column) -> Column:
    """Where the spelling of a URL redirects to; null if it has no host."""
    host = F.regexp_replace(host_of(url), r"^((www|m)\.)+", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    own = F.filter(F.split(part(url, 3), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    query = F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise("")
    return F.when(host != "", F.concat(F.lit("http://"), host, path, query))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not; empty if there is none."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.trim(F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3))))


def read_references(text: Column) -> Column:
    """Character references as the signs they stand for."""

    def signs(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^([0-9]{1,7});", 1)
        hexes = F.regexp_extract(piece, r"^[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(hexes != "", F.conv(hexes, 16, 10)).when(digits != "", digits).cast("long")
        rest = F.regexp_replace(piece, "^[^;]*;", "")
        return F.when(code.between(1, 127), F.concat(F.char(code), rest)).otherwise(F.concat(F.lit("&#"), piece))

    pieces = F.split(text, "&#")
    later = F.transform(F.slice(pieces, 2, F.size(pieces)), signs)
    read = F.when(F.size(pieces) > 1, F.concat(pieces[0], F.array_join(later, ""))).otherwise(text)
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), NAMED, read)


def without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments carried out."""
    segments = F.split(path, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        none,
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(s))),
    )
    closing = F.when(F.rlike(path, F.lit(r"/\.{1,2}$")), "/").otherwise("")
    plain_ = F.concat(F.array_join(kept, "/"), closing)
    return F.when(F.rlike(path, F.lit(r"/\.{1,2}(/|$)")), plain_).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a full URL, or null where it leads nowhere else."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), part(url, 1))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    first = F.regexp_extract(target, r"^[^?#]*", 0)
    rest = F.substr(target, F.length(first) + 1)
    return (
        F.when((target == "") | F.startswith(target, F.lit("#")), None)
        .when(F.rlike(target, F.lit(SCHEME)), F.when(F.instr(target, "://") > 0, target))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(root, without_dots(first), rest))
        .when(F.startswith(target, F.lit("?")), F.concat(root, path_of(url), target))
        .otherwise(F.concat(root, without_dots(F.concat(folder, first)), rest))
    )


def links_of(html: Column, url: Column) -> Column:
    """Targets of a page's first canonical link and first meta refresh, unresolved."""
    markup = F.regexp_replace(html, COMMENT, "")
    names = lambda tag, name: F.split(F.lower(attribute(tag, name)), r"\s+")
    canonical = F.filter(
        F.regexp_extract_all(markup, F.lit(LINK), F.lit(0)),
        lambda tag: F.array_contains(names(tag, "rel"), "canonical") & (attribute(tag, "href") != ""),
    )
    refresh = F.filter(
        F.regexp_extract_all(markup, F.lit(META), F.lit(0)),
        lambda tag: F.lower(attribute(tag, "http-equiv")) == "refresh",
    )
    return F.array(
        read_references(attribute(F.get(canonical, F.lit(0)), "href")),
        read_references(F.regexp_extract(attribute(F.get(refresh, F.lit(0)), "content"), REFRESH_URL, 1)),
    )


def judge(pages: DataFrame, rules: tuple = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: host, path, rule and verdict. `redirects` has `from_url`, `to_url`."""
    url = F.col("url")
    # Two tables, as links and rules in one projection would repeat each other's expressions.
    found = staged(
        pages.select(
            "page_id",
            "url",
            host_of(url).alias("host"),
            path_of(url).alias("path"),
            links_of(F.col("html"), url).alias("targets"),
        ),
        "links",
    )
    seen = staged(
        found.select(
            "page_id",
            "host",
            "path",
            F.when(F.col("host") != "", url).alias("node"),
            F.transform("targets", lambda t: resolved(t, url)).alias("targets"),
            longest_rule(F.col("host"), F.col("path"), rules).alias("decision"),
        ),
        "pages",
    )
    with_host = lambda c: host_of(F.col(c)) != ""
    linked = seen.filter("node is not null").select(F.col("node").alias("a"), F.explode("targets").alias("b"))
    if redirects is not None:
        linked = linked.union(redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")))
    linked = staged(linked.filter(with_host("a") & with_host("b")).distinct(), "redirects")
    urls = seen.select(F.col("node").alias("a")).union(linked.select("a")).union(linked.select("b"))
    spelled = staged(urls.filter("a is not null").distinct().withColumn("b", plain(F.col("a"))), "spellings")
    tied = components(linked.union(spelled))
    # Rules on every node; one row per node first, so a crowded alias meets the join as one row.
    own = longest_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    decided = (
        spelled.select(F.col("a").alias("node"))
        .union(spelled.select("b").filter("b is not null"))
        .select("node", own["verdict"].alias("verdict"))
        .filter("verdict is not null")
        .distinct()
        .join(tied, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("class"))
        .agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    )
    verdict = F.coalesce(
        F.col("decision.verdict"),
        F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow"),
    )
    open_ = seen.filter("decision is null and node is not null").select("node").distinct()
    handed = (
        open_.join(tied, "node", "left")
        .withColumn("class", F.coalesce("component", "node"))
        .join(decided, "class")
        .select("node", "allowed", "blocked")
    )
    return seen.join(handed, "node", "left").select(
        "page_id", "host", "path", F.col("decision.name").alias("rule"), verdict.alias("verdict")
    )
