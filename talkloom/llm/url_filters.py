"""URL filters with redirect equivalence.

Rules block or allow hosts and paths. Addresses that lead to one page (redirects, canonical links) are joined into
components by distributed connected components; a block of any of them holds for all, unless one of them is explicitly
allowed. An address's own rule always comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.llm.components import connected_components
from talkloom.session import materialise

# The rules of the registered query.
DEFAULT_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Query parameters that only say where a visitor came from.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)="


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def url_host(url: Column) -> Column:
    """From after the first :// to a slash, question mark, hash or the end, A to Z lower-cased; empty without :// or url."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit(""))


def url_path(url: Column) -> Column:
    """From after the host to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules=None) -> DataFrame:
    """rule, rule_host, rule_path, verdict of (host, path, verdict) triples."""
    rows = [(host + path, host, path, verdict) for host, path, verdict in (DEFAULT_RULES if rules is None else rules)]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, verdict string")


def match_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, verdict of the longest rule that fits each distinct `url` (of equally long ones the first by code point).

    Hosts meet rules by equality on each of their suffixes at a dot, so any number of rules costs one join."""
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = addresses.select("url", url_path(F.col("url")).alias("path"), url_host(F.col("url")).alias("host")).where("host <> ''")
    spread = spread.select("url", "path", F.explode(suffixes).alias("rule_host"))
    fits = spread.join(rules, "rule_host").where(F.startswith("path", "rule_path"))
    best = fits.groupBy("url").agg(F.min(F.struct((-F.length("rule")).alias("short"), "rule", "verdict")).alias("best"))
    return best.select("url", "best.rule", "best.verdict")


def absolute(base: Column, link: Column) -> Column:
    """A link as an address, seen from the page at `base`; null where that can't be told."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(_after_scheme(base), r"^[^/?#]*", 0))
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    plain = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
    plain = plain.when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
    plain = plain.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
    plain = plain.when(F.startswith(link, F.lit("/")), F.concat(site, link))
    return F.when((scheme != "") & (link != ""), plain.otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link)))


def declared_edges(pages: DataFrame) -> DataFrame:
    """url, alias: what pages say of themselves, by canonical links, og:url and refresh redirects in their html."""
    patterns = [
        r"(?is)<link\b[^<>]*?\brel\s*=\s*[\"']?canonical\b[^<>]*?\bhref\s*=\s*[\"']?([^\"'\s<>]+)",
        r"(?is)<link\b[^<>]*?\bhref\s*=\s*[\"']?([^\"'\s<>]+)[^<>]*?\brel\s*=\s*[\"']?canonical\b",
        r"(?is)<meta\b[^<>]*?\bproperty\s*=\s*[\"']?og:url\b[^<>]*?\bcontent\s*=\s*[\"']?([^\"'\s<>]+)",
        r"(?is)<meta\b[^<>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*?\burl\s*=\s*[\"']?([^\"'\s<>;]+)",
    ]
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)(<(?:link|meta)\b[^<>]*>)"), F.lit(1))
    found = pages.where("url is not null and html is not null").select("url", F.explode(tags).alias("tag"))
    links = F.filter(F.array(*[F.regexp_extract("tag", p, 1) for p in patterns]), lambda link: link != "")
    return found.select("url", F.explode(links).alias("link")).select("url", absolute(F.col("url"), F.col("link")).alias("alias")).where("alias is not null")


def equivalent_form(url: Column) -> Column:
    """The address to which sites redirect the usual variants: https, host in lower case without www., no fragment, no
    tracking parameter, no closing slash."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING) & (p != "")), "&")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def redirect_edges(addresses: DataFrame) -> DataFrame:
    """url, alias of the redirects that `equivalent_form` describes; an `url` without a host has none."""
    known = addresses.select("url").where(url_host(F.col("url")) != "").distinct()
    return known.select("url", equivalent_form(F.col("url")).alias("alias")).where("url <> alias")


def judge(pages: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, component for every row of `pages` (page_id, url).

    The verdict is that of the longest rule for the page's url; without one, `allow` if an address of its component is
    explicitly allowed, else `block` if one is blocked, else `allow`. A null url or one without a host is allowed and
    stands alone (component null). Repeated rows are each judged; pages without edges stand alone; empty tables give
    empty results; other columns are ignored."""
    own = pages.select("page_id", "url")
    members = materialise(connected_components(edges, "url", "alias"))
    addresses = members.select(F.col("node").alias("url")).unionByName(own.select("url").where("url is not null")).distinct()
    ruled = materialise(match_rules(addresses, rules))
    of = ruled.join(members, ruled["url"] == members["node"]).groupBy("component")
    # written, so that the joins read plain tables and can split a component that holds very many addresses
    passed = materialise(of.agg(F.max(F.col("verdict") == "allow").alias("any_allow"), F.max(F.col("verdict") == "block").alias("any_block")))
    states = members.join(passed, "component", "left").select(F.col("node").alias("url"), "component", "any_allow", "any_block")
    verdict = F.when(F.col("any_allow"), "allow").when(F.col("any_block"), "block").otherwise("allow")
    judged = own.join(ruled, "url", "left").join(states, "url", "left")
    return judged.select(
        "page_id",
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", verdict).alias("verdict"),
        "component",
    )


def judge_pages(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """`judge` over all that the pages tell of aliases, under the default rules unless others are given."""
    rules = rule_table(pages.sparkSession) if rules is None else rules
    declared = materialise(declared_edges(pages))  # else every page's html would be searched once for each use
    addresses = pages.select("url").unionByName(declared.select(F.col("alias").alias("url")))
    return judge(pages, declared.unionByName(redirect_edges(addresses)), rules)
