"""URL filters whose decisions reach aliases: pages joined by redirects and canonical links.

A rule decides for the URLs that it fits; the longest rule wins. URLs that a
redirect or a canonical link joins are one class, found as connected
components, and a URL without a rule takes its class's decision: allow if an
explicit allow is in the class, else block if a block is, else allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.components import connected_components
from stemma.session import cut_lineage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands before the host, the host, the path and the query.
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_NOT_SHOWN = r"(?is)<!--.*?-->|<(script|style|template|textarea|title)\b.*?</\1\s*>"
_TAG = r"(?is)(<(?:link|meta)\b[^>]*>)"
#: An attribute with its value, which is taken as a whole, so that nothing inside it counts as an attribute.
_ATTRIBUTE = r"(?is)[^\s=>/\"']+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
#: Character references that need no number, as far as URLs hold them; the ampersand comes last.
_NAMED = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}
_REFRESH = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host in lower case, path and query; all empty for a null or a text without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER)
    return host, F.regexp_extract(text, _URL, 2), F.regexp_extract(text, _URL, 3)


def url_node(url: Column) -> Column:
    """The name of a URL among aliases: without scheme and fragment; null for no URL."""
    host, path, query = url_parts(url)
    name = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), query)
    return F.when(F.coalesce(url, F.lit("")).contains("://"), name)


def _attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute of a name, without its quotes; empty if there is none."""
    own = F.filter(attributes, lambda a: a.rlike(rf"(?is)^{name}\s*="))
    value = F.regexp_replace(F.try_element_at(own, F.lit(1)), r"(?s)^[^=]*=\s*", "")
    return F.coalesce(F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2"), F.lit(""))


def _without_dots(path: Column) -> Column:
    """The path without segments ``.`` and ``..``, which takes the one before with it."""

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(segment == ".", kept).when(segment == "..", up).otherwise(F.array_append(kept, segment))

    segments = F.split(path, "/")
    open_end = F.element_at(segments, -1).isin(".", "..")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    joined = F.array_join(F.when(open_end, F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), joined).otherwise(path)


def _decoded(text: Column) -> Column:
    """``text`` with its numeric character references and the commonest names decoded."""

    def put(done: Column, reference: Column) -> Column:
        digits = F.regexp_extract(reference, r"(?i)^&#x?([0-9a-f]+);?$", 1)
        code = F.when(reference.rlike(r"(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        sign = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.replace(done, reference, sign)

    found = F.regexp_extract_all(text, F.lit(r"(?i)(&#(?:x[0-9a-f]{1,8}|[0-9]{1,9});?)"), F.lit(1))
    text = F.aggregate(F.array_sort(F.array_distinct(found)), text, lambda done, r: put(done, r))
    for name, sign in _NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _resolved(link: Column, base: Column) -> Column:
    """An absolute URL for ``link`` found on the page ``base``; null for a link to the page itself."""
    host, path, _ = url_parts(base)
    site = F.concat(F.lit("http://"), host)
    whole = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when((link == "") | link.startswith("#"), F.lit(None).cast("string"))
        .when(link.startswith("?"), F.concat(site, path, link))
        .otherwise(F.concat(site, F.regexp_replace(path, r"[^/]*$", ""), F.when(path == "", "/").otherwise(""), link))
    )
    # Dots are segments of the path alone, and a link to another scheme than the web's leads to no page.
    own_path = url_parts(whole)[1]
    head = F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1)
    rest = F.regexp_extract(whole, r"(?s)^.*?://[^?#]*(.*)$", 1)
    other = link.rlike(r"^(?i)(mailto|javascript|data|tel|about):")
    return F.when(~other & whole.isNotNull(), F.concat(head, _without_dots(own_path), rest))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target): URLs that pages name as their redirect (a refresh) or their canonical address."""
    page = F.col(html_col).cast("string")
    told = pages.where(page.rlike(r"(?i)canonical|http-equiv")).select(
        F.col(url_col).alias("source"),
        F.explode(F.regexp_extract_all(F.regexp_replace(page, _NOT_SHOWN, ""), F.lit(_TAG), F.lit(1))).alias("tag"),
    )
    told = told.withColumn("own", F.regexp_extract_all("tag", F.lit(_ATTRIBUTE), F.lit(0)))
    kinds = F.split(F.lower(_attribute(F.col("own"), "rel")), r"\s+")
    canonical = F.col("tag").rlike(r"(?i)^<link\b") & F.array_contains(kinds, "canonical")
    equivalent = F.lower(F.btrim(_attribute(F.col("own"), "http-equiv"))) == "refresh"
    refresh = F.col("tag").rlike(r"(?i)^<meta\b") & equivalent
    link = F.when(canonical, _attribute(F.col("own"), "href")).when(refresh, F.regexp_extract("tag", _REFRESH, 1))
    link = F.btrim(_decoded(link), F.lit(" \t\n\r\f"))
    return (
        told.select("source", link.alias("link"))
        .where("link is not null and source is not null")
        .select("source", _resolved(F.col("link"), F.col("source")).alias("target"))
        .where("target is not null")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, allow, rule) from (action, ``host/path``) pairs."""
    rows = [(r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1], a == "allow", r) for a, r in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, allow boolean, rule string")


def matched_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, allow) for the places (host, path) that a rule fits; the longest rule wins, then an allow.

    Places are joined to the rules by each of the host's suffixes, so the work
    grows with the labels of a host and not with the number of rules.
    """
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return (
        places.where("host <> ''")
        .select("host", "path", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("long"), "allow", "rule")).alias("best"))
        .select("host", "path", "best.rule", "best.allow")
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    links: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, alias_allow, alias_block, verdict.

    ``links`` holds further (source, target) edges, such as a crawler's log of
    redirects; those in the pages themselves are read from their html. A page
    is judged by the rule that fits its URL, else by its class of aliases: an
    explicit allow in the class goes before a block, and without either the
    page is allowed. A null URL, or one without ``://``, has an empty host and
    path, no rule and no alias. Null html has no links. Repeated rows are
    judged alike. Extra columns are ignored; empty tables give an empty result.
    """
    host, path, _ = url_parts(F.col(url_col))
    rows = cut_lineage(
        pages.select(
            F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), url_node(F.col(url_col)).alias("node")
        )
    )
    ends = page_links(pages, url_col, html_col)
    if links is not None:
        ends = ends.unionByName(links.select("source", "target"))
    ends = cut_lineage(ends.where("source is not null and target is not null"))
    edges = ends.select(url_node(F.col("source")).alias("u"), url_node(F.col("target")).alias("v"))
    sites = ends.select(F.explode(F.array("source", "target")).alias("url")).select(
        url_node(F.col("url")).alias("node"), *[c.alias(n) for c, n in zip(url_parts(F.col("url")), ("host", "path"))]
    )
    places = rows.select("host", "path").unionByName(sites.select("host", "path")).distinct()
    ruled = cut_lineage(matched_rules(places, rules))

    decided = sites.distinct().join(ruled, ["host", "path"])
    parts = cut_lineage(connected_components(edges))
    classes = (
        parts.join(decided, "node")
        .groupBy("component")
        .agg(F.max("allow").alias("alias_allow"), F.max(~F.col("allow")).alias("alias_block"))
    )
    aliases = cut_lineage(parts.join(classes, "component").select("node", "alias_allow", "alias_block"))
    allowed = F.coalesce("allow", F.when(F.coalesce("alias_allow", F.lit(False)), True).otherwise(~F.coalesce("alias_block", F.lit(False))))
    return (
        rows.join(ruled, ["host", "path"], "left")
        .join(aliases, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("alias_allow", F.lit(False)).alias("alias_allow"),
            F.coalesce("alias_block", F.lit(False)).alias("alias_block"),
            F.when(allowed, "allow").otherwise("block").alias("verdict"),
        )
    )
