from urllib.parse import urljoin

import duckdb
import pytest

from stemma.llm import oracle
from stemma.llm.queries import RULES
from stemma.llm.url_filter import judge_urls, page_links, rule_table


def canonical(url):
    return f'<html><head><link rel="canonical" href="{url}"></head></html>'


def refresh(url):
    return f"<meta http-equiv='refresh' content='0; url={url}'>"


ROWS = [
    (1, "http://A.Net/x?q#f", ""), (2, "https://www.example.net/en/1", None), (3, "http://example.com/de/2", ""),
    (4, "http://example.com", ""), (5, None, "x"), (6, "no scheme", "x"), (7, "http://net/", ""), (8, "http://net", ""),
    (9, "http://planet/", ""), (10, "ftp://x.org/fr/ä", ""), (11, "http://y.org/fr", ""), (12, "://x.net/", ""),
    # a blocked target reaches its alias, and on along a chain
    (20, "http://alias.example.org/a", canonical("http://bad.net/a")),
    (21, "http://more.example.org/a", refresh("http://alias.example.org/a")),
    # an allow in the class goes before a block
    (30, "http://one.example.com/a", canonical("http://bad.net/b")),
    (31, "http://two.example.com/a", canonical("http://bad.net/b")),
    (32, "http://two.example.com/a", canonical("//z.example.net/en/b?x=1&amp;y=2")),
    # its own rule goes before the class
    (33, "http://three.example.com/de/a", canonical("http://z.example.net/en/b?x=1&y=2")),
    # relative links, comments, scripts, links to itself
    (40, "http://rel.example.com/dir/a?x", canonical("b")), (41, "http://rel.example.com/dir/b", canonical("http://bad.net/c")),
    (42, "http://rel.example.com/q", canonical("?z=1")), (43, "http://rel.example.com/q?z=1", canonical("/dir/b")),
    (44, "http://com.example.com/r", "<!-- " + canonical("http://bad.net/c") + " -->"),
    (45, "http://com.example.com/s", "<script>'" + canonical("http://bad.net/c") + "'</script>"),
    (46, "http://com.example.com/t", canonical("#top") + canonical("")),
    (47, "http://com.example.com", canonical("d")), (48, "http://com.example.com/d", refresh("http://bad.net/d")),
    (49, "http://com.example.com/d", refresh("http://bad.net/d")),
]


def judged(rows):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_rules_and_aliases(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'c' as host", "'d' as node")
    got = judged(judge_urls(pages, rule_table(spark, RULES)).collect())
    assert len(got) == len(ROWS)
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == ("example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == ("example.com", "", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2] == "net/" and got[8][2] is None and got[9][2] is None
    assert got[10][2:] == ("org/fr/", "allow") and got[11][2] is None and got[12][2] == "net/"
    verdicts = {k: v[3] for k, v in got.items()}
    assert [verdicts[k] for k in (20, 21, 30, 31, 32, 33)] == ["block", "block", "allow", "allow", "allow", "block"]
    assert [verdicts[k] for k in range(40, 50)] == ["block"] * 4 + ["allow"] * 3 + ["block"] * 3


def test_same_as_sql(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    rows = connection.execute(oracle.URL_FILTER).fetchall()
    names = [c[0] for c in connection.description]
    want = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in (dict(zip(names, x)) for x in rows)}
    assert judged(judge_urls(pages, rule_table(spark, RULES)).collect()) == want


def test_further_links_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", None), (1, "http://a.com/", None)], "page_id long, url string, html string")
    links = spark.createDataFrame([("http://a.com", "http://b.net/"), (None, "x"), ("x", None)], "source string, target string")
    rules = rule_table(spark, RULES)
    assert [r.verdict for r in judge_urls(pages, rules, links).collect()] == ["block", "block"]
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in judge_urls(pages, rules.limit(0)).collect()] == ["allow", "allow"]


@pytest.mark.parametrize("order", [1, -1])
def test_longest_rule_wins_then_allow(spark, order):
    rules = [("block", "a.com/"), ("allow", "a.com/x"), ("block", "a.com/y"), ("allow", "a.com/y")][::order]
    pages = spark.createDataFrame([(1, "http://a.com/z", ""), (2, "http://a.com/xy", ""), (3, "http://a.com/yx", "")], "page_id long, url string, html string")
    got = judge_urls(pages, rule_table(spark, rules)).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow", 3: "allow"}


def test_links_resolve_as_in_the_library(spark):
    base = "http://a.com/b/c/d;p?q"
    links = "g ./g g/ /g ?y g?y g;x ;x . ./ .. ../ ../g ../.. ../../ ../../g ../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g?y/./x".split()
    links += ["//b.com/x/y", "HTTP://C.com/z", "http://d.com", "a/b/../../c"]
    rows = [(f"{base}{i}", canonical(x)) for i, x in enumerate(links)]
    got = {r.source: r.target for r in page_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    for (url, _), link in zip(rows, links):
        assert got[url].lower() == urljoin(url, link).lower(), link


def test_how_pages_name_their_canonical_address(spark):
    tags = {
        "<link href='/x' rel='shortlink  Canonical'>": "/x", "<LINK REL=canonical HREF=/x>": "/x",
        "<link rel='canonicalize' href='/x'>": None, "<link data-x='rel=canonical' rel='icon' href='/x'>": None,
        "<link rel='canonical' href='/a?b&#61;1&#x26;c=2&amp;d&quot;'>": '/a?b=1&c=2&d"', "<link rel='canonical' href=' /x\n'>": "/x",
        "<style><link rel='canonical' href='/x'></style>": None, "<template><link rel='canonical' href='/x'></template>": None,
        "<textarea><link rel='canonical' href='/x'></textarea>": None, "<link rel='canonical' href='/&#8364;&#0;'>": "/\u20ac\ufffd",
        "<link rel='canonical' href='javascript:void(0)'>": None,
    }
    rows = [(f"http://a.com/{i}", html) for i, html in enumerate(tags)]
    got = {r.source: r.target for r in page_links(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {u: "http://a.com" + want for (u, _), want in zip(rows, tags.values()) if want}


def test_a_very_long_page(spark):
    html = "<p>text</p>" * 200_000 + canonical("http://bad.net/a")
    pages = spark.createDataFrame([(1, "http://a.com/x", html)], "page_id long, url string, html string")
    assert [r.verdict for r in judge_urls(pages, rule_table(spark, RULES)).collect()] == ["block"]
