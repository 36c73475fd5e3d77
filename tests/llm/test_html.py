import itertools

import numpy as np
import pytest

from stemma.llm.html_blocks import leaf_blocks
from stemma.llm.html_extract import Field, block_features, extract_main_text, main_text, read_labels, train_field
from stemma.llm.html_pages import labelled_pages


@pytest.fixture(scope="module")
def field():
    return train_field(labelled_pages(500), steps=120)


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b&nbsp;c<br>d</p>e<div>f<b>g</b> h</div>") == ["a & b c d", "e", "fg h"]
    assert texts("<p>x<script>var t='</p>';</script>y<style>p{}</style><!-- <p>no --> z") == ["xy z"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<p>cut off <a href=\"x") == ["cut off"]
    assert texts("<p title='a>b'>quoted</p><p>1 < 2 &lt; 3 &am") == ["quoted", "1 < 2 < 3 &am"]
    assert texts("") == [] and texts("   ") == [] and texts("plain") == ["plain"]
    assert texts("<script>never closed <p>x") == [] and texts("</p></div>ok") == ["ok"]
    inner = leaf_blocks("<article><p><b>a<br><p>b</article>c")
    assert [[e.tag for e in b.path] for b in inner] == [["article", "p"], ["article", "p"], []]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert texts(deep) == ["x"]
    nested = "<div>t" * 20_000 + "</div>" * 20_000 + "<p>end</p>"
    assert len(leaf_blocks(nested)) == 20_001 and [e.tag for e in leaf_blocks(nested)[-1].path] == ["p"]


def test_hidden_elements_end_where_their_own_do():
    assert texts("<head><script>var s=\"</head>Leak\"</script><title>t</title></head><p>x") == ["x"]
    assert texts("<svg><svg><text>a</text></svg><text>b</text></svg><p>x</p>") == ["x"]
    assert texts("<object><object>a</object>b</object>x<template><template>c</template>d</template>y") == ["xy"]
    assert texts("<template><script>'</template>'</script>hidden</template>x") == ["x"]
    assert texts("<svg><!-- </svg> --><text>a</text></svg>x") == ["x"]
    assert texts("x<noscript><p>n</p>") == ["x"] and texts("x<template><p>n</p>") == ["x"]
    assert texts("x<video>y<p>z</p>") == ["xy", "z"] and texts("x<svg/>y<SVG><g/></SVG>z") == ["xyz"]
    assert texts("<titles>a</titles><objects>b</objects>") == ["ab"]
    many = "<svg>x" * 30_000 + "</svg>" * 15_000 + "<p>end</p>"
    assert texts(many)[-1] == "end"


def test_rules_part_blocks_and_capital_names_are_words():
    assert texts("<p>a<hr>b</p><div>c<hr/>d</div>") == ["a", "b", "c", "d"]
    assert [sorted(b.path[-1].parts) for b in leaf_blocks("<div class=NAV>a</div><div class=MAINContent>b</div>")] == [["menu"], ["main"]]


def test_stray_quotes_lose_no_text():
    assert texts("<div class=\"a\"\">Text</div><p class=\"b\">more</p>") == ["Text", "more"]
    assert texts("<p don't>one</p><p>two</p>") == ["one", "two"]
    assert texts("<p title='a>b' id=x\"y>one</p><p title = \"c>d\"e>two</p>") == ["one", "two"]
    assert texts("<p =\">one</p><p id=='>two</p>") == ["one", "two"]
    assert texts("<p id=\"x>one</p><p>two</p>") == ["one", "two"]
    assert texts("<p a='>'one said 'two") == ["'one said 'two"]
    many = "<p a='>'x" * 50_000
    assert len(texts(many)) == 50_000


def test_viterbi_is_the_best_of_all_labellings(field):
    for blocks, _ in read_labels(labelled_pages(60, 9)):
        blocks = blocks[:9]
        score, before = [], None
        for b in blocks:
            known = [field.index[f] for f in block_features(b, before) if f in field.index]
            score.append(field.weights[known].sum(axis=0))
            before = b

        def total(labels):
            moves = sum(field.pairs[a, b] for a, b in zip(labels, labels[1:]))
            return field.first[labels[0]] + moves + sum(s[k] for s, k in zip(score, labels))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=total)
        assert abs(total(best) - total(field.decode(blocks))) < 1e-9


def test_gradient_steps_raise_the_likelihood_over_a_chain_without_features():
    pages = labelled_pages(40, 3)
    short, long = train_field(pages, steps=2), train_field(pages, steps=60)
    wrong = lambda f: sum(sum(a != b for a, b in zip(f.decode(x), y)) for x, y in read_labels(pages))
    assert wrong(long) < wrong(short) and wrong(long) <= 5


def test_labels_of_unseen_pages(field):
    pages = read_labels(labelled_pages(200, 77))
    wrong = sum(sum(a != b for a, b in zip(field.decode(x), y)) for x, y in pages)
    assert wrong <= 0.005 * sum(len(y) for _, y in pages)


PAGE = (
    "<html><head><title>T</title></head><body><div class='cookie-banner'><p>We use cookies.</p></div><header><a href='/'>Site</a>"
    "</header><nav><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>Menu two</a></li></ul></nav><article><h1>A headline</h1>"
    "<p>First  paragraph of the text.</p><div class='ad'>Buy this thing now.</div><p>Second paragraph, with &quot;signs&quot;.</p>"
    "</article><aside class='sidebar'><p>Popular stories of the week.</p></aside><section class='comments'><p>A reader says that"
    " this is good.</p></section><form><label>Name</label><button>Send</button></form><footer>&copy; Site</footer></body></html>"
)


def test_main_text_of_pages(spark, field):
    want = 'A headline\nFirst paragraph of the text.\nSecond paragraph, with "signs".'
    assert main_text(PAGE, field) == want
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "", ""), (3, "x", "<nav><a href='/'>only menu</a></nav>")]
    rows.append((4, "long", "<article>" + "<p>Some words of prose here.</p>" * 5000 + "</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as row")
    got = extract_main_text(pages, field=field).select("row.page_id", "text").collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 0), (1, len(want)), (1, len(want)), (2, 0), (3, 0), (4, 5000 * 26 - 1)]
    assert extract_main_text(pages.limit(0), field=field).count() == 0


def test_decode_of_nothing():
    empty = Field({}, np.zeros((0, 2)), np.zeros(2), np.zeros((2, 2)))
    assert empty.decode([]) == []
