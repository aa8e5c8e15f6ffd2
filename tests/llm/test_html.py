"""Main text of pages: the given pages by their articles, odd pages by hand."""

import html
import re

import numpy as np
import pytest

from monthspine.llm import html_text as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trees(spark):
    return H.fit_pages(spark.read.parquet(f"{SF}/pages.parquet"))


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"<br>", " ", x) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
    return "\n\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts) if t)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    for r in H.op1_main_text(pages).collect():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Site</a><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav></header>
<div class="cookie-notice">We use cookies on this site, accept them please.</div>
<main><article><h1>Title &amp; more</h1>
<p>First <b>bold</b> and <a href="x">linked</a>&nbsp;text,<br>second line &lt;3.
<p>Another paragraph with enough words to be read as one, and a comma.
<ul><li>point one<li>point two</ul>
<div class="ad">Buy now!</div>
<script>if (a < b) document.write("<p>no</p>")</script>
<table><tr><td>cell a<td>cell b</table>
<form><p>Your name</p><input name=n></form>
</article></main>
<aside class="sidebar"><p>Related things you may like to read.</p></aside>
<section id="comments"><p>A reader says that this is nice, indeed.</p></section>
<footer>&copy; Site</footer></body></html>"""


def test_parts_of_an_article(trees):
    (got,) = H.extract([PAGE], trees)
    assert got.split("\n\n") == [
        "Title & more",
        "First bold and linked text, second line <3.",
        "Another paragraph with enough words to be read as one, and a comma.",
        "point one",
        "point two",
        "cell a",
        "cell b",
    ]


def test_pages_without_names_go_by_their_shape(trees):
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(12))
    prose = "".join(f"<p>{'Some words of prose, that go on for a while. ' * 8}</p>" for _ in range(6))
    (got,) = H.extract([f"<body><div><ul>{links}</ul></div><div>{prose}</div></body>"], trees)
    assert got.count("Some words") == 48 and "Link" not in got


def test_decoding_has_no_contradictions_and_is_best(trees):
    rng = np.random.default_rng(0)
    nodes = [H.Node("#page", -1, 0)]
    for i in range(1, 9):
        p = int(rng.integers(0, i))
        nodes.append(H.Node("div", p, 1, texts=[(i, "x" * int(rng.integers(0, 5)))]))
        nodes[p].children.append(i)
    odds = rng.normal(size=9)
    keep, _ = H.decode(nodes, odds)
    own = np.array([sum(len(t) for _, t in x.texts) for x in nodes])
    gain = odds * np.where(own > 0, 1 + np.log1p(own), 0.25)

    def valid(k):
        return k[0] and all(not k[i] or k[nodes[i].parent] for i in range(1, 9))

    everything = [np.array([True] + [bool(m >> i & 1) for i in range(8)]) for m in range(256)]
    best = max(gain[k].sum() for k in everything if valid(k))
    assert valid(keep) and gain[keep].sum() == pytest.approx(best)


def test_odd_pages(spark, trees):
    pages = [None, "", "   ", "plain words only", "<p", "<p>a<p", "<!-- never closed", "<script>var a = 1", "<a title='x>y'>z</a", "<div " * 500, "<b>" * 3000 + "deep"]
    assert H.extract(pages, trees)[:3] == ["", "", ""]
    rows = [(i, f"u{i}", p, 1) for i, p in enumerate(pages)] + [(None, None, PAGE, 2), (0, "u0", PAGE, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = H.main_text(df, trees, keep=("url",)).collect()
    assert len(out) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert H.op1_main_text(df.limit(0).select("page_id", "url", "html")).collect() == []


def test_boosting_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = H.boost(x, y, np.ones(2000))
    assert ((trees.odds(x) > 0) == (y > 0)).mean() > 0.97
