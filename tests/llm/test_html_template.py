"""Template removal decides on hosts of enough pages; names only below, and never inside articles but for comments."""

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from episodica.llm import html_extract, queries


class Article(HTMLParser):
    """The text of <article>, by the standard library's parser."""

    blocks = {"p", "h1", "h2", "div", "br", "li", "ul"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.on += tag == "article"
        if self.on and tag in self.blocks:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if self.on and tag in self.blocks:
            self.out.append(" ")
        self.on -= tag == "article"

    def handle_data(self, data):
        if self.on:
            self.out.append(data)


def by_parser(page):
    p = Article()
    p.feed(page or "")
    p.close()
    return " ".join("".join(p.out).split())


def test_given_pages_by_another_parser(spark):
    pages = queries.table(spark, "/root/testdata/sf0.1", "pages").where("page_id % 5 = 0")
    rows = {r["page_id"]: r for r in pages.collect()}
    want = {k: by_parser(r["html"]) for k, r in rows.items()}
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == want
    # removal alone, on hosts that have a template
    hosts = Counter(r["url"].split("/")[2] for r in rows.values())
    large = {k for k, r in rows.items() if hosts[r["url"].split("/")[2]] >= 10}
    assert len(large) > 200
    alone = {r["page_id"]: r["text"] for r in html_extract.extract(pages, names=False).collect()}
    assert {k: alone[k] for k in large} == {k: want[k] for k in large}
    # without the removal nearly every page would keep some of its template
    kept = [html_extract.main_text(html_extract.parse(r["html"]), site=True) == want[k] for k, r in rows.items()]
    assert np.mean(kept) < 0.1


def page(i, say, extra="", article=""):
    menu = "".join(f"<li><a href='/{say(1)}'>{say(1)}</a></li>" for _ in range(3 + i % 4))
    return f"<body><div class=top><ul>{menu}</ul></div><p>Intro {i}.</p><article><h1>Head {i}</h1><p>{say(30)}</p>{article}</article>{extra}<div class=bottom>{say(50)}</div></body>"


def test_passages_in_and_beside_articles_stay(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    inside = {3: "<div class='related'><p>A related passage.</p></div>", 4: "<section id='share'><p>Market share fell.</p></section>", 5: "<div class='promo'>Promo of kings</div>"}
    beside = {6: "<div class='ad unlike-any'>Once only</div>"}
    data = [(i, f"http://h.example/{i}", page(i, say, beside.get(i, ""), inside.get(i, ""))) for i in range(40)]
    want = {i: " ".join(re.sub("<[^>]*>", " ", re.search("<p>Intro.*</article>", html)[0]).split()) for i, _, html in data}
    want[6] += " Once only"  # recurs nowhere, so it is no template
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for limit in (4_000_000, 0):
        assert {r["page_id"]: r["text"] for r in html_extract.extract(df, broadcast_subtrees=limit).collect()} == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><div class='related'><p>A passage.</p></div></article>", "A passage."),
        ("<article><section id='share'><p>Market share fell.</section></article>", "Market share fell."),
        ("<article>a<div class='comments'>no</div><ol id=replies><li>no</ol></article>", "a"),
        ("<article>a<article class=comment>no</article><nav>no</nav></article>", "a"),
        ("<article>a</article><div class='related'>no</div>", "a"),
    ],
)
def test_names_on_small_hosts(html, want):
    assert html_extract.main_text(html_extract.parse(html)) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>Intro</p><article>a<aside>b</aside></article><nav>no</nav><form>no</form>", "Intro a b"),
        ("<form><article>a</article>c<button>no</button></form><p hidden>no</p><p style='display: none'>no</p>", "a c"),
        ("<div class=ad>stays</div><header>no</header><article><header>b</header></article>", "stays b"),
    ],
)
def test_what_is_left_of_a_site(html, want):
    assert html_extract.main_text(html_extract.parse(html), site=True) == want


def test_short_articles_beside_long_boxes(spark):
    """A footer longer than the article is still the site's."""
    rng = np.random.default_rng(5)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    data = [(i, f"http://h.example/{i}", f"<body><article><p>{say(4 if i < 5 else 80)}</p></article><div class=foot>{say(60)}</div></body>") for i in range(30)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, names=False).collect()}
    assert got == {i: by_parser(html) for i, _, html in data}
