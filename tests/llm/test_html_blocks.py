"""Block rules on small pages."""

import random
import time
from html.parser import HTMLParser

import pytest

from radiomap.llm import html_blocks
from radiomap.llm.html_blocks import extract, main_text

LONG = "the cat and the dog of it is on a mat with the rest " * 6


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
    ("<article><h1>T &amp; &#233;&nbsp;x</h1><p>a\n b<br>c</p><p>Be.</p></article>", "T & é x\na b c\nBe."),
    ("<nav><a href=x>Home</a></nav><article><p>Text here.</p></article><footer>f</footer>", "Text here."),
    ("<article><p>One <b>two</b> <i>three</i>four</p><div class='ad box'>Buy</div><section id=comments><p>Nice</p></section></article>", "One two threefour"),
    ("<article><p>In<script>var a='</p><p>no';</script> one</p><style>p{}</style><!-- <p>no</p> --></article>", "In one"),
    ("<article><p>Cut &am", "Cut &am"), ("<article><p>Cut <b", "Cut"), ("<article><p>open<p>next", "open\nnext"),
    (f"<div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>", "\n".join([LONG.strip(), "Short.", LONG.strip()])),
    (f"<div class=menu><p>{LONG}</p></div><p>{LONG}</p><p><a href=x>more links</a></p>", LONG.strip()),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body.</p></article>", "Title\nBody."),
    ("<p>2 < 3 and 4 > 1</p>" * 1, ""),
    ("<article><p>2 < 3</p><form><p>Name</p></form><div style='display: none'>x</div></article>", "2 < 3"),
])
def test_main_text(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("make", [
    lambda n: "<" * n, lambda n: "<a" * n, lambda n: '<p "' * n, lambda n: "<!--" * n, lambda n: "<div>" * n, lambda n: "&#" * n,
    lambda n: "<div>" * n + "</section>" * n, lambda n: "<div><ul>" * n + "</ul></div>" * n, lambda n: "<p class=ad>x" * n,
    lambda n: "<li class=ad>x</p>" * n, lambda n: "<article><p>x" * n, lambda n: "<nav><main>" * n, lambda n: "<script>" * n])
def test_linear_in_bad_markup(make):
    def took(n):
        start = time.process_time()
        main_text(make(n))
        return time.process_time() - start
    took(1000)
    assert took(40_000) < 8 * took(10_000) + 0.5  # four times the text


PROSE = "It is of the kind that was in the house and on the road to it, as they say. " * 4
LINKS = "".join(f"<li><a href=x>Story {k} of the day</a></li>" for k in range(4))
#: (page, main text): pages on which each pass alone goes wrong, marked and unmarked.
PAGES = [
    (f"<article><h1>Head</h1><p>{PROSE}</p><h2>Read next</h2><ul>{LINKS}</ul><h2>Later</h2><p>{PROSE}</p><p>Short end.</p></article>",
     ["Head", PROSE.strip(), "Later", PROSE.strip(), "Short end."]),
    (f"<div><h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><h2>Read next</h2><ul>{LINKS}</ul></div>", ["Head", PROSE.strip(), "Short.", PROSE.strip()]),
    (f"<article><p>{PROSE}</p><p><a href=x>Click here for more of it</a></p><div class=ad>Buy now</div><p>Yes.</p></article>", [PROSE.strip(), "Yes."]),
    ("<article><h1>Head</h1><p>Short.</p></article><p>" + PROSE + "</p>", ["Head", "Short."]),
    (f"<ul>{LINKS}</ul><p>Tag line</p><ul>{LINKS}</ul><p>{PROSE}</p>", [PROSE.strip()]),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_both_passes_decide(html, want):
    assert main_text(html) == "\n".join(want)


def test_neither_pass_can_go(monkeypatch):
    with monkeypatch.context() as m:  # the second pass keeps only what the first has decided
        m.setattr(html_blocks, "second_pass", lambda found, labels: [x == html_blocks.GOOD for x in labels])
        assert sum(main_text(h) != "\n".join(w) for h, w in PAGES) >= 4
    with monkeypatch.context() as m:  # the first pass knows elements alone
        m.setattr(html_blocks, "first_pass", lambda b, marked: html_blocks.BAD if b.outside or (marked and not b.article) else html_blocks.UNDECIDED)
        assert sum(main_text(h) != "\n".join(w) for h, w in PAGES) >= 3
    for name, value in (("MANY_STOPS", 2.0), ("LINKED", 2.0), ("LONG", 10**9)):  # nor any of its measures
        with monkeypatch.context() as m:
            m.setattr(html_blocks, name, value)
            assert any(main_text(h) != "\n".join(w) for h, w in PAGES), name


def plain_neighbours(found, labels):
    """The second pass by looking at every pair of blocks."""
    out = []
    for i, b in enumerate(found):
        if labels[i] != html_blocks.UNDECIDED:
            out.append(labels[i] == html_blocks.GOOD)
            continue
        near = [j for j in range(len(found)) if labels[j] != html_blocks.UNDECIDED
                and (not b.article or (found[j].article == b.article and not found[j].outside
                                       and (b.tag != "p" or labels[j] == html_blocks.GOOD)))]
        least = min((abs(i - j) for j in near), default=0)
        both = sorted(j for j in near if abs(i - j) == least)
        same = {labels[j] == html_blocks.GOOD for side in (min, max) for j in [side(near)]} if near else set()
        votes = [labels[j] == html_blocks.GOOD for j in both]
        if not near:
            out.append(b.article > 0)
        elif len(set(votes)) == 1:
            out.append(votes[0])
        elif found[both[0]].outside != found[both[1]].outside:
            out.append(votes[found[both[0]].outside])
        else:
            out.append(votes[1] if b.tag[:1] == "h" and b.tag != "header" else b.article > 0)
        assert same or not near
    return out


def test_second_pass_against_brute_force():
    draw = random.Random(5)
    for _ in range(500):
        articles = sorted(draw.randrange(3) for _ in range(draw.randrange(1, 14)))
        found = [html_blocks.Block("x", 0, draw.choice(["p", "h2", "li"]), draw.random() < 0.2, a) for a in articles]
        labels = [html_blocks.BAD if b.outside else draw.choice([html_blocks.GOOD, html_blocks.BAD, html_blocks.UNDECIDED, html_blocks.UNDECIDED]) for b in found]
        assert html_blocks.second_pass(found, labels) == plain_neighbours(found, labels)


class Plain(HTMLParser):
    """The article of a generated page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks, self.raw = 0, [""], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.raw += tag in ("script", "style")
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.raw -= tag in ("script", "style")
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.raw:
            self.blocks[-1] += data


def test_whole_table_against_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html)
        assert got[r.page_id] == "\n".join(t for b in p.blocks if (t := " ".join(b.split()))), r.page_id


def test_rows(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "clash"), (1, "u", "<article><p>a</p></article>", "clash"), (None, None, None, None),
            (2, "v", "<article><p>" + "wörd " * 100_000 + "</p></article>", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 499_999)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
