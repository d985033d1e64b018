"""Main text of web pages by two passes of block rules.

A page is read as blocks: runs of text between the tags of block elements.
The first pass weighs each block on its own: length, density of function words and
of links, with the element it stands in (article, menu, footer, form and the like)
as one more piece of evidence. What the evidence leaves open, short or middling
blocks above all, is undecided. The second pass lets these inherit the label of the
nearest decided block. In an article only its own blocks are neighbours: short
paragraphs and headings go with the prose around them, and captions and labels with
the lists of links that they head.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiomap.llm.quality import STOP_WORDS

SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.2, 0.3
LINKED = 0.5

# Elements of HTML by their part in a page.
RAW = frozenset("script style template noscript textarea select iframe object svg math canvas audio video title button".split())
OUTSIDE = frozenset("nav footer aside form dialog menu head fieldset".split())
CONTAINERS = frozenset("html body div section article main header ul ol dl table tbody thead tfoot figure details".split()) | OUTSIDE
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr blockquote pre address figcaption caption summary hr".split())
SPACED = frozenset("br td th".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe signup nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar widget widgets footer header masthead comment comments respond replies disqus discussion share sharing social related "
    "recommended pagination pager login search toolbar".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary dialog alert alertdialog search form menu menubar".split())
ARTICLE_NAMES = frozenset("article entry post story".split())

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)")
_STOPS = frozenset(STOP_WORDS)
_CLOSES_P = BLOCKS - {"html", "body"}

#: Elements of an article that links beside them do not take along.
_TEXT = frozenset("p blockquote pre h1".split())

GOOD, BAD, UNDECIDED = "good", "bad", "undecided"


@dataclass
class Block:
    text: str
    linked: int  # characters of its links
    tag: str
    outside: bool  # in an element that is no main text
    article: int  # number of the article it stands in, 0 for none


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if "=" in source or source.strip(" /") else {}


def _is_outside(tag: str, source: str, in_article: bool) -> bool:
    """Whether an element's own tag says that it is no main text."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return True
    if not source.strip(" /"):
        return False
    a = _attributes(source)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in BAD_ROLES or _HIDDEN.search(a.get("style", "").lower()):
        return True
    names = set(_NAME.findall(f"{a.get('class', '')} {a.get('id', '')}".lower()))
    return tag not in ("html", "body") and bool(names & BAD_NAMES) and not (names & ARTICLE_NAMES and names & {"header"})


def blocks(html: str) -> list[Block]:
    """The blocks of a page that hold text, in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = links = articles = 0
    tag = ""
    opened: list[tuple[str, bool, int]] = [("", False, 0)]  # (element, outside, article) of open containers
    open_names: Counter[str] = Counter()
    unclosed: set[str] = set()  # elements whose closing tag does not come any more

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, tag, opened[-1][1], opened[-1][2]))
        parts, linked = [], 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = unescape(raw)
            parts.append(raw)
            if links:
                linked += len("".join(raw.split()))

    at, m = 0, _MARKUP.search(html)
    while m:
        text(html[at:m.start()])
        at = m.end()
        closing, name, source = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        name = name.lower() if name else ""
        if not name:
            pass
        elif name in RAW:
            if not closing and not source.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            parts.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        elif name in SPACED:
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            links = 0
            if name in CONTAINERS:
                if closing:
                    while open_names[name]:
                        last = opened.pop()[0]
                        open_names[last] -= 1
                        if last == name:
                            break
                elif not source.endswith("/"):
                    _, outside, article = opened[-1]
                    own = _is_outside(name, source, article > 0)
                    if name in ("article", "main") and not article and not own:
                        articles += 1
                        outside, article = any(open_names[o] for o in OUTSIDE), articles
                    opened.append((name, outside or own, article))
                    open_names[name] += 1
            elif not closing and name not in unclosed and source.strip(" /") and _is_outside(name, source, opened[-1][2] > 0):
                k = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)  # an element of text that is none
                if k:
                    at = k.end()
                else:
                    unclosed.add(name)
            tag = "" if closing else name
        m = _MARKUP.search(html, at)
    text(html[at:])
    flush()
    return out


def stop_density(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(w in _STOPS for w in words) / len(words) if words else 0.0


def first_pass(b: Block, marked: bool) -> str:
    """A block's label on its own; ``marked``: the page marks an article.

    Prose speaks for a block: length together with many function words most, fewer of
    either less, and standing in the article. Links, an element that is none of the
    main text and, where there is an article, not standing in it speak against it."""
    size = len(b.text)
    density, stops = b.linked / max(len("".join(b.text.split())), 1), stop_density(b.text)
    evidence = 0
    if size >= LONG and stops >= MANY_STOPS:
        evidence += 2
    elif size >= SHORT or b.article:
        evidence += 1 if stops >= (FEW_STOPS if size >= SHORT else MANY_STOPS) else 0 if b.article else -2
    if density > LINKED:
        evidence -= 4 if b.tag == "li" or size < LONG else 2
    elif size < SHORT and density > 0.2 and not b.article:
        evidence -= 2
    if b.article:
        evidence += 1
    if b.outside or (marked and not b.article):
        evidence -= 5
    return GOOD if evidence >= 2 else BAD if evidence <= -2 else UNDECIDED


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Every block's label after undecided ones have taken the nearest decided
    neighbour's. Equally near ones that differ: the next for headings, else main text
    in an article; elsewhere the one that is not out by its element, else the next
    for headings, else out. Within an article only its own blocks are neighbours, but
    for those in elements that are none of it, and for its paragraphs and title only
    good ones; without any, a block of an article is main text and any other is out."""
    out = [x == GOOD for x in labels]
    n = len(found)
    before, after = [-1] * n, [-1] * n
    for near, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, int] = {}  # by article, the last decided block; 0: of all blocks
        for i in order:
            b = found[i]
            near[i] = last.get(b.article, -1)
            if labels[i] != UNDECIDED:
                last[0] = i
                if b.article and not b.outside:
                    last[b.article] = i
    for i, b in enumerate(found):
        if labels[i] != UNDECIDED:
            continue
        p, q = before[i], after[i]
        heading = re.fullmatch("h[1-6]", b.tag)
        if (p < 0 and q < 0) or (b.article and b.tag in _TEXT):
            out[i] = b.article > 0
        elif p < 0 or q < 0:
            out[i] = out[max(p, q)]
        elif out[p] == out[q]:
            out[i] = out[p]
        elif i - p != q - i:
            out[i] = out[p] if i - p < q - i else out[q]
        elif found[p].outside != found[q].outside:
            out[i] = out[q] if found[p].outside else out[p]
        else:
            out[i] = out[q] if heading else b.article > 0
    return out


def main_text(html: str) -> str:
    found = blocks(html)
    marked = any(b.article and not b.outside for b in found)
    good = second_pass(found, [first_pass(b, marked) for b in found])
    return "\n".join(b.text for b, keep in zip(found, good, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Null html is empty; a page without main text has an empty text. Repeated rows,
    null ids and null urls are returned as they come; other columns are ignored;
    an empty table gives an empty table. Markup that is cut off or never closed
    ends with the page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "") for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
