"""Main text of web pages by a decision tree over flat text blocks.

The page is cut into blocks at block-level tags. A block knows its words, its link density, both for its
neighbours too, and whether it lies in an element that by name or class holds page furniture, or in the
article. The body and the elements around the article are no furniture. A decision tree, grown on the small labelled table below, tells which blocks are main text.

An inline element named as an advert loses its text. A header element is furniture also within an article, as headers are to go, so a
title that stands in one goes with it; what an unnamed element says of replies, or an article beside the main one, is text like any other.

Defined results: null or empty html, or a page without main text, gives an empty text; unclosed, crossing
or cut-off tags end at the page's end, and a < that begins no whole tag is text; an element is never closed by
a tag that wasn't opened; repeated rows give equal texts. Work is linear in the page, however deep it nests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags that end a block; elements whose text is never shown; elements that hold page furniture, or the article.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("head iframe math noscript object script select style svg template textarea title".split())
FOREIGN = frozenset("math svg".split())
CONTAINER = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol p section span table ul".split())
FURNITURE = frozenset("aside button dialog fieldset footer form header menu nav".split())
ARTICLE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words that as a whole class, id or role make furniture of an inline element, whose text then goes.
INLINE_WORDS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising promo promoted promotion sponsor sponsored".split())
#: Words in a class, id or role that name furniture, or the article.
FURNITURE_WORDS = frozenset("ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright discussion disqus footer form gdpr header login menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split())
ARTICLE_WORDS = frozenset("article articlebody content entry main post story".split())
#: Parts of a class, id or role by which it tells of a page's layout or state rather than of what the element holds.
STATE_WORDS = frozenset("closed disabled enabled fixed has hidden hide is layout no not off on open page show single template to with without wrapper".split())
PARTS = re.compile(r"[a-z]+")
#: Elements that an unclosed one of the same kind ends.
SELF_ENDING = frozenset("p li dd dt option tr td th".split())

#: Labelled pages: [n] stands for n words, [an] for n linked words, and ! before them says that they are main text.
PAGES = [
    "<nav><ul><li>[a1]<li>[a1]<li>[a1]<li>[a2]</ul></nav><div class=ad>[12]</div><article><h1>![8]</h1><p>![60]<p>![35]<h2>![3]</h2><p>![90]<p>![1]<p>![2]<p>![14]</article><footer>[9]</footer>",
    "<header>[3]<a href=x>[a2]</a></header><div class=cookie>[25]</div><main><h1>![6]</h1><p>![120]<ul><li>![a5]<li>![4]<li>![a1]</ul><p>![40]<aside><p>[30]</aside><p>![11]</main><div class=comments><p>[45]<p>[60]<p>[12]</div><footer>[14]</footer>",
    "<div><a href=x>[a1]</a></div><div><a href=x>[a2]</a></div><div><a href=x>[a1]</a></div><h1>![9]</h1><p>![80]<p>![55]<p>![6]<p>![110]<div><a href=x>[a3]</a></div><div><a href=x>[a2]</a></div><div>[4]</div>",
    "<p>[a2]<p>[a3]<p>![60]<h2>![2]</h2><p>![45]<h2>![3]</h2><p>![70]<p>![22]<p>[a4]<p>[a6] [2]<p>[a3]",
    "<div class=layout><div class=sidebar><p>[a3]<p>[40]<p>[60]</div><div class=content><h2>![5]</h2><p>![30]<p>![9]<p>![150]<p>![3]</div></div><div class=related><p>[a8]<p>[a12] [14]</div>",
    "<table><tr><td>[a1]<td>[a1]<td>[a1]</tr></table><h1>![4]</h1><p>![25]<p>![40]<table><tr><td>[a2]<td>[a1]</tr></table><p>[3]",
    "<p>[5]<p>[a1]<p>[a2]<p>[a1]<h1>![7]</h1><p>![90] [a4]<p>![65]<ul><li>![12]<li>![18]<li>![12]</ul><p>[20] [a44]<p>[a14] [9]<p>[2]<p>[a2]",
    "<article><p>![2]<p>![2]<p>![1]</article><div class=share>[4]</div><div class=newsletter><p>[22]</div>",
    "<article class=post><h1>![12]</h1><div class=notice>[12]</div><p>![400]<div class=ad><p>[30]</div><p>![8]<button>[1]</button><p>![a6]</article><nav><a href=x>[a2]</a></nav>",
    "<p>[a3]<p>[a2]<p>[4]<p>[3]<p>[a5]<p>[a2] [1]<p>[a1]",
    "<ul><li>[a2]<li>[a3]<li>[a2]</ul><p>![6]<p>![55]<p>![4]<p>![48]<p>![6]<ul><li>[a1]<li>[a1]</ul>",
    "<ul><li>[a1]<li>[a2]</ul><h1>![2]</h1><p>![40]<p>![2]<ul><li>[a1]<li>[a2]</ul>", "<p>[a1]<h1>![4]</h1><p>![90]<p>![3]<p>[a1]",
    "<h1>![4]</h1><p>![40]<p>![2]<p>![18]<p>![25]<form><p>[30]<p>[3]</form><div class=promo><p>[80]</div>",
    "<div class=teaser><a href=x>[a12] [8]</a></div><div><a href=x>[a9] [3]</a></div><div><a href=x>[a30] [12]</a></div><p>![70]<p>![52]<div><a href=x>[a10] [6]</a></div><div><a href=x>[a15]</a></div>",
    "<p>![40]<p>![60]<p>![5]", "<p>![25]", "<h1>![3]</h1><p>![60]<p>[a3]", "<p>[a2]<p>![12]<p>![30]<p>[a2]", "<article><p>![a5]<p>![60]<p>![a1]<p>![25]</article>",
    "<h1>![1]</h1><p>![3]<p>![1]", "<p>![2]", "![3]", "<p>![1]", "<p>![4]<p>![2]", "<h1>![2]</h1><p>![5]<p>![1]<p>![3]",
    "<menu>[a1]</menu><dialog>[18]</dialog><p>![33]<p>![10]<p>![28]<p>[a2]", "<div class=comments><p>[60]<p>[150]</div>", "<nav><a href=x>[a4]</a></nav><aside>[70]</aside>",
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A tree of (feature, limit, at most, above), with the share of main text at its leaves; Gini splits."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= limit
            p, q, n = y[left].mean(), y[~left].mean(), left.mean()
            impurity = n * p * (1 - p) + (1 - n) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(limit), left)
    if best is None:
        return (share,)
    _, f, limit, left = best
    return f, limit, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def is_main(tree: tuple, x: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def _written(page: str) -> str:
    """A labelled page with its words: main ones are called main."""

    def words(m: re.Match) -> str:
        text = " ".join(["main" if m[1] else "other"] * int(m[3]))
        return f"<a href=x>{text}</a>" if m[2] else text

    return re.sub(r"(!?)\[(a?)(\d+)\]", words, page)


def labelled_table() -> np.ndarray:
    """One row for each block of the labelled pages: its features, and whether it is main text."""
    rows = []
    for page in PAGES:
        found, _ = blocks(_written(page))
        rows += [(*x, found[k][0].startswith("main")) for k, x in enumerate(features(found))]
    return np.array(rows, float)


def features(found: list[tuple]) -> list[tuple]:
    """Words and link density of each block, of that before and of that after, and the marks of furniture and article."""
    none = ("", 0, 0.0)
    return [(x[1], x[2], *a[1:3], *b[1:3], x[3], x[4]) for a, x, b in zip([none, *found], found, [*found[1:], none], strict=False)]


def trained_tree() -> tuple:
    table = labelled_table()
    return grow(table[:, :-1], table[:, -1])


def _names(words: frozenset[str], tokens: list[str], whole: bool) -> bool:
    """Whether a token is one of words, or (unless whole) a compound with one that tells of no layout or state."""
    if any(x in words for x in tokens):
        return True
    parts = [] if whole else [PARTS.findall(x) for x in tokens]
    return any(words.intersection(p) and not STATE_WORDS.intersection(p) for p in parts)


def _inline_furniture(attributes: str) -> bool:
    return any(_names(INLINE_WORDS, (m[1] or m[2] or m[3] or "").lower().split(), True) for m in NAMES.finditer(attributes))


def _marks(tag: str, attributes: str, whole: bool) -> tuple[bool, bool, bool]:
    """Whether an element holds furniture, or the article, and whether its names speak of furniture."""
    furniture, article, named = tag in FURNITURE, tag in ARTICLE, False
    if attributes and tag != "body":
        for m in NAMES.finditer(attributes):
            tokens = (m[1] or m[2] or m[3] or "").lower().split()
            bad = _names(FURNITURE_WORDS, tokens, whole)
            named |= bad
            furniture |= not article and bad
            article |= _names(ARTICLE_WORDS, tokens, whole) and not furniture
    return furniture, article, named


class Elements:
    """Containers in page order: parent's number (-1: none), and whether by its own marks it is furniture, or an article by no name of furniture."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.furniture: list[bool] = []
        self.article: list[bool] = []


def _unmarked(found: list[tuple], elements: Elements) -> frozenset[int]:
    """The elements, by number, that hold the page's article and so are no furniture whatever they are called.

    The article is the article element with the most words, if none with text lies outside furniture and it
    has more words than all that does.
    """
    words = [0] * len(elements.parent)
    outside = 0
    for _, n, density, bad, good, holder in found:
        plain = round(n * (1 - density))
        if not bad:
            if good:
                return frozenset()
            outside += plain
        if holder >= 0:
            words[holder] += plain
    for k in range(len(words) - 1, -1, -1):  # what lies within an element has a greater number
        if elements.parent[k] >= 0:
            words[elements.parent[k]] += words[k]
    # the inner one of several with the same words
    best = max((k for k, x in enumerate(elements.article) if x), key=lambda k: (words[k], k), default=-1)
    if best < 0 or words[best] <= outside:
        return frozenset()
    above, k = set(), elements.parent[best]
    while k >= 0:
        if elements.furniture[k]:
            above.add(k)
        k = elements.parent[k]
    return frozenset(above)


def blocks(html: str, whole: bool = False, unmarked: frozenset[int] = frozenset()) -> tuple[list[tuple[str, int, float, bool, bool, int]], Elements]:
    """Text, words, link density, in furniture, in the article, and the number of the innermost element (-1: none); in page order."""
    elements = Elements()
    found: list[tuple[str, int, float, bool, bool, int]] = []
    #: Tag, in furniture, in the article, number of each open element; the places in it of each tag.
    open_tags: list[tuple[str, bool, bool, int]] = []
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked: list[str] = []
    in_link, hidden = 0, None
    #: An inline element that by name holds an advert or the like, and how many of its kind are open.
    muted, depth = "", 0
    #: Where the block's text begins: an inline element that is open at its end says nothing of it.
    none = begun = ("", False, False, -1)

    def close(place: int) -> None:
        while len(open_tags) > place:
            places[open_tags.pop()[0]].pop()

    def flush() -> None:
        text = unescape("".join(parts)).split()
        if text:
            links = len(unescape("".join(linked)).split())
            _, bad, good, number = begun
            found.append((" ".join(text), len(text), min(1.0, links / len(text)), bad, good, number))
        parts.clear()
        linked.clear()

    for m in TOKEN.finditer(html):
        closing, tag, attributes, text = m.groups()
        if text is not None:
            if hidden is None and not muted:
                if not parts:
                    begun = open_tags[-1] if open_tags else none
                    if text.isspace():
                        continue
                parts.append(text)
                if in_link:
                    linked.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if hidden is not None:
            # what is hidden ends with its own tag, and a head also where the body starts
            if (closing and tag == hidden) or (hidden == "head" and tag == "body"):
                hidden = None
            continue
        if tag in BLOCK:
            flush()
            in_link, muted = 0, ""
        elif muted:
            if tag == muted:
                depth += -1 if closing else 1
                if not depth:
                    muted = ""
        elif attributes and not closing and tag not in VOID and not attributes.endswith("/") and _inline_furniture(attributes):
            muted, depth = tag, 1
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in HIDDEN:
            # only foreign elements may close themselves
            hidden = None if closing or (tag in FOREIGN and attributes.endswith("/")) else tag
            continue
        if tag not in CONTAINER and tag not in FURNITURE:
            continue
        if closing:
            if places.get(tag):
                close(places[tag][-1])
        elif not attributes.endswith("/"):
            if tag in SELF_ENDING and open_tags and open_tags[-1][0] == tag:
                close(len(open_tags) - 1)
            bad, good, named = _marks(tag, attributes, whole)
            _, was_bad, was_good, parent = open_tags[-1] if open_tags else none
            number = len(elements.parent)
            bad &= number not in unmarked
            elements.parent.append(parent)
            elements.furniture.append(bad)
            elements.article.append(good and not named)
            places.setdefault(tag, []).append(len(open_tags))
            open_tags.append((tag, was_bad or bad, (was_good and not bad) or good, number))
    flush()
    return found, elements


def _selected(html: str, tree: tuple, whole: bool) -> list[str]:
    found, elements = blocks(html, whole)
    if any(x[3] for x in found) and (unmarked := _unmarked(found, elements)):
        found, _ = blocks(html, whole, unmarked)
    main = [is_main(tree, x) for x in features(found)]
    if any(main) and not any(x[4] and not x[3] for x in found):
        # without an article's mark, what lies between main blocks is main too, however short; links and furniture are not
        first, last = main.index(True), len(main) - 1 - main[::-1].index(True)
        main = [m or (first < k < last and not x[3] and x[2] <= 0.5) for k, (m, x) in enumerate(zip(main, found, strict=True))]
    return [x[0] for m, x in zip(main, found, strict=True) if m]


def main_text(html: str | None, tree: tuple) -> str:
    # where compound names make furniture of all, only whole names count
    return "\n\n".join(_selected(html or "", tree, False) or _selected(html or "", tree, True))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tree = trained_tree()
        for part in parts:
            yield part.map(lambda x: main_text(x, tree))

    out = pages.drop(*({"text", "n_chars"} - {html})).withColumn("_text", run(F.col(html))).drop(html).withColumnRenamed("_text", "text")
    return out.withColumn("n_chars", F.length("text").cast("long"))
