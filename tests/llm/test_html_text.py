"""Pages whose names speak of furniture that they hold, or that have no article markup."""

from __future__ import annotations

import pytest

from ridgeline.llm import html_text

LONG = " ".join(f"word{i}" for i in range(40))
ARTICLE = f"<article><h1>A title</h1><p>{LONG}</p><p>The end.</p></article>"
WANT = f"A title\n\n{LONG}\n\nThe end."
LINKS = "<ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul>"


@pytest.fixture(scope="module")
def tree():
    return html_text.trained_tree()


@pytest.mark.parametrize(
    "page",
    [
        f'<html class="no-sidebar"><body class="post no-sidebar">{ARTICLE}</body></html>',
        f'<body class="sidebar comments">{ARTICLE}</body>',
        f'<body><div class="content with-sidebar">{ARTICLE}</div></body>',
        f'<body><div class="widget"><section class="promo">{ARTICLE}</section></div></body>',
        f'<body>{LINKS}<div class="sidebar"><div class="nav-left">{LINKS}</div>{ARTICLE}</div></body>',
        f'<body><div class="content with-sidebar"><p>A title</p><p>{LONG}</p><p>The end.</p></div></body>',
        f'<body><div class="header-bar"><p>A title</p><p>{LONG}</p><p>The end.</p></div></body>',
        f'<body>{LINKS}<h1>A title</h1><p>{LONG}</p><p>The end.</p>{LINKS}</body>',
        f'<body><div class="site-header">Name of it</div>{ARTICLE}<div class="comment-list"><article class="comment"><p>{LONG} {LONG} I like it</p></article></div></body>',
    ],
)
def test_main_text(tree, page):
    assert html_text.main_text(page, tree) == WANT


def test_short_blocks_between_main_blocks(tree):
    parts = [LONG, "Part two", "One.", "And two.", "Three.", LONG]
    page = "<body>" + LINKS + "".join(f"<p>{x}</p>" for x in parts) + '<div class="share-buttons">Tell all of your friends</div></body>'
    assert html_text.main_text(page, tree) == "\n\n".join(parts)


def test_furniture_stays_out(tree):
    page = f'<body><div class="cookie-banner">We use cookies on this page of ours</div>{ARTICLE}<div class="related-posts"><p>{LONG}</p></div><aside><p>{LONG}</p></aside></body>'
    assert html_text.main_text(page, tree) == WANT
    assert html_text.main_text(f'<body><nav>{LINKS}</nav><div class="comments"><p>{LONG}</p></div></body>', tree) == ""


def test_the_tree_reads_link_density_and_neighbours(tree):
    used = set()

    def walk(node):
        if len(node) > 1:
            used.add(node[0])
            walk(node[2])
            walk(node[3])

    walk(tree)
    assert 1 in used and used & {2, 3, 4, 5}
    table = html_text.labelled_table()
    assert sum(html_text.is_main(tree, tuple(r[:-1])) != bool(r[-1]) for r in table) <= 0.03 * len(table)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><article><p>" + LONG + "<button>Like</button></p></article></body>", LONG),
        ("<body><script/>var a = 1;</script><article><p>" + LONG + "</p></article></body>", LONG),
        ("<body><svg/><article><p>" + LONG + "</p></article></body>", LONG),
        ('<body class="page has-sidebar"><article><p>' + LONG + "</p></article></body>", LONG),
        ('<body class="logged-in menu-open"><main><p>' + LONG + "</p></main></body>", LONG),
        ("<body><article><p>One.</p><p>Two words.</p><p>And three words.</p></article></body>", "One.\n\nTwo words.\n\nAnd three words."),
        ("<body><article><p>a &lt; b &amp;amp; c &eacute;</p></article></body>", "a < b &amp; c \u00e9"),
        ("<body>" + "".join(f"<div><a href=x>{LONG}</a></div>" for _ in range(3)) + f"<p>{LONG}</p><p>{LONG} too</p></body>", f"{LONG}\n\n{LONG} too"),
        ("", ""), ("<!-- " * 5000, ""), ("<p", "<p"), ('<a "' * 20000, ('<a "' * 20000)),
        ("<p>Hello world.</p>", "Hello world."), ("just bare text", "just bare text"),
        ("<body><h1>Head</h1><p>Hello world, friend.</p><p>Bye.</p></body>", "Head\n\nHello world, friend.\n\nBye."),
        (f'<article><p>{LONG} <span class="ad">buy now</span>more</p></article>', f"{LONG} more"),
        (f'<article><p>{LONG} <ins class="adsbygoogle"><b>buy</b> <ins>now</ins> x</ins> more</p><span class="promo">buy</span><p>end</p></article>', f"{LONG} more\n\nend"),
        (f'<article><header><h1>Title</h1></header><p>{LONG}</p></article>', LONG),
        (f'<article><p>{LONG} <span class="ad">never closed</p><p>{LONG}</p></article>', f"{LONG}\n\n{LONG}"),
    ],
)
def test_expected_text(tree, page, want):
    assert html_text.main_text(page, tree) == want


@pytest.mark.parametrize("part", ["<nav><article>x ", "<div>x ", "<div class=nav><article>x ", "<p><span>x", "</div><div>x "])
def test_deep_nesting_takes_no_long(tree, part):
    import time

    begin = time.perf_counter()
    html_text.main_text(part * 100_000, tree)
    html_text.main_text("<div>" * 100_000 + "</span></section>" * 100_000, tree)
    assert time.perf_counter() - begin < 10
