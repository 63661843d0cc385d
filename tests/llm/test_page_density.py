"""Density decides: pages without telling tags or names, names that only look like furniture, and hostile pages."""

import re
import time

import duckdb
import pytest

from prosemill.llm import html_text

PROSE = [f"Paragraph {k} of prose with a number of words, commas, and more to make it long enough to matter." for k in range(12)]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)


@pytest.mark.parametrize("attribute", [
    'class="layout has-sidebar"', 'class="post comment-enabled"', 'class="page no-share"', 'class="ad-free content"', 'id="notice-of-award"',
    'aria-hidden="false"', 'data-hidden="false"', 'id="discussion"', 'class="thread"', 'class="the-text inline"', 'class="shared-memory"', 'id="adder"', 'class="more in-depth"', 'title="the hidden valley"', "title='class=\"ad\" hidden'",
])
def test_names_that_only_look_like_furniture(attribute):
    for inside in (f"<article>{BODY}</article>", BODY):
        page = f"<body><nav><a href=/>Home</a></nav><div {attribute}>{inside}</div><footer>x</footer></body>"
        assert html_text.main_text(page).split("\n") == PROSE
    assert html_text.main_text(f"<article>{BODY}<p {attribute}>One more.</p></article>").split("\n") == [*PROSE, "One more."]


@pytest.mark.parametrize("name", [
    "ad", "sidebar", "site-footer", "cookie-notice", "commentList", "main-nav", "ad_box", "disqus_thread", "share-this", "adsbygoogle", "social-share-buttons", "ad-slot-3 leaderboard-ad",
    "newsletter-signup", "jp-relatedposts", "sharedaddy", "fb-comments", "comment-42", "taboola-below-article x-taboola", "sticky-ad-mobile", "follow-us share-bar", "reader-comments",
])
def test_furniture_by_name(name):
    inner = f"<div class='x {name}' id='{name.split()[-1]}'><p>Words of it, quite a few of them, one after the other.</p></div>"
    assert html_text.main_text(f"<body><article>{BODY}{inner}</article>{inner}</body>").split("\n") == PROSE


def test_pages_without_names_or_tags(sf_dir):
    """The article's text is found where nothing but density tells it; a constant density finds another."""
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{sf_dir}/pages.parquet' ORDER BY page_id").fetchall()]
    want = [html_text.main_text(p) for p in pages]
    bare = [re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", p.replace(' class="ad"', "")) for p in pages]
    found = sum(a == html_text.main_text(b) for a, b in zip(want, bare))
    assert found >= 0.8 * len(pages)
    real = html_text.composite_density
    html_text.composite_density = lambda *_: 1.0
    try:
        assert sum(a == html_text.main_text(b) for a, b in zip(want, bare)) < 0.5 * found
    finally:
        html_text.composite_density = real


def test_link_blocks_inside_and_headings_before():
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Other page {i}</a></li>" for i in range(9)) + "</ul></div>"
    page = f"<body><h1>Title</h1><div><div>{BODY}{menu}<p>See <a href=/x>this page</a>.</p></div></div></body>"
    assert html_text.main_text(page).split("\n") == ["Title", *PROSE, "See this page."]
    sections = "".join(f"<section><h2>Part {i}</h2>{BODY}</section>" for i in range(3))
    assert html_text.main_text(f"<body><div>{sections}</div></body>").split("\n") == [x for i in range(3) for x in (f"Part {i}", *PROSE)]


@pytest.mark.parametrize("page", [
    "<a " * 300000 + '"', '<a href="x' * 100000, "<div>" * 8000 + "</b>" * 80000 + "</p>" * 80000, "<b><div>" + "<span>" * 80000 + "</b>" * 80000,
    "<" * 1000000, "<p>" * 300000, "<head><template>" + "<b>x" * 100000, "<p " + 'a="' * 300000, "<p " + "=   '" * 200000, "<!--" * 200000,
    "<p class='" + "a " * 400000 + "'>x",
])
def test_hostile_pages_of_about_a_megabyte(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 30
