"""Optional end tags of head, and hint words on wrappers."""

import pytest

from prosemill.llm import html_text

WORDS = "<p>First long paragraph of prose in the page, with many words.</p><p>Second paragraph of prose follows it here.</p>"
WANT = "First long paragraph of prose in the page, with many words.\nSecond paragraph of prose follows it here."


@pytest.mark.parametrize("page", [
    f"<!doctype html><html><head><title>T</title><meta charset=utf-8><body>{WORDS}",
    f"<head><title>T</title><link rel=x><div>{WORDS}</div>",
    f"<html><head><noscript><link rel=x></noscript><style>p {{}}</style><article>{WORDS}</article></html>",
    f"<html><head><template><div>Hidden part</div></template><title>T</title></head><body>{WORDS}</body>",
    f"<head><title>T</title>\n<body><div class='layout has-sidebar'><div class=sidebar><p>Side words.</p></div>{WORDS}</div>",
    f"<body><div class='page has-header'><header>Site</header><div id='with-comments'><article>{WORDS}</article><div class=comments><p>I disagree.</p></div></div></div>",
    f"<body><article>{WORDS}</article><div class=comments><p>{'A long comment of many words. ' * 20}</p></div></body>",
])
def test_whole_article(page):
    assert html_text.main_text(page) == WANT
