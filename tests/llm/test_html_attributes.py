"""Attributes of elements: what stands in a value is no name."""

import pytest

from faultline.llm import html_text


@pytest.mark.parametrize("attributes, furniture", [
    ("style=\"overflow: hidden\"", False), ("title=\"the hidden cost\"", False), ("style='overflow: hidden' class=text", False),
    ("title=' class=nav id=menu role=banner'", False), ("data-x=\"it's hidden \"", False), ("data-hidden", False),
    ("hidden", True), ("HIDDEN=\"\"", True), ("title=x hidden", True), ("title=\"x\"hidden", True), ("aria-hidden=true", True),
    ("aria-hidden = 'false'", False), ("title='a' class = 'nav'", True), ("title='>' id=menu", True), ("role=banner", True),
])
def test_attributes(attributes, furniture):
    got = [t for t, _ in html_text.parsed(f"<body><div {attributes}><p>one</div><p>two")[0]]
    assert got == (["two"] if furniture else ["one", "two"])


def test_an_article_that_clips_its_overflow():
    page = "<div style=\"clear: both; overflow: hidden\"><article style=\"overflow: hidden\"><p>a<p title='the hidden cost'>b</article></div>"
    assert [t for t, _ in html_text.parsed(page)[0]] == ["a", "b"]
