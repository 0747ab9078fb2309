"""Pages that are not well formed: nothing of the article is lost, no markup becomes text, nesting costs nothing."""

import time

from voxsift.llm.html_extraction import blocks_of


def texts(page):
    return [b.text for b in blocks_of(page)]


def test_raw_elements_that_are_not_closed():
    for raw in ("<svg width=1/>", "<svg/>", "<iframe src=x />", "<iframe src=x>", "<button>", "<select>", "<title/>", "<template>", "<noscript>"):
        assert "After." in texts(f"<article><p>Before.</p>{raw}<p>After.</p></article>"), raw
    assert texts("<p>Before.</p><script>var x = 1;<p>After.</p>") == ["Before."]
    assert texts("<p>a</p><svg><text>b</text></svg><button>c</button><p>d</p>") == ["a", "d"]


def test_quotes_in_tags():
    assert texts("<p title=it's>One</p><p>It's</p>") == ["One", "It's"]
    assert texts('<p title="a > b">One</p>') == ["One"]
    assert texts("<p title='x\">y'>One</p><p a=\"never closed>Two</p>") == ["One", "Two"]
    assert texts("<p>1 < 2 and 3 > 2</p>") == ["1 < 2 and 3 > 2"]


def test_names_above_a_block():
    block = blocks_of('<div class="main story"><ul><li id=first>Text')[0]
    assert (block.own, block.tags, block.names) == ("li", {"div", "ul", "li"}, {"main", "story", "first"})


def test_paragraphs_end_where_the_next_begins():
    found = blocks_of("<div><p>a<p>b<div>c</div></div>d")
    assert [(b.text, b.own) for b in found] == [("a", "p"), ("b", "p"), ("c", "div"), ("d", "")]


def test_deep_nesting_is_linear():
    def took(n):
        page = "<div>x" * n + "<span>" * n + "<p>y</p>" * n
        began = time.perf_counter()
        assert len(blocks_of(page)) == 2 * n
        return time.perf_counter() - began

    took(2000)
    assert took(40_000) < 40 * max(took(4_000), 0.01)


def test_null_and_empty_pages():
    assert blocks_of(None) == blocks_of("") == blocks_of("<br><img>") == []
