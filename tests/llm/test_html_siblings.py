"""The share of equal tags among siblings, on both sides of fifty children."""

import pytest

from monthspine.llm import html_text as H


@pytest.mark.parametrize("n", [20, 80])
def test_share_of_equal_tags(n):
    page = "<html><body><div>" + "<p>one two three</p><h2>four five</h2>" * (n // 2) + "</div></body></html>"
    nodes = H.parse(page)
    at = H.FEATURES.index("same_tag_siblings")
    shares = [row[at] for node, row in zip(nodes, H.features(nodes)) if node.tag in ("p", "h2")]
    assert len(shares) == n and shares == pytest.approx([0.5] * n)


def test_unended_tags_take_linear_time():
    import time

    from monthspine.llm.html_text import parse

    for page in ("<a " * 340_000, "<a '" * 260_000, "<p>x</p>" + "< a<b" * 200_000):
        t = time.process_time()
        parse(page)
        assert time.process_time() - t < 2
    assert [x for _, x in parse("<p>a</p>b <i")[0].texts if x] == ["b <i"]
    assert [x for _, x in parse("<p>a</p>b <!-- c")[0].texts if x] == ["b "]
