"""Pages of a megabyte that would send a backtracking parser round and round."""

from __future__ import annotations

import time

import pytest

from aerolake.llm.html_blocks import blocks
from aerolake.llm.html_extraction import trained

N = 1 << 20
HOSTILE = {
    "tag without end": "<" + "a" * N,
    "tags without end": "<p " * (N // 3),
    "open quotes": '<p class="' * (N // 10),
    "stray quotes": "<p x'\"y>" * (N // 8),
    "cdata": "<![CDATA[" * (N // 9),
    "comments": "<!-- <" * (N // 6),
    "less-than": "<" * N,
    "nested blocks": "<div>t" * (N // 6),
    "closing tags": "<div>" * 4000 + "</p></b>" * (N // 8),
    "nested inline": "<b>" * 4000 + "<hr>x</i>" * (N // 9),
    "attributes": "<p " + "a=b " * (N // 4) + ">t",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_linear_time(name):
    start = time.time()
    found = blocks(HOSTILE[name])
    assert time.time() - start < 6, name
    if found and len(found) < 5000:
        trained().label([found])


def test_browser_rules():
    text = lambda page: [b.text for b in blocks(page)]
    assert text("<p>a<!-->b<p>c<!--x--!>d") == ["ab", "cd"]
    assert text("<p title=\"a>b\" class=c\">one</p>two") == ["one", "two"]
    assert text("<p>a</ p>b</>c") == ["abc"]
    assert text("<p>a < b & c &lt;p&gt;") == ["a < b & c <p>"]
    assert text("<noscript><p>shown</p></noscript><object>too</object><select><option>not</select>") == ["shown", "too"]
    assert text("<b><div>in</div></b>out") == ["in", "out"]
    assert text("<p>a<p class=x") == ["a"]
