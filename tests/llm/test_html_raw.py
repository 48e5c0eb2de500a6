"""Raw elements end at their end tag, whatever they hold."""

from __future__ import annotations

import pytest

from aerolake.llm.html_blocks import blocks


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<script>for(i=0;i<n;i++){f(i)}</script><article><p>Text</article>", ["Text"]),
        ("<script><!-- old </script><p>Text", ["Text"]),
        ("<script>if(a<b)s='it is</script><p>Text<p>it's", ["Text", "it's"]),
        ("<style>a>b{content:'<x'}</style ><p>Text", ["Text"]),
        ("<SCRIPT>'</scripty>' <p>no</SCRIPT\n><p>Text", ["Text"]),
        ("<head><title>a <b c</title></head><body><textarea><p>no</textarea>Text", ["Text"]),
        ("a<p>b<script>never ends <p>no", ["a", "b"]),
    ],
)
def test_raw_elements(page, want):
    assert [b.text for b in blocks(page)] == want
