"""Main text of pages: held-out accuracy of the labeller on made pages, and the blocks' own rules."""

from __future__ import annotations

import numpy as np
import pytest

from aerolake.llm.html_blocks import DIM, blocks
from aerolake.llm.html_extraction import Lstm, PageGrammar, extract, main_text, trained


def test_held_out_accuracy():
    """Pages from a seed that training never saw, with words it never saw."""
    grammar, model = PageGrammar(987), trained()
    right = total = 0
    for found, labels in (grammar.sample() for _ in range(150)):
        if found:
            right += int((model.label([found])[0] == labels).sum())
            total += len(labels)
    assert right / total > 0.97


def texts(page: str) -> list[str]:
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; &lt;b&gt; &#x41;&nbsp;x", ["plain & <b> A x"]),
        ("<p>a <b>b</b>\n c<br>d<p>e", ["a b c d", "e"]),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><p>yes<!-- no --></p>", ["yes"]),
        ("<ul><li>one<li>two</ul>tail", ["one", "two", "tail"]),
        ("<p title='a>b'>x</p></div></p>1 < 2", ["x", "1 < 2"]),
        ("<template><p>no</p></template><textarea><p>no</textarea><p>yes", ["yes"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_long_pages():
    """A very long page is labelled as a short one is."""
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>" + "<p>The river station measured wind and ozone over the old town.</p>" * 2000 + "</article><footer>&copy; us</footer></body></html>"
    found = blocks(page)
    got = trained().label([found])[0]
    assert got[1:-1].mean() > 0.99 and not got[0] and not got[-1]


def test_lstm_gradient():
    """Back-propagation agrees with finite differences, masked steps included."""
    r = np.random.default_rng(0)
    t, n, hidden = 5, 3, 4
    w, x, pull = r.normal(0, 0.3, (DIM + hidden + 1, 4 * hidden)), r.normal(0, 1, (t, n, DIM)), r.normal(0, 1, (t, n, hidden))
    mask = np.ones((t, n))
    mask[3:, 1] = 0
    loss = lambda w: float((Lstm.forward(w, x, mask) * pull).sum())
    _, saved = Lstm.forward(w, x, mask, True)
    grad = Lstm.backward(w, x, mask, saved, pull)
    for i, j in zip(r.integers(0, len(w), 40), r.integers(0, w.shape[1], 40), strict=True):
        step = np.zeros_like(w)
        step[i, j] = 1e-2
        assert grad[i, j] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-2, abs=2e-3)


def test_extract_on_awkward_pages(spark, small):
    got = {(r.page_id, r.url): r for r in extract(spark.read.parquet(f"{small}/pages.parquet")).collect()}
    assert len(got) == 5
    assert got[1, "u1"].text == "" and got[2, None].text == "" and got[5, "u5"].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_main_text_joins_blocks():
    found = blocks("<p>a<p>b<p>c")
    assert main_text(found, [True, False, True]) == "a\nc"
