"""Long pages: labels depend on the whole page."""

from __future__ import annotations

import numpy as np

from aerolake.llm.html_blocks import blocks, vectors
from aerolake.llm.html_extraction import HIDDEN, Labeller


def remembering() -> Labeller:
    """Untrained weights that forget next to nothing."""
    model = Labeller.new(3)
    for k in ("ahead", "back"):
        model.w[k][-1, HIDDEN : 2 * HIDDEN] = 9
    return model


def test_chunks_equal_one_pass():
    page = "".join(f"<{('p', 'div', 'li', 'h2')[i * i % 4]}>" + f"word{i % 37} text{i % 11} " * (i % 9 + 1) for i in range(1700))
    found, model = blocks("<header>Top</header>" + page), remembering()
    want = model.logits([vectors(found)])[0]
    got, other = model.label([found, found[:40]])
    assert 0 < want[want > 0].size < want.size
    clear = np.abs(want) > 1e-3  # rounding may differ
    assert len(got) == len(found) and clear.mean() > 0.9 and (got == (want > 0))[clear].all()
    assert (other == (model.logits([vectors(found[:40])])[0] > 0)).all()
