"""All words of a block are read."""

from __future__ import annotations

import numpy as np

from aerolake.llm.html_blocks import PATH_DIM, WORD_DIM, blocks, vectors


def test_words_after_the_first_count():
    head = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    a, b = vectors(blocks(f"<p>{head}{'the river rose in spring ' * 30}.<p>{head}{'accept all cookies and adverts ' * 30}."))
    words = slice(PATH_DIM, PATH_DIM + WORD_DIM)
    assert np.abs(a[words] - b[words]).max() > 0.1


def test_sizes_beyond_a_thousand_differ():
    a, b = vectors(blocks(f"<p>{'word ' * 300}<p>{'word ' * 3000}"))
    assert (a != b)[-8] and (a != b)[-7]
