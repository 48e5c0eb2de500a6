"""Bands of the quality rules: what they reject that the base rules let pass."""

from __future__ import annotations

import random

from conftest import prose

from aerolake.llm.quality import quality

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(LETTERS) for _ in range(7)) for _ in range(200))


def test_random_letters_fail_without_labels(spark):
    docs = spark.createDataFrame([(1, letters(1), "en"), (2, letters(2), None), (3, prose(100, 3), "en")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in quality(docs).filter("kept").collect()} == {3}


def test_bands_follow_the_labels(spark):
    """Suffixed words lie between junk and prose of other tables; this table's good rows put the floor above them."""
    junk = [" ".join(w + ("###", "$$$", "%%%")[i % 3] for i, w in enumerate(prose(200, s).split())) for s in range(1000, 1020)]
    rows = [(i, prose(200, i), "en") for i in range(200)] + [(1000 + i, t, "en") for i, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in rows], "doc_id long, quality int")
    kept = {r.doc_id for r in quality(docs, labels).filter("kept").collect()}
    assert len([i for i in kept if i < 1000]) >= 190
    assert not [i for i in kept if i >= 1000]
