"""License labels by what was done to a notice, and spans that must not count."""

from __future__ import annotations

import random
import re

import pytest

from aerolake.llm import licenses


def labels(spark, cases: list[str]) -> list[set[str]]:
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {x.doc_id: set(filter(None, x.labels.split(","))) for x in licenses.scan(docs).collect()}
    return [got[i] for i in range(len(cases))]


def words_of(text: str) -> list[str]:
    return re.findall(licenses.WORD, text)


#: A word put in or left out breaks up to five runs of five words, which must leave the share of a notice that counts.
LONG = [(label, words_of(text)) for label, text in licenses.NOTICES if len(words_of(text)) >= 17]


@pytest.mark.parametrize("kind", ["in", "out", "other"])
def test_one_word_at_every_place(spark, kind):
    """A notice keeps its label with one word put in, left out or changed, wherever."""
    cases = []
    for label, words in LONG:
        for i in range(len(words)):
            cases.append((label, words[:i] + (["zzz"] if kind != "out" else []) + words[i + (kind != "in") :]))
    got = labels(spark, [" ".join(w) for _, w in cases])
    assert [(label, i) for i, (label, _) in enumerate(cases) if label not in got[i]] == []


def test_several_changes_and_moved_parts(spark):
    """Words put in here and there, openings before and endings behind, and other texts around."""
    r = random.Random(5)
    cases = []
    for label, words in ((x, w) for x, w in LONG if len(w) >= 60):
        some = list(words)
        for at in sorted(r.sample(range(0, len(words), 15), 3), reverse=True):
            some[at:at] = ["put"] * r.randrange(1, licenses.NEAR)
        cases += [(label, some), (label, words[-12:] + words + words[:12]), (label, words[:9] * 3 + ["x"] * 40 + words + ["y"] * 9 + words[20:40])]
    got = labels(spark, ["intro words " * 20 + " ".join(w) + " outro" * 9 for _, w in cases])
    assert [(label, i) for i, (label, _) in enumerate(cases) if label not in got[i]] == []
    apache = next(t for x, t in licenses.NOTICES if x == "apache-2.0")
    assert labels(spark, ["apache license version 2.0 " + apache + " licensed under the apache license"])[0] >= {"apache-2.0"}


def test_whole_and_half_notices(spark):
    """Every notice has its label; of long ones the words in disorder, and less than half of them, have none of theirs."""
    assert all(label in got for (label, _), got in zip(licenses.NOTICES, labels(spark, [t for _, t in licenses.NOTICES]), strict=True))
    r = random.Random(2)
    alone = [x for x, _ in licenses.NOTICES]
    cases = [(label, w) for label, w in LONG if alone.count(label) == 1 and len(w) >= 40]
    halves = labels(spark, [" ".join(w[: len(w) * 2 // 5]) for _, w in cases])
    mixed = labels(spark, [" ".join(x for i in r.sample(range(0, len(w), 6), len(range(0, len(w), 6))) for x in w[i : i + 6]) for _, w in cases])
    assert len(cases) > 2 and not any(label in got for (label, _), got in zip(cases, halves, strict=True))
    assert not any(label in got for (label, _), got in zip(cases, mixed, strict=True))


def test_repeated_openings_count_once(spark):
    cases = ["this work is licensed under " * 5, "redistribution and use in source " * 40, "Released under the MIT License. " * 3]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {x.doc_id: x.labels for x in licenses.scan(docs).collect()} == {0: "", 1: "", 2: "mit"}
