"""Long texts full of spans in linear time, surroundings by offset, overlaps against a plain version, precision and recall of added spans."""

from __future__ import annotations

import random
import time

import brute
from pyspark.sql import functions as F

from aerolake.llm import pii


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in pii.label(docs, ["doc_id"]).collect()}


def test_a_megabyte_of_numbers(spark):
    text = "call +1 (555) 010-9999 or " * 40_000
    start = time.time()
    got = spans_of(spark, [text])[0]
    assert time.time() - start < 60
    assert [x for x in got if x[0] in pii.BASE] == [(k, a, b) for k, a, b in brute.base_spans(text)]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(docs).first().text == "call [PHONE] or " * 40_000


def test_surroundings_by_offset(spark):
    """The word before two numbers in a row is context of both."""
    text = "phone +1 555 010 9999, +1 555 010 9998. " + "x" * 600 + " mail a@b.com"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    votes = {s.start: s.votes.context for s in pii.candidates(docs, ["doc_id"]).first().spans}
    assert votes[6] == 1 and votes[23] == 1


def test_running_against_a_loop(spark):
    r = random.Random(1)
    lists = [[r.randrange(100) for _ in range(n)] for n in (0, 1, 127, 128, 129, 1000)]
    df = spark.createDataFrame([(x,) for x in lists], "v array<bigint>")
    got = [x.s for x in df.select(pii.running(F.col("v"), 0, lambda a, b: a + b).alias("s")).collect()]
    assert got == [[sum(x[:i]) for i in range(len(x))] for x in lists]


def test_redact_against_a_loop(spark):
    r = random.Random(2)
    bits = ["ann@example.com", "10.2.3.4", "+1 (555) 010-9999", "4111 1111 1111 1111", "Dr. Ann Miller", "é👍 word", "x" * 700, "\n"]
    texts = [" ".join(r.choice(bits) for _ in range(n)) for n in (1, 5, 40, 200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {x.doc_id: x.spans for x in pii.label(docs, ["doc_id"]).collect()}
    for row in pii.redact(docs).collect():
        text, at, out = texts[row.doc_id], 0, ""
        for s in spans[row.doc_id]:
            if s.start >= at:
                out += text[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.stop)
        assert row.text == out + text[at:]


#: (text, what is personal or secret in it beyond the base kinds), labelled by hand.
LABELLED = [
    ("Please wire the fee to IBAN DE89 3704 0044 0532 0130 00 today.", "DE89 3704 0044 0532 0130 00"),
    ("Our account is GB82 WEST 1234 5698 7654 32 at the bank.", "GB82 WEST 1234 5698 7654 32"),
    ("Part number DE00 0000 0000 0000 0000 00 is out of stock.", None),
    ("Order code AB12 3456 7890 1234 5678 90 shipped.", None),
    ("You can reach Dr. Anna Schmidt in the clinic.", "Dr. Anna Schmidt"),
    ("A letter from Mr. Peter Brown arrived.", "Mr. Peter Brown"),
    ("We drank a Dr. Pepper Zero at noon.", None),
    ("She wore Dr. Martens all week.", None),
    ('config: token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" for the job', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    ("the secret key: Zx81kQpLm93TtuVw02sYb4Rc is old", "Zx81kQpLm93TtuVw02sYb4Rc"),
    ("see chapter-12-of-the-very-long-handbook for more", None),
    ("call 555-010-9999 after six", "555-010-9999"),
    ("phone (555) 010-9998 now", "(555) 010-9998"),
    ("write to ann (at) example (dot) com soon", "ann (at) example (dot) com"),
    ("her SSN 078-05-1120 leaked", "078-05-1120"),
    ("lot 000-00-0000 was void", None),
]


def test_precision_and_recall_of_added_spans(spark):
    got = spans_of(spark, [t for t, _ in LABELLED] + ["mail ann@example.com, call +1 555 010 9999 from 83.229.25.121 " + "word " * 20] * 100)
    right = wrong = missed = 0
    for i, (text, want) in enumerate(LABELLED):
        added = {text[a:b] for k, a, b in got[i] if k in pii.ADDED}
        right += want in added
        missed += want is not None and want not in added
        wrong += len(added - {want})
    assert right / (right + wrong) >= 0.8 and right / (right + missed) >= 0.9, (right, wrong, missed)
