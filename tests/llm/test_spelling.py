"""Spelling variants against plain loops over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerolake.llm import spelling
from tests.llm.conftest import document_rows


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def counted(docs) -> Counter:
    seen: Counter = Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    return seen


def brute(n: dict[str, int]) -> list[tuple]:
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def brute_docs(docs) -> list[tuple]:
    return brute({w: c for w, c in counted(docs).items() if len(w) >= 5 and c >= 3})


def rows(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def noisy(seed: int, n: int) -> list[tuple[int | None, str | None]]:
    """Texts of words with chains of variants, of falling counts."""
    r = random.Random(seed)
    stems = ["station", "measure", "ozonés", "ÿüßtéw", "windows", "straße", "aaaaaa", "ababab"]

    def word() -> str:
        w = r.choice(stems)
        for _ in range(min(3, int(r.expovariate(1.3)))):
            i, c = r.randrange(len(w)), r.choice("abàÿst")
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])
        return w.upper() if r.random() < 0.1 else w

    return [(i, " ".join(word() for _ in range(r.randrange(200))) + r.choice(["", "...", "\n×÷ 7"])) for i in range(n)]


def test_noisy_texts(spark, tmp_path):
    docs = noisy(1, 120)
    docs += [docs[5], (None, docs[6][1]), (900, None), (901, ""), (902, "einzig " * 30000)]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())}), f"{tmp_path}/documents.parquet")
    got = spelling.op13_spelling(spark, str(tmp_path))
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    want = brute_docs(docs)
    assert rows(got) == want
    assert sum(r[1] is not None and r[2] != r[1] for r in want) > 5  # chains of forms


def test_defined_cases(spark, small):
    r = document_rows()
    assert rows(spelling.op13_spelling(spark, small)) == brute_docs(list(zip(r["doc_id"], r["text"], strict=True)))


def test_long_chain_and_ties(spark):
    """A chain of nine forms; two near words of equal count."""
    n = {"aaaaa" + "b" * i: 3 * 2 ** (9 - i) for i in range(10)} | {"zzzzy": 8, "zzzzx": 8, "zzzzz": 4, "zzzz": 1}
    got = rows(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n)
    assert dict((w, r) for w, _, r, *_ in got)["aaaaabbbbbbbbb"] == "aaaaa"


def test_one_symbol_and_many(spark):
    """Any reduced alphabet gives the same pairs."""
    n = {w: c for w, c in counted(noisy(2, 60)).items() if len(w) >= 5}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    want = sorted((a, b) for a in n for b in n if one_edit(a, b))
    for symbols in ("a", "ab", spelling.SYMBOLS):
        assert sorted((r[0], r[1]) for r in spelling.near_words(table, symbols).select("word", "near").collect()) == want


def test_empty(spark, empty):
    assert spelling.op13_spelling(spark, empty).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=12, unique=True))
def test_neighbourhood_covers_one_edit(spark, words):
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", spelling.reduced(F.col("w")).alias("s"), spelling.neighbourhood(spelling.reduced(F.col("w"))).alias("x")).collect()
    s = {r.w: r.s for r in got}
    for r in got:
        assert len(set(r.x)) == len(r.x)
        assert all(x == r.s or one_edit(x, r.s) for x in r.x)
        assert all(s[w] in r.x for w in words if w == r.w or one_edit(w, r.w))
