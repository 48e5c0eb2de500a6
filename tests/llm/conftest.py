"""Small tables with every awkward case: nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the river station measured wind and ozone over old town while people walked near water every morning before work began again in spring".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.3) for _ in range(n))


TEXTS = [
    prose(80, 1),
    prose(80, 1),
    prose(80, 1) + " tail",
    prose(4000, 2),
    None,
    "",
    " \n\t ",
    "one",
    "Loop loop loop " * 60,
    "line a b c d e\nline a b c d e\n\n  \nline a b c d e " + prose(60, 3),
    "Mail ann.b+c@ex-ample.co.uk, card 4111 1111 1111 1111 and 4111-1111-1111-1112; call +1 (555) 010-9999. ip 10.0.0.255 or 300.1.1.1.9.8.7",
    "a@b a@b.c@d.e 1.2.3.4.5 ++49 30 1234567 +1 é👍 x@y.z 5500005555555559 0 1-2",
    "Licensed CC BY and cc-by; GENERAL public License. All rights reserved, all Rights  reserved cc\nby generalized public license",
    "Größe naïve 東京 タワー привет мир 👩‍👩‍👧 ﷺ  nbsp em \x00nul" + " word" * 70,
    "x" * 30000 + " " + "ab " * 3000,
    "a%b <c> $d *e* #f | & tail " * 30,
    "  two  spaces \n\n\n newline\r\n tab\t end  ",
    "don't we'll I'M <|endoftext|> 1234567 ...!!!\n\n",
]


def document_rows() -> dict[str, list]:
    texts = TEXTS + [TEXTS[0], TEXTS[10]]
    ids = [*range(1, len(TEXTS) + 1), 1, None]
    n = len(texts)
    sources = [("web", "books", None, "ünï", "code")[i % 5] for i in range(n)]
    langs = [("en", "de", None, "xx")[i % 4] for i in range(n)]
    return {"doc_id": ids, "text": texts, "lang": langs, "source": sources, "n_chars": [None if t is None else len(t) for t in texts]}


def embedding_rows() -> dict[str, list]:
    r = random.Random(5)
    vectors: list = [[r.gauss(0, 1) for _ in range(16)] for _ in range(130)]
    vectors[7] = None
    vectors[20] = [None] + [1.0] * 15
    vectors[9] = [float("nan")] + [1.0] * 15
    vectors[10] = [float("inf")] + [1.0] * 15
    vectors[11] = []
    for i in range(60, 100):
        vectors[i] = vectors[60]
    ids = [*range(len(vectors) - 1), None]
    return {"vec_id": ids, "embedding": vectors, "label": [i % 3 for i in range(len(vectors))]}


CLASHING = {"size": "a", "ids": "b", "fp": "c", "_key": "d", "shard": "e", "kept": "f", "spans": "g", "rank": "h", "_w": "i", "hash": "j", "b": "k", "c": "l", "v": "m", "_q": "n", "start": "o", "target": "p", "_t": "q", "_h": "r"}

SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]),
    "embeddings": pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())]),
}

PAGES = {
    "page_id": [1, 2, 3, None, 5],
    "url": ["u1", None, "u3", "u4", "u5"],
    "html": [None, "", "no markup at all", "<p>broken <b>tag &amp; &#x41;<script>x<1</script>", "<html><body><nav><a href=/>Home</a></nav></body></html>"],
}


def _save(folder, rows: dict[str, dict[str, list]], extra: dict[str, str]) -> str:
    for name, schema in SCHEMAS.items():
        table = pa.table(rows.get(name) or {f: [] for f in schema.names}, schema=schema)
        for column, value in extra.items():
            table = table.append_column(column, pa.array([value] * table.num_rows, pa.string()))
        pq.write_table(table, f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def small(tmp_path_factory) -> str:
    rows = {"documents": document_rows(), "embeddings": embedding_rows(), "pages": PAGES}
    return _save(tmp_path_factory.mktemp("small"), rows, CLASHING)


@pytest.fixture(scope="session")
def empty(tmp_path_factory) -> str:
    return _save(tmp_path_factory.mktemp("empty"), {}, CLASHING)


@pytest.fixture(scope="session")
def docs() -> list[tuple]:
    """(doc_id, text) as stored."""
    rows = document_rows()
    return list(zip(rows["doc_id"], rows["text"], strict=True))
