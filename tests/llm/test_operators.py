"""Every numbered query against a plain version of its contract, on small tables with awkward rows and on sf0.001."""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerolake.llm import bpe, licenses, mixing, pii, sharding, simhash, token_files, topk
from aerolake.llm.registry import queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries())


def rows(spark, name: str, folder: str) -> list:
    return queries()[name](spark, folder).collect()


def by_text(spark, folder: str) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(params=["small", "sf"])
def folder(request, small) -> str:
    return small if request.param == "small" else SF


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert rows(spark, name, empty) == []


def plain_encoding() -> tiktoken.Encoding:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, folder):
    e = plain_encoding()
    want = Counter((i, len(ids := e.encode_ordinary(t)), brute.sha(",".join(map(str, ids))), brute.sha(t)) for i, t in by_text(spark, folder))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, "op1_bpe", folder))
    assert got == want


ENCODER = bpe.BpeEncoder(bpe.load_ranks(bpe.default_ranks_path()), bpe.default_pattern())
PLAIN = plain_encoding()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdefgh eonrst", max_size=300), st.text("a 0.\né", max_size=200)))
def test_transducer_on_any_text(text):
    ids = ENCODER.encode(text).tolist()
    assert ids == PLAIN.encode_ordinary(text)
    decoder = bpe.Utf8Decoder({i: t for t, i in ENCODER.ranks.items()})
    assert "".join([*(decoder.decode([i]) for i in ids), decoder.finish()]) == text


def test_transducer_window():
    """Matches far longer than the window emit as they go, with the same ids."""
    text = "abcdeabcabdeedcba" * 900
    assert ENCODER.encode(text).tolist() == PLAIN.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_decoder_on_ill_formed_bytes(data, chunk):
    decoder = bpe.Utf8Decoder({i: bytes([i]) for i in range(256)})
    parts = [decoder.decode(data[i : i + chunk]) for i in range(0, len(data), chunk)]
    assert "".join(parts) + decoder.finish() == data.decode("utf-8", "replace")


def test_pii_base(spark, folder):
    want = Counter()
    for i, t in by_text(spark, folder):
        spans = brute.base_spans(t)
        n = Counter(k for k, *_ in spans)
        want[i, n["email"], n["ip"], n["card"], n["phone"], brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))] += 1
    got = rows(spark, "op2_pii", folder)
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    for r in got:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert sum(s[0] in pii.BASE for s in spans) == r.n_email + r.n_ip + r.n_card + r.n_phone
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)


def test_pii_model_tells_candidates_apart(spark):
    """Held-out use: clear names and numbers are added, look-alikes without any support are not base spans."""
    texts = [f"Please write to ann{i} (at) example (dot) com or call Dr. Ann Miller at (555) 010-{1000 + i} today" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = Counter(s.kind for r in pii.label(docs, ["doc_id"]).collect() for s in r.spans)
    assert kinds["spelled_email"] == 40 and kinds["local_phone"] == 40
    clean = pii.redact(docs).collect()
    assert all("example" not in r.text and "[LOCAL_PHONE]" in r.text for r in clean)


def test_pii_em_finds_reliable_labelers():
    counts = [("email", (1, 1, 1, 0, 1), 900), ("email", (-1, 0, -1, 0, -1), 100), ("email", (1, 0, -1, 0, 1), 5)]
    post = pii.em(counts)
    assert post[0] > 0.9 and post[1] < 0.1
    w = pii.train([(k, v, (0, 0, 0), n) for k, v, n in counts], post)
    z = [sum(a * b for a, b in zip(w, pii.features(k, v, (0, 0, 0)), strict=True)) for k, v, _ in counts]
    assert z[0] > 0 > z[1]


def test_redact_keeps_columns_and_nulls(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == docs.count() and sum(r.text is None for r in got) == 1
    assert not any("ann.b+c@" in (r.text or "") for r in got)
    assert {(r["spans"], r["_key"]) for r in got} == {("g", "d")}


def test_mixing(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    size = lambda t: len(brute.WORD.findall(t or ""))
    sizes: dict = defaultdict(int)
    for r in table:
        sizes[r.source] += size(r.text)
    want = brute.targets(sizes)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = mixing.mix(docs).collect()
    taken: dict = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, size(r.text)) for r in table)
    for s in sizes:
        largest = max(size(r.text) for r in table if r.source == s)
        assert abs(taken[s] - want[s]) <= max(largest, 0.02 * want[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)


def test_mixing_dual(spark):
    """Rates before rounding meet the constraints and tilt with size."""
    data = [("a", s, 10) for s in range(1, 50)] + [("b", 5, 1000)]
    sizes = spark.createDataFrame(data, "source string, size long, n long")
    sources = spark.createDataFrame([("a", 12250, 490, 15000.0), ("b", 5000, 1000, 4000.0)], "source string, source_size long, n_docs long, target double")
    lam = {r.source: (r.lam, r["mean"]) for r in mixing.solve_multipliers(sizes, sources).collect()}
    for s, target in (("a", 15000.0), ("b", 4000.0)):
        rate = lambda z: 2 / (1 + np.exp(-lam[s][0] * z / lam[s][1]))  # noqa: B023, E731
        assert sum(n * z * rate(z) for x, z, n in data if x == s) == pytest.approx(target, abs=0.02)


def test_apply_mix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got, taken = mixing.apply_mix(docs), mixing.mix(docs).collect()
    assert got.columns == docs.columns
    copies = Counter()
    for r in taken:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in got.collect()) == +copies
    assert {(r["_key"], r["_h"]) for r in got.collect()} == {("d", "r")}


@pytest.mark.parametrize("law", ["rows", "key"])
def test_sharding(spark, folder, law):
    got = sharding.shard_documents(spark.read.parquet(f"{folder}/documents.parquet"), law).collect()
    want = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in by_text(spark, folder))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        counts = [len(slots.get(s, [])) for s in range(24)]
        assert max(counts) - min(counts) <= 1 and all(r.grown_shard is None for r in got)
    else:
        assert all(r.grown_shard in (r.shard, 24) for r in got)
        assert len({(r.doc_id, r.shard) for r in got if r.doc_id is not None}) == len({r.doc_id for r in got if r.doc_id is not None})


def test_ring_growth_moves_few():
    """With bounded loads one more shard moves few keys."""
    places, more = sharding.ring_places(24, 64), sharding.ring_places(25, 64)
    assert set(places) < set(more)
    assert 0 < len(more) - len(places) <= 64


def test_licenses(spark, folder):
    want = Counter((i, *brute.licenses(t)) for i, t in by_text(spark, folder))
    got = rows(spark, "op5_licenses", folder)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_notices_by_diagonal(spark):
    """A notice with words put in and left out is one span; scattered words are none."""
    words = [t for x, t in licenses.NOTICES if x == "mit"][0].split()
    changed = ["intro"] * 9 + words[:20] + ["extra", "words"] + words[20:40] + words[42:] + ["outro"]
    cases = [" ".join(words), " ".join(changed), " ".join(sorted(words)), " ".join(words[:25])]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert got == {0: "mit", 1: "mit", 2: "", 3: ""}


def test_token_files(spark, folder):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(rows(spark, "op6_token_files", folder), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    want = Counter()
    for i, text in by_text(spark, folder):
        tokens = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want[i, len(tokens), zlib.crc32(tokens.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_token_file_access(spark, small, tmp_path):
    """Sequences, masks and documents of the files; views where one batch holds them."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for part in token_files.write(docs, f"file://{tmp_path}/t", length=64).collect():
        file = token_files.TokenFile(part.file)
        total = int(file.ends[-1])
        assert total == part.n_tokens
        flat = np.concatenate([s[m] for s, m in (file.sequence(i) for i in range(-(-total // 64)))])
        assert np.array_equal(flat, file.tokens(0, total))
        for k, i in enumerate(file.doc_ids.to_pylist()):
            assert file.document(k)[-1] == 2
        assert file.sequence(0)[0].base is not None
    assert t.get_vocab_size() < 1 << 16


def test_quality(spark, folder):
    want = Counter((i, *brute.quality(t)) for i, t in by_text(spark, folder))
    got = rows(spark, "op7_fertility", folder)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_keeps_prose_and_rejects_junk(spark):
    from conftest import prose

    from aerolake.llm.quality import quality

    r = np.random.default_rng(3)  # letters between characters that only bytes can spell
    junk = [" ".join(w + "".join(chr(c) for c in r.integers(0xE000, 0xF000, 2)) for w in prose(100, s).split()) for s in range(5)]

    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([prose(100, s) for s in range(5)] + junk)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in quality(docs).filter("kept").collect()}
    assert kept == set(range(5))


def test_simhash(spark, folder):
    table = by_text(spark, folder)
    fps = [brute.fingerprint(t) for _, t in table]
    comps = brute.component_ids([i for i, _ in table], fps)
    want = Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(table, fps, comps, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows(spark, "op10_simhash", folder)) == want


@pytest.mark.parametrize("leaves", [8, 64, 4096])
def test_trie_join_against_all_pairs(spark, leaves):
    """Clusters, chains and far fingerprints; the depth at which node pairs are dealt out does not change components."""
    r = np.random.default_rng(1)
    seeds = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds[:30].tolist():
        x = s
        for _ in range(12):  # chains of up to six bits a step
            for b in r.integers(0, 64, int(r.integers(1, 7))):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {x.node: x.root for x in simhash.components(simhash.links(table, leaves=leaves)).collect()}
    want = brute.component_ids(list(range(len(fps))), fps)
    groups, wanted = defaultdict(set), defaultdict(set)
    for f, w in zip(signed, want, strict=True):
        groups[roots.get(f, f)].add(f)
        wanted[w].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_keep_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    comps = {r.component_id for r in rows(spark, "op10_simhash", small)}
    kept = got.collect()
    assert len(kept) == len(comps) and {r.doc_id for r in kept} == comps
    assert {r["_key"] for r in kept} == {"d"}


def test_top_k(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows(spark, "op9_topk", folder)}
    assert got == brute.top([r.vec_id for r in table], [r.embedding for r in table])


def test_top_k_over_blocks(spark, small):
    """Small blocks and chunks give what one block gives."""
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    q = F.pmod("vec_id", F.lit(20)) == 0
    whole = Counter(map(tuple, topk.top_k(vectors, q).collect()))
    assert whole == Counter(map(tuple, topk.top_k(vectors, q, block=16, chunk=2).collect()))
