"""Quality rules from tokeniser fertility: characters per token, byte-fallback share and token entropy, with bands.

Each word is encoded on its own by two public vocabularies, one of pieces with byte fallback and one of byte-level merges for many
languages. Text that a vocabulary knows takes few tokens a character, next to no bytes, and spreads over many tokens; markup,
codes, foreign bytes and loops do not. A byte token is a fallback byte in the first and bytes that are no text by themselves in the second.
A document outside the band of its language (of its script, where the language has none) by either vocabulary is rejected, and so is
one that fails the base rules: under 50 words, or more than half of its words in 3-word windows found twice or more.

Bands come from the table's own labels: over all rows that a label calls good and the base rules pass, ``SHARE`` and 1 - ``SHARE``
quantiles of each language within a script, and of each script, with ``LEAST`` such rows or more. ``BANDS`` serve where labels are too few
or missing: their floors for Latin script follow the 3,243 good rows of sf0.1; no labelled rows of other scripts exist.

Entropy grows with length, so it is measured against the most a text of that many tokens can have: entropy / log2(tokens).

Defined cases: null and empty texts have no words and fail; very long texts are measured whole; equal rows give equal rows; an
empty table gives an empty table; columns named like an output column (in any case) are replaced, all others are kept. A null or
unknown language uses the script's band.
"""

from __future__ import annotations

import base64
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolake.llm.common import map_batches, materialise, read_table, text_or_empty, worker_state
from aerolake.llm.units import Memo

MODEL_FILE, RANK_FILE = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
MIN_WORDS = 50
#: Bytes of a generation of a worker's memo of words; a bound on memory only.
MEMO_BYTES = 48 << 20

#: Share of good rows below a floor or above a ceiling, and good rows that a fitted band needs.
SHARE, LEAST = 0.002, 100
#: Byte tokens that a fitted ceiling always allows: good rows without any would forbid a single emoji.
SOME_BYTES = 0.02

#: For each vocabulary: least and most characters per token, most byte share, least relative entropy. Keys: languages, then
#: scripts; fitted bands have keys "language/script" besides.
Band = tuple[float, float, float, float, float, float, float, float]
BANDS: dict[str, Band] = {
    "en": (2.06, 6.0, 0.10, 0.35, 2.06, 6.0, 0.15, 0.35),
    "de": (2.08, 6.0, 0.10, 0.35, 2.12, 6.0, 0.15, 0.35),
    "es": (1.79, 6.0, 0.10, 0.35, 1.90, 6.0, 0.15, 0.35),
    "fr": (1.82, 6.0, 0.10, 0.35, 1.88, 6.0, 0.15, 0.35),
    "latin": (1.75, 6.0, 0.15, 0.35, 1.80, 6.0, 0.20, 0.35),
    "cyrillic": (1.0, 7.0, 0.15, 0.35, 0.8, 7.0, 0.30, 0.30),
    "greek": (0.6, 6.0, 0.50, 0.30, 0.5, 6.0, 0.60, 0.30),
    "cjk": (0.25, 3.0, 0.90, 0.25, 0.25, 3.0, 0.95, 0.25),
    "other": (0.2, 8.0, 0.98, 0.20, 0.2, 8.0, 0.98, 0.20),
}
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_SCRIPTS = ((0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x1E00, 0x1EFF, "latin"), (0x3040, 0x30FF, "cjk"), (0x3400, 0x9FFF, "cjk"), (0xAC00, 0xD7AF, "cjk"))

#: Measures of each vocabulary, in the order of a band's numbers; those of the second bear a 2.
MEASURES = ("chars_per_token", "byte_share", "entropy")
FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    *(T.StructField(n + v, T.LongType() if n == "n_tokens" else T.DoubleType()) for v in ("", "2") for n in ("n_tokens", *MEASURES)),
    T.StructField("script", T.StringType()),
]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(MODEL_FILE), public_tokenizers.path(RANK_FILE)


class Fertility:
    """Tokens of words by both vocabularies, remembered from text to text."""

    def __init__(self, model_path: str, ranks_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.first = self.model.get_piece_size()  # ids of the second vocabulary come after these: its ranks keep their order
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) + self.first for a, b in map(bytes.split, f)}
        self.merges = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo = Memo(MEMO_BYTES)
        self.bytes = np.zeros(max(ranks.values()) + 1, bool)
        self.bytes[: self.first] = [self.model.is_byte(i) for i in range(self.first)]
        for token, rank in ranks.items():
            self.bytes[rank] = "\ufffd" in token.decode("utf-8", "replace")

    def _encode(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        merged = map(self.merges.encode_ordinary, [" " + t for t in texts])
        return [array("i", a + b).tobytes() for a, b in zip(self.model.encode(texts, num_threads=1), merged, strict=True)]

    def measure(self, words: list[bytes], chars: int) -> list[float]:
        """Tokens, characters per token, share of byte tokens and relative entropy by each vocabulary."""
        ids = np.frombuffer(b"".join(self.memo.many(words, self._encode)), np.int32)
        every, out = np.bincount(ids, minlength=len(self.bytes)), []
        for part in (slice(0, self.first), slice(self.first, None)):
            counts = every[part]
            n = int(counts.sum())
            if not n:
                out += [0, 0.0, 0.0, 0.0]
                continue
            p = counts[counts > 0] / n
            out += [n, chars / n, float(counts[self.bytes[part]].sum() / n), float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 0.0]
        return out


def script_of(text: str) -> str:
    """The script of most letters."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    seen: Counter[str] = Counter()
    for low, high, name in _SCRIPTS:
        seen[name] += int(((points >= low) & (points <= high)).sum())
    seen["other"] = int((points > 0x024F).sum()) - sum(int(((points >= a) & (points <= b)).sum()) for a, b, _ in _SCRIPTS if a > 0x024F)
    name, n = max(seen.items(), key=lambda x: x[1])
    return name if n else "other"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    inside = np.zeros(len(words) + 1, bool)
    at = np.fromiter((i for i, w in enumerate(windows) if counts[w] > 1), np.int64)
    for k in range(3):
        inside[at + k] = True
    return int(inside.sum())


def measures(text: str, fertility: Fertility) -> tuple:
    data = text.encode("utf-8", "replace")
    words = data.split()  # bytes split at \x20 and \x09-\x0d only
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, _WHITE))
    return len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), *fertility.measure(words, chars), script_of(text)


def measure(docs: DataFrame, text_col: str = "text", paths: tuple[str, str] | None = None, keep_text: bool = False) -> DataFrame:
    """Append all measures to docs. ``paths``: the vocabularies' files, on every machine."""

    def task():
        where = paths or default_paths()
        fertility = worker_state(("fertility", *where), lambda: Fertility(*where))

        def call(batch: pa.RecordBatch) -> dict:
            rows = [measures(t.as_py() or "", fertility) for t in batch.column(batch.schema.get_field_index(text_col))]
            return dict(zip((f.name for f in FIELDS), map(list, zip(*rows, strict=True)), strict=True))

        return call

    return map_batches(docs, task, FIELDS, () if keep_text else (text_col,))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def fitted(measured: DataFrame, labels: DataFrame, lang_col: str | None = "lang") -> dict[str, Band]:
    """BANDS, with those that the rows labelled good support; rounded, so that exact quantiles hold few distinct values."""
    good = measured.filter(~base_failed()).join(labels.filter("quality = 1").select(F.col("doc_id")), "doc_id", "left_semi")
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col)
    keys = F.array_compact(F.array(F.concat(lang, F.lit("/"), "script"), F.col("script")))
    at = lambda c, p: F.percentile(F.round(c, 4), F.lit(p))
    limits = [(at(c, SHARE), at(c, 1 - SHARE), F.greatest(at(b, 1 - SHARE), F.lit(SOME_BYTES)), at(e, SHARE)) for c, b, e in ([n + v for n in MEASURES] for v in ("", "2"))]
    rows = good.select(F.explode(keys).alias("_band"), *(n + v for v in ("", "2") for n in MEASURES)).groupBy("_band")
    rows = rows.agg(F.count("*").alias("n"), *(x for four in limits for x in four))
    return BANDS | {key: tuple(band) for key, _, *band in rows.filter(F.col("n") >= LEAST).collect()}  # a few numbers a language


def judge(measured: DataFrame, bands: dict[str, Band] = BANDS, lang_col: str | None = "lang") -> DataFrame:
    """Append base_failed and kept."""
    failed = base_failed()
    table = F.create_map(*(x for k, v in bands.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    languages = [k for k in bands if "/" not in k and k not in {s for *_, s in _SCRIPTS} | {"other"}]
    key = F.col("script") if lang_col is None else F.when(F.col(lang_col).isin(languages) & (F.col("script") == "latin"), F.col(lang_col)).otherwise(F.col("script"))
    own = [] if lang_col is None else [table[F.concat(F.col(lang_col), F.lit("/"), "script")]]
    band = F.coalesce(*own, table[key], table[F.lit("other")])
    fits = F.lit(True)
    for i, (chars, share, entropy) in enumerate([n + v for n in MEASURES] for v in ("", "2")):
        low, high, most_bytes, least = (band[4 * i + j] for j in range(4))
        fits = fits & F.col(chars).between(low, high) & (F.col(share) <= most_bytes) & (F.col(entropy) >= least)
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fits)


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The table's labels; None where it has none."""
    try:
        return read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def quality(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """All measures and the verdict; bands are fitted where ``labels`` (doc_id, quality) are given."""
    lang_col = "lang" if "lang" in docs.columns else None
    measured = measure(docs, **options)
    if labels is None:
        return judge(measured, lang_col=lang_col)
    measured = materialise(measured, "quality-measures")  # one pass over the texts for fitting and judging
    return judge(measured, fitted(measured, labels, lang_col), lang_col)


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality(read_table(spark, sf_dir, "documents").select("doc_id", "lang", text_or_empty().alias("text")), read_labels(spark, sf_dir))
    return docs.select("doc_id", *(f.name for f in FIELDS), "base_failed", "kept")


QUERIES = {"op7_fertility": op7_fertility}
