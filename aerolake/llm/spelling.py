"""Spelling variants of a corpus's vocabulary by a reduced alphabet.

Letters are hashed to SYMBOLS symbols. Words one edit apart have reduced words at most one edit apart, so the full one-edit neighbourhood
of every distinct reduced word (itself, deletions, replacements, insertions) is joined with the reduced vocabulary; what it meets is
joined back to the words, and each pair is verified on the original strings. A neighbourhood has about 2 * length * SYMBOLS members
whatever the real alphabet. Of two reduced words that are neighbours, the smaller emits the link and both use it, so each ordered pair of
words is met once.

A word's form is the commonest of its near words, if at least twice as common as the word. Counts at least double from form to form, so
roots are found by pointer doubling in a few joins.

Defined cases: a null text has no words; a null doc_id counts as empty in the checksum; a run that loses its only letter is no word;
repeated documents count as often as they occur; ties between near words go to the smaller in code-point order; an empty table gives
an empty table; further columns play no part. Long texts are read whole; a text's words leave it one by one.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import materialise, read_table, text_or_empty

#: Symbols that letters are hashed to: more mean larger neighbourhoods and fewer pairs to verify.
SYMBOLS = "abcdef"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
LEAST_LENGTH, LEAST_COUNT, DROP_EVERY, TIMES = 5, 3, 97, 2


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, w) of every run of letters, A-Z lower-cased."""
    low = F.translate(text_or_empty(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("w"))


def typos(words: DataFrame, every: int = DROP_EVERY) -> DataFrame:
    """(word): w, or w without one letter where ``every`` divides the checksum of its document and itself."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("w")).cast("binary"))
    at = F.pmod("h", F.length("w").cast("long")).cast("int")
    less = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    return words.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("w")).alias("word"))


def vocabulary(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of ``length`` letters and ``count`` occurrences at least."""
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def reduced(word: Column, symbols: str = SYMBOLS) -> Column:
    """The word in the reduced alphabet; letters outside LETTERS are their own symbols' hash too, by ``translate``."""
    return F.translate(word, LETTERS, "".join(symbols[zlib.crc32(c.encode()) % len(symbols)] for c in LETTERS))


def neighbourhood(s: Column, symbols: str = SYMBOLS) -> Column:
    """All strings of the reduced alphabet within one edit of ``s``, each once."""
    places, gaps = F.sequence(F.lit(1), F.length(s)), F.sequence(F.lit(1), F.length(s) + 1)
    each = F.array(*map(F.lit, symbols))
    left, right = lambda i: F.substring(s, F.lit(1), i - 1), lambda i: F.substring(s, i, F.length(s))
    deleted = F.transform(places, lambda i: F.concat(left(i), right(i + 1)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(each, lambda c: F.concat(left(i), c, right(i + 1)))))
    inserted = F.flatten(F.transform(gaps, lambda i: F.transform(each, lambda c: F.concat(left(i), c, right(i)))))
    return F.array_distinct(F.concat(F.array(s), deleted, replaced, inserted))


def near_words(words: DataFrame, symbols: str = SYMBOLS) -> DataFrame:
    """(word, near, near_n) of all ordered pairs of words (word, n) exactly one edit apart."""
    words = materialise(words.withColumn("s", reduced(F.col("word"), symbols)), "spelling-words")
    classes = materialise(words.select("s").distinct(), "spelling-classes")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows make many: their files are too few tasks
    upward = classes.repartition(parts, "s").select("s", F.explode(F.filter(neighbourhood(F.col("s"), symbols), lambda x: x >= F.col("s"))).alias("s2"))
    met = materialise(upward.join(classes.select(F.col("s").alias("s2")), "s2").select("s", "s2"), "spelling-links")
    links = met.union(met.filter("s <> s2").select("s2", "s"))
    other = words.select(F.col("s").alias("s2"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return words.select("s", "word").join(links, "s").join(other, "s2").filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word that has a form (word, form): its form's form, and so on to the last."""
    to = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while to.filter("moved").limit(1).count():
        further = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = materialise(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
    return to.select("word", "root")


def variants(words: DataFrame, symbols: str = SYMBOLS, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n)."""
    words = materialise(words.select("word", "n"), "spelling-vocabulary")
    best = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    common = -F.col("best.less") >= times * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, "spelling-forms")
    root = roots(rows.filter("form IS NOT NULL"))
    return rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(typos(runs(read_table(spark, sf_dir, "documents").select("doc_id", "text")))))


QUERIES = {"op13_spelling": op13_spelling}
