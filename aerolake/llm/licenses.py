"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined with the positions of the same k-grams in the templates. A hit at text
word p and template word t votes for the diagonal p - t; hits are counted by diagonal, neighbouring diagonals (words put in or
left out) are merged into spans, and a span is verified: its k-grams must equal the template's word by word, and it counts for the longest
chain of them that goes on in the template as in the text, so that an opening repeated many times counts once. Templates
are short phrases, which must be whole, and license notices, of which a span must cover a share. Phrases use pairs of words,
notices five words.

The table of template positions is fixed and small (one row a template word), so it is broadcast. Hashes that no template has
are dropped while a text is read; what is left, a few rows a text, is written with a row number, which joins the labels back.

Defined cases: null text is empty; empty text has no words, labels are the empty string and places null; very long texts are
read whole; equal rows give equal rows; a null doc_id is a document like any other; an empty table gives an empty table; further
columns play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolake.llm.common import materialise, read_table, text_or_empty

#: Words before A-Z become lower case, so A-Z are word characters too.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASE_GRAM, NOTICE_GRAM = 2, 5
#: Diagonals this near are one span if the words between are as few.
NEAR = 8
#: Share of a notice's k-grams that a span must hold.
COVER = 0.6

#: Phrases of the base and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Public license notices: (label, text). Several may share a label: long and short forms, and parts that stand alone.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("as-is", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-notice", "licensed under the GNU General Public License"),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl-notice", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-notice", "Licensed under CC BY-NC"),
    ("cc-by-sa-notice", "Licensed under CC BY-SA"),
]


def templates() -> list[tuple[str, str, bool, list[str], int]]:
    """(template, label, is phrase, words, gram)."""
    find = re.compile(WORD).findall
    lower = str.maketrans(_UPPER, _LOWER)
    phrases = [(p, x, True, find(p), PHRASE_GRAM) for p, x in PHRASES.items()]
    return phrases + [(f"{x} {i}", x, False, find(t.translate(lower)), NOTICE_GRAM) for i, (x, t) in enumerate(NOTICES)]


def template_grams(spark: SparkSession) -> DataFrame:
    """One row a template k-gram: hash, words, template, position, number of k-grams in the template."""
    rows = [(name, label, phrase, words[i : i + k], i, len(words) - k + 1, k) for name, label, phrase, words, k in templates() for i in range(len(words) - k + 1)]
    table = spark.createDataFrame(rows, "template string, label string, phrase boolean, gram array<string>, at int, n_grams int, k int")
    return table.withColumn("hash", F.when(F.col("k") == PHRASE_GRAM, F.get(rolling_pairs(word_hashes(F.col("gram"))), F.lit(0))).otherwise(F.get(rolling_fives(word_hashes(F.col("gram"))), F.lit(0))))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _joined(a: Column, b: Column, n: Column) -> Column:
    """Hashes of a[i] with b[i] for the first n places."""
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.xxhash64(x, y))


def _from(a: Column, at: int) -> Column:
    return F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0)))


def rolling_pairs(h: Column) -> Column:
    """Hashes of all pairs of neighbouring words."""
    return _joined(h, _from(h, 1), F.greatest(F.size(h) - 1, F.lit(0)))


def rolling_fives(h: Column) -> Column:
    """Hashes of all runs of five words, by doubling: pairs, fours, fives."""
    two = rolling_pairs(h)
    four = _joined(two, _from(two, 2), F.greatest(F.size(two) - 2, F.lit(0)))
    return _joined(four, _from(h, 4), F.greatest(F.size(h) - 4, F.lit(0)))


def _known(grams: Column, hashes: list[int], k: int) -> Column:
    """(pos, k, hash) of the k-grams whose hash some template has. The set is no larger than the templates."""
    every = F.transform(grams, lambda h, i: F.when(h.isin(hashes), F.struct(i.alias("pos"), F.lit(k).alias("k"), h.alias("hash"))))
    return F.array_compact(every)


def gram_hits(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """doc_id, ``_row``, n_words and ``_hits`` of every row of (doc_id, _w): k-grams, with their words, whose hash some template has."""
    hashes = {k: [r.hash for r in positions.filter(F.col("k") == k).select("hash").distinct().collect()] for k in (PHRASE_GRAM, NOTICE_GRAM)}  # a number a template word
    hashed = docs.select("*", F.monotonically_increasing_id().alias("_row"), word_hashes(F.col("_w")).alias("_h"))
    found = F.concat(_known(rolling_pairs(F.col("_h")), hashes[PHRASE_GRAM], PHRASE_GRAM), _known(rolling_fives(F.col("_h")), hashes[NOTICE_GRAM], NOTICE_GRAM))
    # A hash is of words in lower case by any letter; words are compared after lowering A-Z only.
    words = lambda s: F.transform(F.slice("_w", s["pos"] + 1, s["k"]), lambda w: F.translate(w, _UPPER, _LOWER))
    return hashed.select("doc_id", "_row", F.size("_w").cast("long").alias("n_words"), F.transform(found, lambda s: F.struct(s["pos"], s["k"], s["hash"], words(s).alias("gram"))).alias("_hits"))


def template_hits(found: DataFrame, positions: DataFrame) -> DataFrame:
    """(_row, template, label, phrase, n_grams, k, at, pos, diagonal): hits joined with template positions, equal word by word."""
    hits = found.select("_row", F.explode("_hits").alias("h")).select("_row", F.col("h.pos").alias("pos"), F.col("h.hash").alias("hash"), F.col("h.gram").alias("_gram"))
    met = hits.join(F.broadcast(positions), "hash")  # one row a template word
    return met.filter(F.col("_gram") == F.col("gram")).select("_row", "template", "label", "phrase", "n_grams", "k", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))


def _chain(hits: Column) -> Column:
    """Length of the longest chain of hits (pos, at) that go on in the text and in the template, by patience: the least last place of a chain of each length."""
    ordered = F.transform(F.array_sort(F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), (-h["at"]).alias("back")))), lambda h: -h["back"])  # of one word's hits the later places first, so that a chain holds one
    fewer = lambda tails, at: F.size(F.filter(tails, lambda x: x < at))
    put = lambda tails, n, at: F.concat(F.slice(tails, 1, n), F.array(at), F.slice(tails, n + 2, F.greatest(F.size(tails) - n - 1, F.lit(0))))
    bound = lambda tails, at: F.get(F.transform(F.array(fewer(tails, at)), lambda n: put(tails, n, at)), F.lit(0))
    return F.aggregate(ordered, F.array().cast("array<int>"), bound, F.size)


def spans(hits: DataFrame) -> DataFrame:
    """(_row, template, label, phrase, start, stop, cover): merged and verified diagonals; start and stop are words, stop exclusive.

    Diagonals of a notice are taken in their own order, and those at most NEAR apart are one span, whatever lies between them in the text: a
    stray diagonal of words that the notice repeats does not part a span. A span's cover is that of its longest chain.
    """
    diagonals = hits.groupBy("_row", "template", "label", "phrase", "n_grams", "k", "diagonal").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_list(F.struct("pos", "at")).alias("_hits"))
    whole = diagonals.filter(F.col("phrase") & (F.col("n") == F.col("n_grams")))
    out = whole.select("_row", "template", "label", "phrase", F.col("first").alias("start"), (F.col("last") + F.col("k")).alias("stop"), F.lit(1.0).alias("cover"))
    order = Window.partitionBy("_row", "template").orderBy("diagonal")  # a text's own diagonals
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > NEAR
    runs = diagonals.filter(~F.col("phrase")).withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    merged = runs.groupBy("_row", "template", "label", "phrase", "n_grams", "_run").agg(F.flatten(F.collect_list("_hits")).alias("_hits"), F.min("first").alias("start"), F.max(F.col("last") + F.col("k")).alias("stop"))
    several = F.size(F.array_distinct(F.transform("_hits", lambda h: h["at"]))) >= COVER * F.col("n_grams")  # no chain is longer than the places hit
    merged = merged.filter(several).withColumn("cover", _chain(F.col("_hits")) / F.col("n_grams")).filter(F.col("cover") >= COVER)
    return out.union(merged.select("_row", "template", "label", "phrase", "start", "stop", "cover"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and labels, all labels and score (the best span's cover) of every document."""
    positions = template_grams(docs.sparkSession)
    rows = docs.select("doc_id", F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0)).alias("_w"))
    found = materialise(gram_hits(rows, positions), "license-hits")  # a row a document, without its text
    base = F.col("phrase")
    per_doc = spans(template_hits(found, positions)).groupBy("_row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    out = found.drop("_hits").join(per_doc, "_row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_licenses": op5_licenses}
