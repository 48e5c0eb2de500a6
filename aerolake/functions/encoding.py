"""Values for documents and keys: numbers that JSON cannot say, hashes of texts, seeded draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset and prime of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a hash of a text's UTF-8 bytes, as a long from 0; the offset for an empty text."""
    digits = F.hex(text.cast("binary"))
    starts = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    return F.when(text.isNotNull(), F.aggregate(each, F.lit(FNV_OFFSET).cast("long"), lambda h, b: h.bitwiseXOR(b) * FNV_PRIME % (1 << 32)))


def json_number(value: Column) -> Column:
    """A number as JSON text: infinities as quoted words, NULL and what is no number as null."""
    word = F.when(value == float("inf"), '"Infinity"').when(value == float("-inf"), '"-Infinity"')
    return F.when(value.isNull() | F.isnan(value), "null").otherwise(F.coalesce(word, value.cast("string")))


def from_json_number(text: Column) -> Column:
    """What ``json_number`` wrote, as a number; null as NULL."""
    return F.when(text == '"Infinity"', float("inf")).when(text == '"-Infinity"', float("-inf")).otherwise(text.try_cast("double"))


def uniform(seed: Column, *key: Column) -> Column:
    """A draw in [0, 1) that depends on the seed and the key only, so that a row keeps its draw however it is partitioned."""
    return F.shiftrightunsigned(F.xxhash64(seed, *key), 11) / float(1 << 53)


def normal(seed: Column, *key: Column) -> Column:
    """A standard normal draw of the seed and the key, by Box and Muller from two uniform ones."""
    a, b = uniform(seed, *key, F.lit(1)), uniform(seed, *key, F.lit(2))
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * math.pi * b)
