"""Column expressions on text: word and sentence arrays, normal forms, hashes.

All are built-in functions of one row; none shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed patterns: letters of a word, a sentence's end before the next one's start.
WORD = r"[A-Za-zÀ-ɏ']+"
SENTENCE_END = r"""([.!?])["'”’)\]]*[ \t\r\f]+(["'“‘(\[]*[A-Z0-9])"""


def words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def sentences(text: Column) -> Column:
    """Per line, split after end punctuation before a capital or digit; blank ones dropped."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1\u0001$2")
    return F.filter(F.split(marked, "[\u0001\n]"), lambda s: F.trim(s) != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Array of n-grams, joined by a blank; empty if there are fewer tokens."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def norm_key(text: Column) -> Column:
    """sha256 of the lower-case text with white space collapsed."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))).cast("binary"), 256)


def hash_bucket(value: Column, k: int) -> Column:
    """First 32 bits of sha256, modulo k."""
    return F.pmod(F.conv(F.substring(F.sha2(value.cast("binary"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(k))


def rate(part: Column, whole: Column, per: float = 1.0) -> Column:
    return F.when(whole > 0, part * F.lit(per) / whole).otherwise(F.lit(0.0))
