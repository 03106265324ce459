"""Column expressions on text: token estimates, normal form, prefix, paragraphs and sentences.

Python's white space is Java's Unicode class plus U+001C to U+001F, so the classes
name both.  All expressions stay in whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
_RUN = r"(?U)[\s\x1c-\x1f]+"

#: Between sentences: after a closing sign, before a capital, digit or opening quote.
SENTENCE_GAP = r"(?U)(?<=[.!?;:])\s+(?=[A-ZÀ-ÖØ-Þ0-9«\"“(])"

#: Tokens kept free for the encoder's special tokens and the line after the prefix.
RESERVED_TOKENS = 3
LONG_SECTION = 80


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, _RUN), lambda w: w != "")


def tokens_words(text: Column) -> Column:
    """About 1.3 tokens a word, cut to an integer."""
    return (F.size(split_words(text)) * F.lit(1.3)).cast("int")


def tokens_chars(text: Column) -> Column:
    """Characters divided by four, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("int")


def normalized(text: Column) -> Column:
    """Single blanks, none at the ends, lower case: equal for repeats of a passage."""
    return F.lower(F.trim(F.regexp_replace(text, _RUN, " ")))


def content_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def prefix(doc_id: Column, section: Column, page: Column, approx: Column) -> Column:
    """``DOCUMENT — section — page n``; an unknown page is left out, an estimated one gets ``~``."""
    s = strip(F.coalesce(section, F.lit("")))
    short = F.when(F.length(s) <= LONG_SECTION, s).otherwise(F.concat(F.lit("…"), F.substring(s, -(LONG_SECTION - 1), LONG_SECTION - 1)))
    number = F.when(page.isNotNull(), F.concat(F.when(approx, F.lit("page ~")).otherwise(F.lit("page ")), (page + 1).cast("string")))
    return F.concat_ws(" — ", F.upper(doc_id), F.when(s != "", short), number)


def child_budget(chunk_tokens: int, max_seq: int, prefix_tokens: Column) -> Column:
    """Room for a child's text once its prefix is paid for."""
    return F.greatest(F.lit(16), F.least(F.lit(chunk_tokens), F.lit(max_seq) - prefix_tokens - RESERVED_TOKENS))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda p: strip(p)), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_GAP), lambda p: strip(p)), lambda p: p != "")


def stable_id(doc_id: Column, kind: Column, section: Column, text: Column, occurrence: Column, version: Column) -> Column:
    """Derived from content and section, not position; occurrence tells equal passages of a section apart."""
    seed = F.concat_ws(":", doc_id, kind, section, F.sha2(text, 256), occurrence.cast("string"), version)
    return F.substring(F.sha2(seed, 256), 1, 16)


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """Element at floor(n * p) of a sorted array, the last one at most."""
    n = F.size(sorted_values)
    return F.element_at(sorted_values, F.least(n, F.floor(n * F.lit(p)).cast("int") + 1))
