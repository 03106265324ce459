"""Duplicates hidden by formatting differences (problem 3).

Method.  The text's code points stream through a skip-and-fold table: letters and
digits fold to their lower case, everything else is skipped and ends a word.  The
folded stream feeds two rolling polynomial hashes modulo 2^64 - by prefix sums
over a whole Arrow batch, so no canonical string ever exists.  For kind ``table``
the hash runs per field (cut at ``;``, ``|`` and line breaks) and the fields'
hashes are added, which makes their order free.  Rows are grouped on the narrow
hashes with map-side combination; one row of each differently written text of a
group is then compared with the group's first row by a two-pointer scan that skips
separators.  Should hashes collide, the group's members are regrouped by an exact
digest of their words.

Defined results: null texts have no row; texts without a word equal each other (per
class table / other); a null kind counts as not ``table``; repeated row numbers are
kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import mix, signed, words
from ..shared import Scratch

TABLE_KIND = "table"
FIELD_MARKS = ";|\n\r"
#: Odd multipliers of the two polynomial hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
#: Code points whose lower case depends on neighbours or is several characters long.
_IRREGULAR = "İΣ"

SKIP, MARK = 0, 1


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point to folded code point; 0 skips, 1 skips and ends a field."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalnum():
            low = c.lower()
            table[cp] = ord(low[0])
    for c in FIELD_MARKS:
        table[ord(c)] = MARK
    return table


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points, a line break after each, and each text's end."""
    if any(c in t for t in texts for c in _IRREGULAR):
        texts = [t.lower() if any(c in t for c in _IRREGULAR) else t for t in texts]
    joined = "".join(t + "\n" for t in texts)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.cumsum(lengths)


def fingerprints(texts: list[str], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's words (of a table's fields in any order)."""
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    points, ends = _code_points(texts)
    folded = fold_table()[points]
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    # fields: a mark counts in tables only, and each text's own end always does
    last = np.zeros(len(points), dtype=bool)
    last[ends - 1] = True
    cut = last | ((folded == MARK) & tables[row])
    segment = np.cumsum(cut) - cut
    letter = folded > MARK
    at = np.flatnonzero(letter)
    n_segments = int(segment[-1]) + 1
    seg_row = np.zeros(n_segments, dtype=np.int64)
    seg_row[segment] = row
    out = []
    if len(at) == 0:
        zero = np.zeros(len(texts), np.uint64)
        return zero, zero.copy()
    # a word's first letter carries a second value, so "ab c" and "a bc" differ
    first = np.ones(len(at), dtype=bool)
    first[1:] = (np.diff(at) > 1) | (segment[at[1:]] != segment[at[:-1]])
    seg = segment[at]
    starts = np.flatnonzero(np.diff(seg, prepend=-1))
    size = np.diff(np.append(starts, len(at)))
    for base in BASES:
        with np.errstate(over="ignore"):
            value = mix(folded[at].astype(np.uint64) * np.uint64(2) + first.astype(np.uint64) + base)
            # position within the segment, so powers are small tables and no inverse is needed
            power = _powers(base, int(size.max()))
            place = np.arange(len(at)) - np.repeat(starts, size)
            poly = np.add.reduceat(value * power[place], starts)
            # every field with a word is mixed with its length before fields are added
            poly = mix(poly ^ (size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
            total = np.zeros(len(texts), np.uint64)
            np.add.at(total, seg_row[seg[starts]], poly)
        out.append(total)
    return out[0], out[1]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    full = np.full(n, base, dtype=np.uint64)
    full[0] = 1
    return np.cumprod(full, dtype=np.uint64)


def same_words(a: str, b: str) -> bool:
    """Two pointers over both texts, skipping separators; word limits must agree."""
    if any(c in t for t in (a, b) for c in _IRREGULAR):
        a, b = a.lower(), b.lower()
    i = j = 0
    na, nb = len(a), len(b)
    started = False
    while True:
        at_a, at_b = i, j
        while i < na and not a[i].isalnum():
            i += 1
        while j < nb and not b[j].isalnum():
            j += 1
        if i == na or j == nb:
            return i == na and j == nb
        if started and (i > at_a) != (j > at_b):
            return False
        if a[i].lower()[:1] != b[j].lower()[:1]:
            return False
        started = True
        i += 1
        j += 1


def fields(text: str) -> list[tuple[str, ...]]:
    """A table text's fields with words, sorted."""
    for c in FIELD_MARKS[1:]:
        text = text.replace(c, ";")
    return sorted(w for w in (tuple(words(f)) for f in text.split(";")) if w)


def field_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of a table text's fields with words, in the order of their hashes."""
    spans, lo = [], 0
    for hi in (*(i for i, c in enumerate(text) if c in FIELD_MARKS), len(text)):
        if any(map(str.isalnum, text[lo:hi])):
            spans.append((lo, hi))
        lo = hi + 1
    h1, h2 = fingerprints([text[lo:hi] for lo, hi in spans], np.zeros(len(spans), bool))
    return [spans[k] for k in np.lexsort((h2, h1))]


def same(a: str, b: str, table: bool) -> bool:
    """The comparison on the texts themselves: two pointers over both, over a table's fields pair by pair.

    Fields are paired by the order of their hashes; different ones of the same hash may be paired
    wrongly and then count as different, which sends the group to the exact digest.
    """
    if not table:
        return same_words(a, b)
    left, right = field_spans(a), field_spans(b)
    return len(left) == len(right) and all(same_words(a[i:j], b[k:m]) for (i, j), (k, m) in zip(left, right))


def digest(text: str, table: bool) -> bytes:
    key = repr(fields(text) if table else words(text))
    return hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        numbers, texts = b.column(0), b.column(1).to_pylist()
        tables = np.array(b.column(2).to_pylist(), dtype=bool)
        lo = 0
        while lo < len(texts):  # slices of a few million code points bound the arrays
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi]) < 1_000_000):
                held += len(texts[hi])
                hi += 1
            h1, h2 = fingerprints(texts[lo:hi], tables[lo:hi])
            yield pa.RecordBatch.from_arrays([numbers.slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(signed(h1)), pa.array(signed(h2)), b.column(3).slice(lo, hi - lo)], names=["row_no", "is_table", "h1", "h2", "raw"])
            lo = hi


def _check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t1, t2, tab = (b.column(i).to_pylist() for i in (4, 5, 3))
        good = [same(x, y, t) for x, y, t in zip(t1, t2, tab)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(good, pa.bool_())], names=["h1", "h2", "raw", "is_table", "good"])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [digest(t, k) for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary())], names=["row_no", "exact"])


KEY = ["is_table", "h1", "h2"]


def copy_groups(chunks: DataFrame, *, row_no: str = "chunk_no", text: str = "text", kind: str = "kind") -> DataFrame:
    """row_no, first_no, copies, variants for each row that has a copy (the first row included).

    variants counts the differently written texts of the set.
    """
    spark = chunks.sparkSession
    scratch = Scratch(spark, "copies")
    source = chunks.where(F.col(text).isNotNull()).select(F.col(row_no).cast("long").alias("row_no"), F.col(text).alias("text"), F.coalesce(F.col(kind) == TABLE_KIND, F.lit(False)).alias("is_table"))
    raw = F.substring(F.sha2("text", 256), 1, 32)
    prints = scratch.keep(source.withColumn("raw", raw).mapInArrow(_hash_batches, "row_no long, is_table boolean, h1 long, h2 long, raw string"), "prints")

    variants = prints.groupBy(*KEY, "raw").agg(F.min("row_no").alias("row_no"), F.count("*").alias("n"))
    groups = variants.groupBy(*KEY).agg(F.min("row_no").alias("first_no"), F.sum("n").alias("copies"), F.count("*").alias("variants"), F.min_by("raw", "row_no").alias("first_raw")).where(F.col("copies") > 1)
    groups = scratch.keep(groups, "groups")

    # one row of each other spelling against the group's first row
    pairs = variants.join(groups.where(F.col("variants") > 1), KEY).where(F.col("raw") != F.col("first_raw")).select(*KEY, "raw", "row_no", "first_no")
    pairs = scratch.keep(pairs, "pairs")
    wanted = pairs.select("row_no").unionByName(pairs.select(F.col("first_no").alias("row_no"))).distinct()
    texts = scratch.keep(source.select("row_no", "text").join(wanted, "row_no", "left_semi").dropDuplicates(["row_no"]), "texts")
    compared = (
        pairs.join(texts, "row_no")
        .join(texts.select(F.col("row_no").alias("first_no"), F.col("text").alias("first_text")), "first_no")
        .select("h1", "h2", "raw", "is_table", "text", "first_text")
        .mapInArrow(_check_batches, "h1 long, h2 long, raw string, is_table boolean, good boolean")
    )
    bad = scratch.keep(compared.where(~F.col("good")).select(*KEY).distinct(), "bad")

    members = prints.select("row_no", *KEY).join(groups.select(*KEY, "first_no", "copies", "variants"), KEY)
    if not bad.take(1):
        return members.select("row_no", "first_no", "copies", "variants")
    # colliding hashes: these groups are rebuilt on an exact digest of the words
    fine = members.join(bad, KEY, "left_anti").select("row_no", "first_no", "copies", "variants")
    again = prints.join(bad, KEY, "left_semi")
    exact = source.join(again.select("row_no"), "row_no", "left_semi").select("row_no", "text", "is_table").mapInArrow(_digest_batches, "row_no long, exact binary")
    rebuilt = again.join(exact.dropDuplicates(["row_no"]), "row_no")
    sets = rebuilt.groupBy("is_table", "exact", "raw").agg(F.min("row_no").alias("row_no"), F.count("*").alias("n"))
    sets = sets.groupBy("is_table", "exact").agg(F.min("row_no").alias("first_no"), F.sum("n").alias("copies"), F.count("*").alias("variants")).where(F.col("copies") > 1)
    return fine.unionByName(rebuilt.select("row_no", "is_table", "exact").join(sets, ["is_table", "exact"]).select("row_no", "first_no", "copies", "variants"))


def found(chunks: DataFrame) -> DataFrame:
    """first_no, copy_no: every member of a set but its first."""
    return copy_groups(chunks).where(F.col("row_no") != F.col("first_no")).select("first_no", F.col("row_no").alias("copy_no"))


def collapsed(chunks: DataFrame) -> DataFrame:
    """first_no, copies, variants: one row for each set of two or more copies."""
    return copy_groups(chunks).where(F.col("row_no") == F.col("first_no")).select("first_no", "copies", "variants").distinct()
