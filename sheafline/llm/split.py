"""Splitting oversized items at natural boundaries (problem 2).

Method: lexical-cohesion segmentation.  A text is cut into atoms at sentence, line
and (for tables) row ends.  At every gap between atoms two sliding blocks of atoms
are compared by the cosine of their word counts; how far the similarity at a gap
lies below the peaks on both sides is the gap's depth.  A piece is filled from its
start; among the gaps in its size window - from ``FILL`` of the limit to the
limit - the deepest valley after which the overlap fits ends it, the later one on a tie.
The next piece starts ``overlap`` atoms earlier, or as many of them as leave room for a
new one: fewer where the sentences at every gap of the window are too long for that, and
never the first atom of the piece before, which would only repeat that piece's start.
An atom is a sentence; only one larger than the limit is cut at clause marks (overlap
then counts its clauses), then at blanks, or between any two characters where it has none.

Sizes are counted as code points / 4, rounded up, at least 1.  Pieces are slices of
the text: every character that isn't white space is in a piece, and pieces without
their overlap give the text in order.

Defined results: null texts and rows without a known configuration (or with a null
or non-positive max_tokens) have no limit and give no pieces; a null overlap counts
as 0; a text of only white space within the limit is one piece; a text of only white
space above the limit gives one empty piece; repeated rows give repeated pieces.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import WORD

#: Atoms on each side of a gap that are compared.
BLOCK = 3
#: Part of the limit that a piece holds at least before a valley may end it.
FILL = 0.5
CHARS_PER_TOKEN = 4

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+(?=\S)|\n+\s*(?=\S)")
_CLAUSE = re.compile(r"(?<=[.!?;:…])[\"'»”’)\]]*\s+(?=\S)")
_ROW = re.compile(r"\n+\s*(?=\S)|(?<=[;|])\s*(?=\S)")


def size_of(text: Column) -> Column:
    """Characters divided by four, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + (CHARS_PER_TOKEN - 1)) / CHARS_PER_TOKEN)).cast("int")


def atoms(text: str, table: bool, limit: int) -> list[tuple[int, int]]:
    """(start, end) of the atoms, white space after an atom left out; none longer than ``limit`` characters.

    A table breaks at line ends; a line that is too long breaks at its field marks.
    Other texts break at line and sentence ends, which no lower-case letter follows;
    a sentence that is too long breaks at its clause marks.
    """
    out: list[tuple[int, int]] = []
    pattern = re.compile(r"\n+\s*(?=\S)") if table else _SENTENCE
    for lo, hi in _between(text, 0, len(text), pattern, not table):
        if hi - lo > limit:
            parts = list(_between(text, lo, hi, _ROW if table else _CLAUSE))
        else:
            parts = [(lo, hi)]
        for a, b in parts:
            while b - a > limit:
                cut = text.rfind(" ", a + limit // 2, a + limit + 1)
                cut = cut if cut > a else a + limit
                end = cut
                while end > a and text[end - 1].isspace():
                    end -= 1
                out.append((a, end))
                a = cut
                while a < b and text[a].isspace():
                    a += 1
            if b > a:
                out.append((a, b))
    return out


def _between(text: str, lo: int, hi: int, pattern: re.Pattern, whole: bool = False) -> Iterator[tuple[int, int]]:
    """Stretches between the matches; ``whole`` passes over those within a line before a lower-case letter."""
    while lo < hi and text[lo].isspace():
        lo += 1
    while hi > lo and text[hi - 1].isspace():
        hi -= 1
    for m in pattern.finditer(text, lo, hi):
        if whole and text[m.end()].islower() and "\n" not in m.group():
            continue
        end = m.end() - len(m.group()) + len(m.group().rstrip())
        if end > lo and m.end() > lo:
            yield lo, max(end, lo)
            lo = m.end()
    if hi > lo:
        yield lo, hi


def depths(bags: list[Counter], block: int = BLOCK) -> list[float]:
    """Depth of the gap before each atom but the first: index i is the gap between i and i + 1."""
    n = len(bags)
    if n < 2:
        return []
    left, right = Counter(), Counter()
    for b in bags[1 : 1 + block]:
        right.update(b)
    left.update(bags[0])
    similar = []
    for i in range(n - 1):
        dot = sum(c * right[w] for w, c in left.items())
        norm = math.sqrt(sum(c * c for c in left.values()) * sum(c * c for c in right.values()))
        similar.append(dot / norm if norm else 0.0)
        left.update(bags[i + 1])
        if i + 1 >= block:
            left.subtract(bags[i + 1 - block])
            left += Counter()
        right.subtract(bags[i + 1])
        if i + 1 + block < n:
            right.update(bags[i + 1 + block])
        right += Counter()
    # the peak on a side is reached by climbing as long as the similarity doesn't fall
    peak_left, peak_right = similar[:], similar[:]
    for i in range(1, n - 1):
        if similar[i - 1] >= similar[i]:
            peak_left[i] = peak_left[i - 1]
    for i in range(n - 3, -1, -1):
        if similar[i + 1] >= similar[i]:
            peak_right[i] = peak_right[i + 1]
    return [peak_left[i] + peak_right[i] - 2 * similar[i] for i in range(n - 1)]


def pieces(text: str, max_tokens: int, overlap: int, table: bool, fill: float = FILL, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, end, atoms shared with the piece before) of each piece of an oversized text."""
    limit = max_tokens * CHARS_PER_TOKEN
    parts = atoms(text, table, limit)
    if not parts:
        return [(0, 0, 0)]
    lower = text.lower() if len(text.lower()) == len(text) else text
    deep = depths([Counter(WORD.findall(lower[a:b])) for a, b in parts], block)
    out: list[tuple[int, int, int]] = []
    start, fresh = 0, 0  # first atom of the piece, first atom not yet in a piece
    n = len(parts)
    while fresh < n:
        begin = parts[start][0]
        last = fresh
        while last + 1 < n and parts[last + 1][1] - begin <= limit:
            last += 1
        if last < n - 1:
            # a cut after which the asked overlap and a new atom fit, if the window has one
            shares = lambda k: k + 1 - overlap > start and parts[k + 1][1] - parts[k + 1 - overlap][0] <= limit
            best = last
            for k in range(last, fresh - 1, -1):
                if parts[k][1] - begin < fill * limit:
                    break
                if (shares(k), deep[k]) > (shares(best), deep[best]):
                    best = k
            last = best
        out.append((begin, parts[last][1], fresh - start))
        first, fresh = start, last + 1
        if fresh < n:
            start = fresh
            while fresh - start < overlap and start - 1 > first and parts[fresh][1] - parts[start - 1][0] <= limit:
                start -= 1
    return out


_PIECE = "chunk_no long, config_id int, piece_no int, pieces int, start_pos int, end_pos int, overlap_atoms int, overlap_asked int, text string, token_count int, max_tokens int"


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["chunk_no", "config_id", "piece_no", "pieces", "start_pos", "end_pos", "overlap_atoms", "overlap_asked", "text", "token_count", "max_tokens"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    for b in batches:
        rows: list[tuple] = []
        held = 0
        for no, config, text, kind, most, overlap in zip(*(b.column(i).to_pylist() for i in range(6))):
            cut = pieces(text, most, overlap, kind == "table")
            for k, (lo, hi, shared) in enumerate(cut):
                rows.append((no, config, k, len(cut), lo, hi, shared, overlap if k else 0, text[lo:hi], max(1, (hi - lo + 3) // 4), most))
                held += hi - lo
            if held > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def split_oversized(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """The pieces of every chunk whose text is larger than its configuration's max_tokens.

    The size test runs in the scan's stage, so only oversized texts reach Python.  Where
    ``overlap_atoms`` is less than ``overlap_asked``, no more sentences fitted beside a new one.
    """
    limits = configs.select(F.col("config_id").alias("c_id"), "max_tokens", F.greatest(F.coalesce("overlap_sentences", F.lit(0)), F.lit(0)).alias("overlap")).where(F.col("max_tokens") > 0)
    rows = chunks.select("chunk_no", "config_id", "text", "kind")
    large = rows.join(limits, rows["config_id"] == limits["c_id"]).where(size_of(F.col("text")) > F.col("max_tokens"))
    return large.select(F.col("chunk_no").cast("long").alias("chunk_no"), F.col("config_id").cast("int").alias("config_id"), "text", "kind", F.col("max_tokens").cast("int").alias("max_tokens"), F.col("overlap").cast("int").alias("overlap")).mapInArrow(_split_batches, _PIECE)


def found(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """chunk_no of each row that had to be split."""
    return split_oversized(chunks, configs).where(F.col("piece_no") == 0).select("chunk_no")
