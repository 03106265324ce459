"""Near-duplicate records with small edits (problem 6).

Similarity is the Jaccard ratio of the sets of ``WORDS`` consecutive words.

Method.  Rows with the same words are one class; only its first row is compared.
Candidates are generated exactly.  All runs stand in one order, rarest first; a pair of
the wanted similarity shares a run among the first |x| - ceil(similarity * |x|) + 1 of
each, its prefix, so the rows of each prefix run are a bucket and buckets lose no pair.
At the first run that a pair shares, it can share no more than what follows in either, so
a row's place in a bucket bounds the size of its partners there; later runs may repeat it.
The order comes from hashed counts of all runs of all texts; another order would give
larger buckets, never another result.

A class is sketched by the parities of its runs hashed to ``BITS`` bits.  A run that only
one of two classes holds flips one bit, so sketches differ in at most as many bits as the
sets in runs, which is (1 - similarity) / (1 + similarity) * (|x| + |y|) or less for a
similar pair: this radius can't dismiss one.  Sets of over ``WIDE_FROM`` runs fill so few
bits, so they carry a wider sketch too, by which the pairs that meet are compared under the
same bound; of two widths the larger is folded.  Inside the buckets the sketches are bit-sliced:
plane i holds bit i of 64 rows per word, and neighbouring buckets share words.  In a
bucket, rows lie by size; each row asks at the words of the larger rows whose size fits.
Differing bits are added by carry-save adders into vertical counters, a comparator after
each group of planes marks the rows still within the radius, and an entry (a row and a
word) is abandoned as soon as none is.  Survivors are compared exactly on their words.

Buckets are never collected beyond ``BUCKET_ROWS``: larger ones are divided by the second
run that two similar rows must share, and what is then still larger is cut into blocks,
every pair of which is one unit of work, so all pairs are compared.  Dividing repeats a
posting for every second run, some twenty times, so buckets stay whole as long as a task
can hold them; in a bucket a row asks only at the sizes its place leaves open.

The postings are compared in rounds, each over a hash range of the buckets, whose shuffle
files are freed before the next: the rounds bound the disk, and together they hold every
bucket, so their number changes no result.

Defined results: null texts have no row; texts of fewer than ``WORDS`` words have an
empty set and are similar only to identical texts; row numbers are taken as unique
(repeated ones yield no pair with themselves); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import mix, signed, words
from ..shared import Scratch, partitions, small

WORDS = 3
SIMILARITY = 0.6
BITS = 192
BUCKET_ROWS = 65_536
#: Sets of more runs have a wide sketch of the first of these widths (in bits) that they fill to 0.7 at most, or of the last.
WIDE_FROM = 136
WIDTHS = (512, 1024, 2048)
#: Postings shuffled in one round: so many for each compared row, and never less than the second.
ROUND_POSTINGS = 40
LEAST_POSTINGS = 1_000_000
#: Entries of a query row and a word of 64 rows compared at once; bounds the arrays.
ENTRIES = 16_384
#: Counters that all runs are hashed to for their order (4 MB).
COUNTER_BITS = 20
#: Lists of row numbers or runs up to this long are broadcast (about 24 MB as a hash table), longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000

def word_numbers(lists: list[list[str]], seen: dict[str, int]) -> np.ndarray:
    """64-bit hashes of all words, list after list; ``seen`` caches them."""
    if len(seen) > 500_000:
        seen.clear()
    out = []
    for ws in lists:
        for w in ws:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(lists: list[list[str]], seen: dict[str, int], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of every distinct run of n words, sorted by row."""
    numbers = word_numbers(lists, seen)
    lengths = np.array([len(ws) for ws in lists], dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    if len(numbers) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(numbers) - n + 1
    with np.errstate(over="ignore"):
        runs = np.zeros(m, np.uint64)
        for k in range(n):
            runs = mix(runs + numbers[k : m + k])
    whole = row[:m] == row[n - 1 :]
    runs, row = runs[whole], row[:m][whole]
    order = np.lexsort((runs, row))
    runs, row = runs[order], row[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
    return runs[new], row[new]


def sketches(runs: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Packed parities [rows, BITS / 64]: bit k is the parity of the number of a row's runs hashed to k."""
    bit = ((mix(runs) >> np.uint64(32)) * np.uint64(BITS) >> np.uint64(32)).astype(np.int64)
    odd = np.bincount(row * BITS + bit, minlength=rows * BITS).reshape(rows, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def wide_sketches(runs: np.ndarray, row: np.ndarray, size: np.ndarray) -> list[bytes | None]:
    """Parities of the large sets by the low bits of other hashes, so a sketch folded in half is that of half the width."""
    width = np.array(WIDTHS)[np.minimum(np.searchsorted(WIDTHS, size / 0.7), len(WIDTHS) - 1)]
    out: list[bytes | None] = [None] * len(size)
    for w in WIDTHS:
        own = (width == w) & (size > WIDE_FROM)
        rows = np.flatnonzero(own)
        if len(rows):
            bit = (mix(runs[own[row]]) & np.uint64(w - 1)).astype(np.int64)
            odd = np.bincount((np.cumsum(own) - 1)[row[own[row]]] * w + bit, minlength=len(rows) * w).reshape(len(rows), w) & 1
            for r, packed in zip(rows.tolist(), np.packbits(odd.astype(np.uint8), axis=1, bitorder="little")):
                out[r] = packed.tobytes()
    return out


class Wide:
    """Wide sketches of a batch's rows, folded to every width that two of them may share."""

    def __init__(self, wide: np.ndarray) -> None:
        self.bits = np.array([0 if x is None else 8 * len(x) for x in wide], dtype=np.int64)
        self.folded = []
        for w in WIDTHS:
            rows = np.flatnonzero(self.bits >= w)
            if not len(rows):
                continue
            matrix, place = np.empty((len(rows), w // 64), np.uint64), np.zeros(len(wide), np.int64)
            for each in np.unique(self.bits[rows]):
                at = np.flatnonzero(self.bits[rows] == each)
                matrix[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(wide[rows[at]]), np.uint64).reshape(len(at), each // w, w // 64), axis=1)
            place[rows] = np.arange(len(rows))
            self.folded.append((w, place, matrix))

    def near(self, i: np.ndarray, j: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Pairs not dismissed; those without two wide sketches never are."""
        out = np.ones(len(i), dtype=bool)
        shared = np.minimum(self.bits[i], self.bits[j])
        for w, place, matrix in self.folded:
            at = np.flatnonzero(shared == w)
            out[at] = np.bitwise_count(matrix[place[i[at]]] ^ matrix[place[j[at]]]).sum(axis=1) <= radius[at]
        return out


def most_apart(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Most runs held by only one of two similar sets of these sizes, so also most differing bits of their sketches."""
    return np.floor((1 - similarity) / (1 + similarity) * (a + b) + 1e-6).astype(np.int64)


def _counters(runs: np.ndarray) -> np.ndarray:
    return (runs >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def prefixes(runs: np.ndarray, row: np.ndarray, size: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(runs, row) of each row's prefix and the one run behind it, in the one order of all runs: by counter, then by hash."""
    order = np.lexsort((runs, counts[_counters(runs)], row))
    first = np.cumsum(size) - size
    length = size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1
    kept = order[np.arange(len(runs)) - first[row] < length[row] + 1]
    return runs[kept], row[kept]


def _slices(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Slices that bound the arrays, whatever the texts' sizes."""
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi]) < most):
            held += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    for b in batches:
        texts = b.column(0).to_pylist()
        for lo, hi in _slices(texts):
            np.add.at(counts, _counters(shingles([words(t) for t in texts[lo:hi]], seen)[0]), 1)
    met = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], names=["counter", "n"])


def run_counts(source: DataFrame) -> np.ndarray:
    """Hashed counts of the runs of all texts, every row read."""
    got = source.select("text").mapInArrow(_count_batches, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTER_BITS, np.uint32)
    counts[got["counter"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**32 - 1)
    return counts


_BITS = [f"b{k}" for k in range(BITS // 64)]
_SKETCH = f"row_no long, k1 long, k2 long, size int, {', '.join(b + ' long' for b in _BITS)}, wide binary, length int, prefix array<long>"


def _sketch_batches(counts: Broadcast, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            numbers, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in _slices(texts):
                lists = [words(t) for t in texts[lo:hi]]
                keys = np.frombuffer(b"".join(_class_key(ws, t) for ws, t in zip(lists, texts[lo:hi])), dtype="<u8").reshape(-1, 2)
                runs, row = shingles(lists, seen)
                size = np.bincount(row, minlength=hi - lo)
                bits = sketches(runs, row, hi - lo)
                prefix, owner = prefixes(runs, row, size, counts.value, similarity)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(prefix)))
                length = (size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1) * (size > 0)
                yield pa.RecordBatch.from_arrays([numbers.slice(lo, hi - lo), pa.array(signed(keys[:, 0])), pa.array(signed(keys[:, 1])), pa.array(size.astype(np.int32)), *(pa.array(signed(bits[:, k])) for k in range(len(_BITS))), pa.array(wide_sketches(runs, row, size), pa.binary()), pa.array(length.astype(np.int32)), listed], names=["row_no", "k1", "k2", "size", *_BITS, "wide", "length", "prefix"])

    return run


def _class_key(ws: list[str], text: str) -> bytes:
    """Same words, same class; texts too short for a run are told apart character by character."""
    whole = "\x00".join(ws) if len(ws) >= WORDS else "\x01" + text
    return xxhash.xxh3_128_digest(whole.encode("utf-8", "surrogatepass"))


def planes(sketch: np.ndarray) -> np.ndarray:
    """Vertical planes [BITS, ceil(rows / 64)] of sketches [rows, BITS / 64]."""
    rows = len(sketch)
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8).reshape(rows, -1), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], (rows + 63) // 64 * 64), np.uint8)
    padded[:, :rows] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within(sketch: np.ndarray, ask: np.ndarray, word: np.ndarray, wanted: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, met row) of all wanted pairs whose sketches differ in at most the radius.

    Entry e asks with row ``ask[e]`` at the 64 rows of ``word[e]``, of which ``wanted[e]``
    marks those to compare, within ``radius[e]``.  Seven planes and the counter's lowest
    digit enter a tree of carry-save adders at a time; the comparator then drops rows
    beyond the radius, and an entry is abandoned when none of its rows is left.
    """
    return _within(planes(sketch), _bits(sketch), ask, word, wanted, radius)


def _bits(sketch: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8).reshape(len(sketch), sketch.shape[1] * 8), axis=1, bitorder="little")


def _within(plane: np.ndarray, bits: np.ndarray, ask: np.ndarray, word: np.ndarray, wanted: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = [_within_block(plane, bits, *(x[lo : lo + ENTRIES] for x in (ask, word, wanted, radius))) for lo in range(0, len(ask), ENTRIES)]
    return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), ())))


def _within_block(plane: np.ndarray, bits: np.ndarray, ask: np.ndarray, word: np.ndarray, alive: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    zero = np.uint64(0)
    digits = len(plane).bit_length()
    count = [np.zeros(len(ask), np.uint64) for _ in range(digits)]
    # digit d of the radius, as a word of 64 equal bits
    limit = [zero - (radius >> d & 1).astype(np.uint64) for d in range(digits)]
    least = int(radius.min(initial=0))
    for lo in range(0, len(plane), 8):
        # all ones where the query's bit is set: XOR with the plane gives the differing rows
        ones = zero - np.ascontiguousarray(bits[ask, lo : lo + 8].T).astype(np.uint64)
        pending = list(plane[lo : lo + 8, word] ^ ones)
        # carry-save: 3 words of one weight to a sum and a carry of the next weight
        for weight in range(digits):
            level, carry = [count[weight], *pending], []
            while len(level) > 1:
                a, b = level.pop(), level.pop()
                if level:
                    c = level.pop()
                    ab = a ^ b
                    carry.append((a & b) | (ab & c))
                    level.append(ab ^ c)
                else:
                    carry.append(a & b)
                    level.append(a ^ b)
            count[weight], pending = level[0], carry
            if not pending:
                break
        if lo + 8 > least:
            alive = alive & ~_exceeds(count, limit)
            keep = alive != zero
            left = int(keep.sum())
            if not left:
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if left < 0.8 * len(keep):
                ask, word, alive = ask[keep], word[keep], alive[keep]
                count, limit = [c[keep] for c in count], [c[keep] for c in limit]
    hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(hit)
    return ask[at], word[at] * 64 + bit


def _exceeds(count: list[np.ndarray], limit: list[np.ndarray]) -> np.ndarray:
    """Bitwise comparator: rows whose vertical counter is above the entry's radius."""
    above = np.zeros_like(count[0])
    equal = ~above
    for c, r in zip(reversed(count), reversed(limit)):
        above |= equal & c & ~r
        equal &= ~(c ^ r)
    return above


def bucket_pairs(bucket: np.ndarray, ids: np.ndarray, size: np.ndarray, most: np.ndarray, sketch: np.ndarray, side: np.ndarray, similarity: float = SIMILARITY, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (smaller id first) of many buckets at once, whatever their sizes.

    Rows come in order of their bucket's number and size, so buckets share words of the planes:
    the smaller row of a pair asks, and the rows it may meet - those behind it in its bucket, up
    to ``most``, the largest size its partner may have here - are a range.  Rows of side 0 meet
    all others; rows of sides 1 and 2 only those of the other side.
    """
    n = len(ids)
    # the end of each row's range: the first row of a larger bucket or of a size above the bound
    width = int(max(size.max(initial=0), most.max(initial=0))) + 2
    key = bucket * width + size
    end = np.searchsorted(key, bucket * width + np.minimum(most, width - 2), side="right")
    begin = np.arange(n) + 1
    asking = np.flatnonzero(end > begin)
    if not len(asking):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # as many asking rows at once as list ENTRIES entries together, at least one
    listed = np.cumsum((end[asking] - 1) // 64 - begin[asking] // 64 + 1)
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    plane, bits, wider = planes(sketch), _bits(sketch), None if wide is None else Wide(wide)
    lo = 0
    while lo < len(asking):
        hi = max(lo + 1, int(np.searchsorted(listed, (listed[lo - 1] if lo else 0) + ENTRIES, side="right")))
        a, b = _asked(asking[lo:hi], begin, end, ids, size, most, sketch, plane, bits, side, similarity, wider)
        out_a.append(a)
        out_b.append(b)
        lo = hi
    return np.concatenate(out_a), np.concatenate(out_b)


def _asked(asking: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray, size: np.ndarray, most: np.ndarray, sketch: np.ndarray, plane: np.ndarray, bits: np.ndarray, side: np.ndarray, similarity: float, wider: Wide | None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of the asking rows with the rows of their ranges."""
    first, last = begin[asking] // 64, (end[asking] - 1) // 64
    words_each = last - first + 1
    ask = np.repeat(asking, words_each)
    word = np.repeat(first, words_each) + np.arange(len(ask)) - np.repeat(np.cumsum(words_each) - words_each, words_each)
    lo = np.maximum(begin[ask] - word * 64, 0).astype(np.uint64)
    hi = np.minimum(end[ask] - word * 64, 64)
    full = ~np.uint64(0)
    wanted = (full << lo) & (full >> (64 - hi).astype(np.uint64))
    radius = most_apart(size[ask], size[word * 64 + hi - 1], similarity)
    i, j = _within(plane, bits, ask, word, wanted, radius)
    good = (size[i] <= most[j]) & (ids[i] != ids[j]) & ((side[i] == 0) | (side[i] != side[j]))
    i, j = i[good], j[good]
    apart = most_apart(size[i], size[j], similarity)
    near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= apart
    if wider is not None:
        near &= wider.near(i, j, apart)
    a, b = ids[i[near]], ids[j[near]]
    return np.minimum(a, b), np.maximum(a, b)


def _compare_batches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (run, unit): each run of one key is a bucket, possibly over several batches."""
        rest: list[np.ndarray] | None = None
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        held = 0

        def emit():
            nonlocal held
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            out_a.clear()
            out_b.clear()
            held = 0
            pair = np.unique(np.stack([a, b], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        def work(cols: list[np.ndarray], closed: bool):
            nonlocal rest, held
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            key, unit, side, ids, size, most, *parts, wide = cols
            if not len(key):
                rest = None
                return
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])
            end = len(key) if closed else int(np.flatnonzero(new)[-1])
            bucket = np.cumsum(new[:end]) - 1
            several = np.bincount(bucket)[bucket] > 1
            sketch = np.stack([p[:end][several] for p in parts], axis=1).view(np.uint64)
            a, b = bucket_pairs(bucket[several], *(x[:end][several] for x in (ids, size, most)), sketch, side[:end][several], similarity, wide[:end][several])
            if len(a):
                out_a.append(a)
                out_b.append(b)
                held += len(a)
            rest = None if closed else [c[end:] for c in cols]

        for b in batches:
            work([b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)], False)
            if held > 200_000:
                yield emit()
        if rest is not None:
            work([np.empty(0, c.dtype) for c in rest], True)
        if held:
            yield emit()

    return run


def _verify_batches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi in _slices([x + y for x, y in zip(left, right)], 6_000_000):
                part = b.slice(lo, hi - lo)
                both, either = shared_runs(left[lo:hi], right[lo:hi])
                good = (either > 0) & (both >= similarity * either - 1e-9)
                keep = pa.array(np.flatnonzero(good))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(both[good] / either[good])], names=["a", "b", "similarity"])

    return run


def shared_runs(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts, the distinct runs found in both and in either; compared as words, not as hashes."""
    number: dict[str, int] = {}
    texts: dict[str, int] = {}
    lists: list[list[int]] = []
    for t in (*left, *right):
        if t not in texts:
            texts[t] = len(lists)
            lists.append([number.setdefault(w, len(number) + 1) for w in words(t)])
    flat = np.array([w for ws in lists for w in ws], dtype=np.int64)
    lengths = np.array([len(ws) for ws in lists], dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    m = max(0, len(flat) - WORDS + 1)
    whole = row[:m] == row[WORDS - 1 :]
    # runs numbered exactly: by their words' numbers side by side, where these fit 63 bits
    bits = (len(number) + 1).bit_length()
    run = flat[:m]
    for k in range(1, WORDS):
        if (k + 1) * bits > 63:
            run = np.unique(run, return_inverse=True)[1]
        run = run << bits | flat[k : m + k]
    row, run = row[:m][whole], run[whole]
    kinds, run = np.unique(run, return_inverse=True)
    n_runs = max(1, len(kinds))
    own = np.unique(row * n_runs + run)
    row, run = own // n_runs, own % n_runs
    size = np.bincount(row, minlength=len(lists))
    first = np.cumsum(size) - size
    a, b = np.array([texts[t] for t in left], dtype=np.int64), np.array([texts[t] for t in right], dtype=np.int64)
    # each run of the left text is looked up among the right one's, which are sorted
    pair = np.repeat(np.arange(len(a)), size[a])
    asked = run[first[a][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(size[a]) - size[a], size[a])]
    key = b[pair] * n_runs + asked
    at = np.minimum(np.searchsorted(own, key), max(0, len(own) - 1))
    both = np.bincount(pair[own[at] == key] if len(own) else pair, minlength=len(a))
    return both, size[a] + size[b] - both


def class_links(rows: DataFrame, *, row_no: str = "chunk_no", text: str = "text", similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members: row_no, rep, copies), (links: a, b, similarity between class representatives)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "neardup")
    source = rows.where(F.col(text).isNotNull()).select(F.col(row_no).cast("long").alias("row_no"), F.col(text).alias("text"))
    counted = run_counts(source)
    counts = spark.sparkContext.broadcast(counted)
    sketch = scratch.keep(source.mapInArrow(_sketch_batches(counts, similarity), _SKETCH), "sketches")
    classes = sketch.groupBy("k1", "k2").agg(F.min("row_no").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")
    members = scratch.keep(sketch.select("row_no", "k1", "k2").join(classes, ["k1", "k2"]).select("row_no", "rep", "copies"), "members")
    others = scratch.keep(members.where(F.col("row_no") != F.col("rep")).select("row_no"), "others")
    reps = scratch.keep(sketch.where(F.col("size") > 0).join(small(others, BROADCAST_ROWS), "row_no", "left_anti").drop("k1", "k2"), "reps")
    for done in (sketch, classes, others):
        scratch.drop(done)
    scratch.free()

    candidates = _candidates(scratch, reps, counted, similarity, bucket_rows)
    scratch.drop(reps)
    scratch.free()

    wanted = candidates.select(F.col("a").alias("row_no")).unionByName(candidates.select(F.col("b").alias("row_no"))).distinct()
    wanted = small(scratch.keep(wanted, "wanted"), BROADCAST_ROWS)
    texts = scratch.keep(source.join(wanted, "row_no", "left_semi"), "texts")
    scratch.free()
    links = (
        candidates.join(texts.select(F.col("row_no").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("row_no").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(_verify_batches(similarity), "a long, b long, similarity double")
    )
    links = scratch.keep(links.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links")
    for done in (candidates, texts):
        scratch.drop(done)
    scratch.free()
    return members, links


def _candidates(scratch: Scratch, reps: DataFrame, counted: np.ndarray, similarity: float, bucket_rows: int) -> DataFrame:
    """Distinct pairs a < b of compared rows that share a bucket and whose sketches are near enough."""
    spark = scratch.spark
    # what follows a pair's first common run bounds what it shares, and so the size of a partner met there
    partner = F.floor((F.col("size") - F.col("pos")) * F.lit((1 + similarity) / similarity) + F.lit(1e-6)).cast("int") - F.col("size")
    own = ["row_no", "size", "most", *_BITS, "wide"]
    met = reps.select("*", F.posexplode("prefix").alias("pos", "run")).where(F.col("pos") < F.col("length")).withColumn("most", partner)
    n_reps, n_postings = reps.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    bound = max(LEAST_POSTINGS, ROUND_POSTINGS * n_reps)
    found: list[DataFrame] = []

    def rounds(postings: int) -> int:
        return max(1, -(-postings // bound))

    def part(df: DataFrame, k: int, n: int, *key: str) -> DataFrame:
        """Round k of n: every key is in one of them."""
        return df if n == 1 else df.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k)

    def compare(units: DataFrame, postings: int) -> None:
        n = rounds(postings)
        for k in range(n):
            sorted_ = part(units, k, n, "run", "unit").repartition(partitions(spark), "run", "unit").sortWithinPartitions("run", "unit", "size")
            found.append(scratch.keep(sorted_.mapInArrow(_compare_batches(similarity), "a long, b long").distinct(), "found"))
            if n > 1:
                scratch.free()

    def crowded(p: DataFrame, name: str) -> DataFrame:
        """Runs met by more rows than one task should compare; counted with map-side combination."""
        return scratch.keep(p.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows), name)

    def whole(p: DataFrame) -> DataFrame:
        return p.select("run", F.lit(0).cast("long").alias("unit"), F.lit(0).alias("side"), *own)

    # a run's counter holds all its occurrences, so a crowded run has a crowded counter; the others needn't be counted again
    heavy = np.flatnonzero(counted > bucket_rows)
    if not len(heavy):
        compare(whole(met), n_postings)
    else:
        counters = spark.createDataFrame(pa.table({"counter": heavy.astype(np.int64)}))
        maybe = met.select("run").withColumn("counter", F.shiftrightunsigned("run", 64 - COUNTER_BITS))
        hot = crowded(maybe.join(F.broadcast(counters) if len(heavy) <= BROADCAST_ROWS else counters, "counter", "left_semi"), "hot")
        hot_runs = small(hot, BROADCAST_ROWS).select("run")
        n_hot = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        compare(whole(met.join(hot_runs, "run", "left_anti") if n_hot else met), n_postings - n_hot)
        if n_hot:
            # two similar rows share a second run behind the first one, no further than the run behind their prefixes:
            # a crowded bucket is divided by it (a row of a single run has no second one and meets only its like)
            behind = F.when(F.col("size") == 1, F.array("run")).otherwise(F.slice("prefix", F.col("pos") + 2, F.size("prefix")))
            crowd = met.join(hot_runs, "run", "left_semi").withColumn("behind", behind)
            n = rounds(crowd.agg(F.sum(F.size("behind"))).first()[0])
            for k in range(n):
                divided = part(crowd, k, n, "run").select("run", F.explode("behind").alias("second"), *own).withColumn("run", F.xxhash64("run", "second")).drop("second")
                hotter = crowded(divided, "hotter")
                blocks = F.ceil(F.col("n") / F.lit(max(1, bucket_rows // 2))).cast("int")
                n_divided = bound  # the rounds hold about as many
                copied = hotter.agg(F.sum(F.col("n") * blocks)).first()[0]
                if not copied:
                    compare(whole(divided), n_divided)
                    continue
                hotter = small(hotter, BROADCAST_ROWS)
                compare(whole(divided.join(hotter.select("run"), "run", "left_anti")), n_divided)
                # what is still crowded is cut into blocks: block x meets every block y in unit (min, max), as sides 1 and 2; its own pairs are unit (x, x)
                placed = divided.join(hotter, "run").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row_no"), F.col("blocks")).cast("int"))
                placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                lo, hi = F.least("block", "other"), F.greatest("block", "other")
                side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") == lo, 1).otherwise(2).cast("int")
                compare(placed.select("run", (lo * F.col("blocks") + hi).cast("long").alias("unit"), side.alias("side"), *own), copied)
                scratch.free()
    if len(found) == 1:
        return found[0]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = scratch.keep(pairs.distinct(), "candidates")
    for done in found:
        scratch.drop(done)
    return pairs


def found(rows: DataFrame) -> DataFrame:
    """chunk_a, chunk_b: every pair of rows of one class and of linked classes."""
    members, links = class_links(rows)
    several = members.where(F.col("copies") > 1)
    left = several.select("rep", F.col("row_no").alias("chunk_a"))
    right = several.select("rep", F.col("row_no").alias("chunk_b"))
    inside = left.join(right, "rep").where(F.col("chunk_a") < F.col("chunk_b")).select("chunk_a", "chunk_b")
    a = members.select(F.col("rep").alias("a"), F.col("row_no").alias("row_a"))
    b = members.select(F.col("rep").alias("b"), F.col("row_no").alias("row_b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select(F.least("row_a", "row_b").alias("chunk_a"), F.greatest("row_a", "row_b").alias("chunk_b"))
    return inside.unionByName(across)


def groups(rows: DataFrame) -> DataFrame:
    """row_no, rep (its class's first row), copies, links: one row per row."""
    members, links = class_links(rows)
    n = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(n, "rep", "left").select("row_no", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
