"""Evaluation texts leaking into training text (problem 8).

Method.  The test items form an inverted index with BM25 weights: for every term the
items that hold it and their weights, and the blocks of items that hold it and each
block's largest weight.  Terms are ``TERM`` consecutive words, which tell passages apart
far better than single words do where everybody uses the same ones.  Every
document is cut into overlapping passages of ``PASSAGE`` words, and every passage
queries the index: the sum of its terms' block maxima bounds the score of every item
of a block, so blocks whose bound stays below their lowest threshold are skipped
(block-max WAND, for all passages of a batch at once, after a first bound over all
blocks together); the items of the others are
scored, and all at or above their threshold are retrieved.  An item's threshold is
the lowest score that any ``RUN`` consecutive words of it (all words of a shorter
item) can have, and passages overlap by ``RUN`` - 1 words, so no leak is lost.  Items
of fewer than ``TERM`` words hold no term; they are looked up as a whole.
Retrieved items are verified on the words themselves: runs of ``RUN`` words that
passage and item share, joined to the longest run, and the shares of the item's
question and answer that the document covers.

The index grows with the items' words, not with their number times that of the terms
(about 60 bytes a word); it is broadcast after its words have been counted and found
within ``MAX_WORDS`` and ``MAX_VOCABULARY``.  More items are processed in groups of that
size, one pass over the documents each.  Documents are neither shuffled nor cut to
prefixes.

Defined results: null and wordless texts have no leaks; null or wordless items leak
nowhere; equal items leak alike; a repeated doc_id is reported once per item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import mix, words

RUN = 12
TERM = 3
PASSAGE = 32
BLOCK = 16
K1, B = 1.2, 0.75
#: Words and distinct words of the items in one index (about 240 MB; term keys of distinct words fit 63 bits).
MAX_WORDS, MAX_VOCABULARY = 4_000_000, 2_000_000
#: Words handled at once; bounds the arrays of a task.
SLICE = 60_000


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        return 0


def _expand(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the rows, place) of every entry of these rows of a table in compressed form."""
    size = offsets[rows + 1] - offsets[rows]
    nth = np.repeat(np.arange(len(rows)), size)
    return nth, offsets[rows][nth] + np.arange(len(nth)) - np.repeat(np.cumsum(size) - size, size)


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their weights; counted in place where the keys lie close, else sorted."""
    if not len(key):
        return key, weight
    low = int(key.min())
    if int(key.max()) - low <= 4 * len(key):
        sums = np.bincount(key - low, weight)
        kept = np.flatnonzero(sums)  # weights are positive
        return kept + low, sums[kept]
    keys, of = np.unique(key, return_inverse=True)
    return keys, np.bincount(of, weight, len(keys))


def _offsets(row: np.ndarray, rows: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])


class ItemIndex:
    """Inverted index of a group of test items: BM25 postings, block maxima and thresholds."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN) -> None:
        kept = [(i, t, w) for i, t, w in ((i, t, words(t)) for i, t in items) if w]
        self.run = run
        self.vocabulary = {t: k + 1 for k, t in enumerate(sorted({t for _, _, w in kept for t in w}))}  # 0: a word of no item
        self.span = len(self.vocabulary) + 1
        codes = [np.array([self.vocabulary[t] for t in w], dtype=np.int64) for _, _, w in kept]
        pairs = [_term_keys(c, self.span) for c in codes]
        self.keys, df = np.unique(np.concatenate([np.unique(p) for p in pairs] or [np.empty(0, np.int64)]), return_counts=True)
        terms = [np.searchsorted(self.keys, p) for p in pairs]
        # items of like vocabulary share blocks: they lie in order of their rarest term
        rarest = [int(t[np.lexsort((t, df[t]))[0]]) if len(t) else -1 for t in terms]
        order = sorted(range(len(kept)), key=lambda k: (rarest[k], kept[k][0]))
        self.ids = [kept[k][0] for k in order]
        self.question = [_question_words(kept[k][1]) for k in order]
        codes, terms = [codes[k] for k in order], [terms[k] for k in order]
        n = len(order)
        self.length = np.array([min(run, len(c)) for c in codes], dtype=np.int64)
        self.codes, self.code_at = np.concatenate([*codes, np.empty(0, np.int64)]).astype(np.int32), np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        # postings by term: the items that hold it and their weights
        held = np.array([len(t) for t in terms], dtype=np.int64)
        item = np.repeat(np.arange(n), held)
        flat = np.concatenate([*terms, np.empty(0, np.int64)]).astype(np.int64)
        both, times = np.unique(flat * max(n, 1) + item, return_counts=True)
        term, self.item = both // max(n, 1), (both % max(n, 1)).astype(np.int32)
        self.at = _offsets(term, len(df))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = held.mean() if n and held.any() else 1.0
        self.weight = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * held[self.item] / mean))
        # a run's own sum bounds the score of a passage that holds it from below: a passage's repeated terms add up
        self.threshold = np.full(n, np.inf)
        each = self.weight[np.searchsorted(both, flat * max(n, 1) + item)]
        start = np.cumsum(held) - held
        for k in np.flatnonzero(held):
            m = int(self.length[k]) - TERM + 1
            sums = np.concatenate([[0.0], np.cumsum(each[start[k] : start[k] + held[k]])])
            self.threshold[k] = (sums[m:] - sums[:-m]).min() * (1 - 1e-9) - 1e-6
        # block maxima by term
        n_blocks = -(-n // BLOCK)
        where, first = np.unique(term * max(n_blocks, 1) + self.item // BLOCK, return_index=True)
        self.block = (where % max(n_blocks, 1)).astype(np.int32)
        self.block_at = _offsets(where // max(n_blocks, 1), len(df))
        self.maxima = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.tops = np.concatenate([[0.0], np.maximum.reduceat(self.maxima, self.block_at[:-1]) if len(df) else []])
        self.block_threshold = np.minimum.reduceat(self.threshold, np.arange(0, n, BLOCK)) if n else np.empty(0)
        # every item's runs, sorted within the item; short items' runs over all items
        hashes = [_gram_hashes(c, int(m)) for c, m in zip(codes, self.length)]
        place = [np.argsort(h, kind="stable") for h in hashes]
        self.gram = np.concatenate([*(h[p] for h, p in zip(hashes, place)), np.empty(0, np.uint64)]).astype(np.uint64)
        self.gram_place = np.concatenate([*place, np.empty(0, np.int64)]).astype(np.int32)
        self.gram_at = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, TERM):
            mine = np.flatnonzero(self.length == m)
            if len(mine):
                whole = np.array([hashes[k][0] for k in mine], np.uint64)
                by = np.argsort(whole, kind="stable")
                self.short[m] = whole[by], mine[by]

    def item_codes(self, k: int) -> np.ndarray:
        return self.codes[self.code_at[k] : self.code_at[k + 1]]

    def shared(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes, place in item k) of the runs that occur in the item."""
        mine = self.gram[self.gram_at[k] : self.gram_at[k + 1]]
        lo, hi = np.searchsorted(mine, hashes, "left"), np.searchsorted(mine, hashes, "right")
        size = hi - lo
        nth = np.repeat(np.arange(len(hashes)), size)
        return nth, self.gram_place[self.gram_at[k] + lo[nth] + np.arange(len(nth)) - np.repeat(np.cumsum(size) - size, size)]

    def terms(self, codes: np.ndarray) -> np.ndarray:
        """The term that begins at each word; 0 where none of the items' does."""
        out = np.zeros(len(codes), np.int32)
        known = codes > 0
        whole = known[: len(codes) - TERM + 1].copy()
        for k in range(1, TERM):
            whole &= known[k : len(codes) - TERM + 1 + k]
        at_word = np.flatnonzero(whole)
        if len(at_word) and len(self.keys):
            key = codes[at_word]
            for k in range(1, TERM):
                key = key * self.span + codes[at_word + k]
            at = np.searchsorted(self.keys, key)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key
            out[at_word[hit]] = at[hit] + 1
        return out

    def retrieve(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all items with terms at or above their threshold."""
        none = np.empty(0, np.int64)
        size = np.diff(np.append(starts, len(terms)))
        some = np.add.reduceat(self.tops[terms], starts) >= self.block_threshold.min(initial=np.inf)
        if not some.any():
            return none, none
        passage = np.repeat(np.arange(len(starts)), size)
        kept = some[passage] & (terms > 0)
        passage, term = passage[kept], terms[kept].astype(np.int64) - 1
        # blocks whose maxima can reach their lowest threshold
        n_blocks, n = len(self.block_threshold), len(self.threshold)
        nth, at = _expand(self.block_at, term)
        pair, bound = _sums(passage[nth] * n_blocks + self.block[at], self.maxima[at])
        alive = pair[bound >= self.block_threshold[pair % n_blocks]]
        if not len(alive):
            return none, none
        # their items, scored in full
        open_ = np.isin(passage, alive // n_blocks)
        passage, term = passage[open_], term[open_]
        nth, at = _expand(self.at, term)
        block = passage[nth] * n_blocks + self.item[at] // BLOCK
        here = alive[np.minimum(np.searchsorted(alive, block), len(alive) - 1)] == block
        nth, at = nth[here], at[here]
        pair, score = _sums(passage[nth] * n + self.item[at], self.weight[at])
        good = pair[score >= self.threshold[pair % n]]
        return good // n, good % n


def _gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    if len(codes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix(codes[k : len(codes) - n + 1 + k].astype(np.uint64))
    return h


def _term_keys(codes: np.ndarray, span: int) -> np.ndarray:
    key = codes[: max(0, len(codes) - TERM + 1)]
    for k in range(1, TERM):
        key = key * span + codes[k : len(key) + k]
    return key


def _question_words(text: str) -> int:
    """Words of the question; a text without a question mark is all answer."""
    head, mark, _ = text.partition("?")
    return len(words(head)) if mark else 0


def _scan(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = held.value
        known = _Codes(index.vocabulary)
        step = PASSAGE - index.run + 1

        def work(docs: list, codes: np.ndarray, lengths: np.ndarray):
            # passages: windows of PASSAGE words every step words, the last one shorter
            doc_start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            n_pass = np.maximum(1, -(-(lengths - index.run + 1) // step))
            doc = np.repeat(np.arange(len(docs)), n_pass)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)
            begin = doc_start[doc] + nth * step
            size = np.minimum(PASSAGE, doc_start[doc] + lengths[doc] - begin)
            # a passage's terms lie inside it; one too short for a term keeps an empty one
            pairs = np.maximum(size - TERM + 1, 1)
            starts = np.concatenate([[0], np.cumsum(pairs)[:-1]])
            at = np.repeat(begin - starts, pairs) + np.arange(pairs.sum())
            terms = index.terms(codes)[at]
            terms[np.repeat(size < TERM, pairs)] = 0
            p, k = index.retrieve(terms, starts)
            hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
            hashes: dict[int, np.ndarray] = {}
            for x, item in zip(p.tolist(), k.tolist()):
                m = int(index.length[item])
                if m not in hashes:
                    hashes[m] = _gram_hashes(codes, m)
                lo = int(begin[x])
                j, i = index.shared(item, hashes[m][lo : lo + max(0, int(size[x]) - m + 1)])
                if len(j):
                    hits.setdefault((int(doc[x]), item), []).extend(zip((j + lo).tolist(), i.tolist()))
            for m, (whole, items) in index.short.items():
                h = _gram_hashes(codes, m)
                lo, hi = np.searchsorted(whole, h, "left"), np.searchsorted(whole, h, "right")
                owner = np.searchsorted(doc_start, np.arange(len(h)), "right") - 1
                inside = (hi > lo) & (np.arange(len(h)) + m <= doc_start[owner] + lengths[owner])
                for j in np.flatnonzero(inside).tolist():
                    for item in items[lo[j] : hi[j]].tolist():
                        hits.setdefault((int(owner[j]), item), []).append((j, 0))
            out = []
            for (d, item), places in hits.items():
                got = _verify(codes, sorted(set(places)), index.item_codes(item), int(index.length[item]), index.question[item])
                if got:
                    out.append((docs[d], index.ids[item], *got))
            return out

        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            ids: list = []
            flat: list[int] = []
            lengths: list[int] = []
            rows: list[tuple] = []
            for doc, text in zip(docs, texts):
                w = words(text)
                if not w:
                    continue
                flat.extend(map(known.__getitem__, w))
                lengths.append(len(w))
                ids.append(doc)
                if len(flat) >= SLICE:
                    rows += work(ids, np.array(flat, dtype=np.int64), np.array(lengths))
                    ids, flat, lengths = [], [], []
            if ids:
                rows += work(ids, np.array(flat, dtype=np.int64), np.array(lengths))
            if rows:
                names = ["doc_id", "item_id", "longest_run", "question_share", "answer_share"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _verify(codes: np.ndarray, places: list[tuple[int, int]], item: np.ndarray, m: int, question: int) -> tuple[int, float, float] | None:
    """Longest common run (at least m words) and the shares of the item covered by such runs.

    places: where runs of m words begin in the text and in the item, in order.
    """
    covered = np.zeros(len(item), bool)
    longest = 0
    ends: dict[tuple[int, int], int] = {}
    for j, i in places:
        if np.array_equal(codes[j : j + m], item[i : i + m]):
            ends[j, i] = length = ends.pop((j - 1, i - 1), m - 1) + 1
            covered[i : i + m] = True
            longest = max(longest, length)
    if not longest:
        return None
    return longest, float(covered[:question].mean()) if question else 0.0, float(covered[question:].mean()) if question < len(item) else 0.0


def leaks(documents: DataFrame, items: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, item_id, longest_run, question_share, answer_share of every leak."""
    texts = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    schema = "doc_id long, item_id long, longest_run int, question_share double, answer_share double"
    out = None
    group: list[tuple[int, str]] = []
    held, distinct = 0, set()

    def scan(group: list[tuple[int, str]]) -> DataFrame:
        index = documents.sparkSession.sparkContext.broadcast(ItemIndex(group))
        return texts.mapInArrow(_scan(index), schema)

    for row in rows.toLocalIterator():  # a group of bounded size at a time, never all items
        group.append((row.item_id, row.text))
        its = words(row.text)
        held += len(its)
        distinct.update(its)
        if held >= max_words or len(distinct) >= min(max_words, MAX_VOCABULARY):
            out = scan(group) if out is None else out.unionByName(scan(group))
            group, held, distinct = [], 0, set()
    if group:
        out = scan(group) if out is None else out.unionByName(scan(group))
    if out is None:
        return texts.sparkSession.createDataFrame([], schema)
    # a repeated doc_id may hold an item twice; its strongest leak counts
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("longest_run", "question_share", "answer_share")))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")
