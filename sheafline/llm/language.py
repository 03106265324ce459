"""Missing or wrong document language labels (problem 9).

Method.  One character language model per language: interpolated Kneser-Ney of order
``ORDER`` over the characters of words (with both word limits), fitted on labelled
samples.  The models' probabilities lie in sorted hash arrays, one per order, with a
column per language; an n-gram unseen in a language carries its interpolated
lower-order value.  A sentence takes the language of lowest cross-entropy per
character; it is rejected where even that exceeds the threshold calibrated on
held-out samples with simulated scanning errors, and its confidence is the posterior
at the temperature that fits those samples, and short pieces of them, best.  A
sentence less sure than ``SURE`` takes the likeliest of the languages in which its
text has surer ones, if there are any.  A word's score doesn't depend on
its neighbours, so each distinct word is scored once per task and remembered.

Sentences end at ``.``, ``!``, ``?`` or ``…`` within a line and hold at least
``MIN_WORDS`` words; headings, contents lines, captions and page lines don't.

Defined results: null and blank texts have no segments; a text without sentences has
no language; whole texts are read, whatever their length; without usable samples the
model can't be fitted and the call fails with a ValueError.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import WORD, mix

LANGUAGES = ("fr", "en", "de", "es", "it", "pt", "nl")
ORDER = 5
#: At most so many labelled sample rows are used for fitting.
MAX_SAMPLES = 20_000
MIN_WORDS = 4
SURE = 0.98
#: Remembered words per task.
MEMORY = 200_000
#: Letters that the models know; all others count as one.
_OTHER = "\x03"
_BEGIN, _END = "\x01", "\x02"

# Other names of the languages' codes.
NAMES = {
    "fr": ("fra", "fre", "french", "francais", "français"),
    "en": ("eng", "english", "anglais"),
    "de": ("deu", "ger", "german", "deutsch"),
    "es": ("spa", "spanish", "espanol", "español", "castellano"),
    "it": ("ita", "italian", "italiano"),
    "pt": ("por", "portuguese", "portugues", "português"),
    "nl": ("nld", "dut", "dutch", "nederlands"),
}


def label_language(label: Column) -> Column:
    """The code a label names, in whatever spelling; null if it names none of ours."""
    base = F.regexp_extract(F.lower(F.trim(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))), r"^(\p{L}+)(?:[-_].*)?$", 1)
    out = F.when(base.isin(*LANGUAGES), base)
    for code, names in NAMES.items():
        out = out.when(base.isin(*names), F.lit(code))
    return out


def _strip(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams whose k-th characters are the k-th column; their length counts too."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = mix(h + c)
    return h


def _hash_grams(grams: list[str]) -> np.ndarray:
    """Hashes of n-grams of any lengths."""
    out = np.empty(len(grams), np.uint64)
    lengths = np.array([len(g) for g in grams])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        codes = _codes([grams[i] for i in at]).reshape(-1, n)
        out[at] = _hash([codes[:, k] for k in range(n)])
    return out


class KneserNey:
    """Interpolated Kneser-Ney character models of all languages in sorted hash arrays."""

    def __init__(self, samples: list[tuple[str, str]], order: int = ORDER) -> None:
        self.order = order
        self.languages = [x for x in LANGUAGES if any(l == x for l, _ in samples)]
        if len(self.languages) < 1:
            raise ValueError("no labelled samples of a known language")
        bags = {x: Counter() for x in self.languages}
        for lang, text in samples:
            if lang in bags:
                for w in WORD.findall(text.lower()):
                    if not w.isdigit():
                        bags[lang][w] += 1
                        bags[lang][_strip(w)] += 1
        letters = sorted({c for b in bags.values() for w in b for c in w if not c.isdigit()})
        self.letters = set(letters)
        size = len(letters) + 2  # the end of a word and the unknown letter
        tables: list[dict[str, np.ndarray]] = []
        per_lang = [self._fit(bags[x], size) for x in self.languages]
        self.floor = np.full(len(self.languages), -np.log2(size))
        # columns: an n-gram seen in any language has its probability in every language
        for n in range(1, order + 1):
            grams = sorted({g for model in per_lang for g in model[n - 1][0]})
            rows = np.empty((len(grams), len(self.languages)))
            for j, g in enumerate(grams):
                for k, model in enumerate(per_lang):
                    rows[j, k] = self._probability(model, g, size)
            h = _hash_grams(grams)
            at = np.argsort(h)
            tables.append({"hash": h[at], "value": np.log2(rows[at])})
        self.tables = tables
        # what a history without the wanted next letter hands down, per language
        histories = sorted({h for model in per_lang for n in range(1, order) for h in model[n][1]})
        backoff = [[np.log2(model[len(h)][1][h][1]) if h in model[len(h)][1] else 0.0 for model in per_lang] for h in histories]
        h = _hash_grams(histories)
        at = np.argsort(h)
        self.back_hash = h[at]
        self.back = np.array(backoff).reshape(len(histories), len(self.languages))[at]
        self.threshold = np.inf
        self.temperature = 1.0

    def _fit(self, bag: Counter, size: int):
        """For each order (counts, {history: (total, share handed down)}); lower orders count distinct left letters."""
        full = [Counter() for _ in range(self.order)]
        for w, c in bag.items():
            padded = _BEGIN + w + _END
            for i in range(1, len(padded)):
                for n in range(1, self.order + 1):
                    if i - n + 1 >= 0:
                        full[n - 1][padded[i - n + 1 : i + 1]] += c
        out = []
        for n in range(1, self.order + 1):
            if n == self.order:
                counts = dict(full[n - 1])
            else:
                counts = Counter()
                for g in full[n]:
                    counts[g[1:]] += 1
                for g, c in full[n - 1].items():  # nothing can stand left of a word's begin
                    if g[0] == _BEGIN:
                        counts[g] = c
                counts = dict(counts)
            ones = sum(1 for c in counts.values() if c == 1)
            twos = sum(1 for c in counts.values() if c == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total: Counter = Counter()
            kinds: Counter = Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            out.append((counts, {h: (t, discount * kinds[h] / t) for h, t in total.items()}, discount))
        return out

    def _probability(self, model, gram: str, size: int) -> float:
        p = 1.0 / size
        for n in range(1, len(gram) + 1):
            g = gram[-n:]
            counts, histories, discount = model[n - 1]
            h = histories.get(g[:-1])
            if h:
                p = max(counts.get(g, 0) - discount, 0) / h[0] + h[1] * p
        return p

    def _find(self, hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(hashes, wanted)
        at[at == len(hashes)] = 0
        return at, (hashes[at] == wanted) if len(hashes) else np.zeros(len(wanted), bool)

    def words(self, ws: list[str]) -> np.ndarray:
        """[words, languages + 1]: log2 probability of a word's characters in each language, then their number.

        All characters of all words at once: an order's n-grams are looked up together, and only the
        characters that it doesn't hold go on to the next lower one with what their history hands down.
        """
        padded = [_BEGIN + "".join(c if c in self.letters else _OTHER for c in w) + _END for w in ws]
        lengths = np.array([len(p) for p in padded], dtype=np.int64)
        codes = _codes(padded)
        starts = np.cumsum(lengths) - lengths
        start = np.repeat(starts, lengths)
        place = np.arange(len(codes))
        skipped = np.array([w.isdigit() for w in ws], bool)
        open_ = (place > start) & ~np.repeat(skipped, lengths)
        total = np.zeros((len(codes), len(self.languages)))
        down = np.zeros_like(total)
        for n in range(self.order, 0, -1):
            at = np.flatnonzero(open_ & (place - n + 1 >= start))
            if not len(at):
                continue
            columns = [codes[at - n + 1 + k] for k in range(n)]
            row, hit = self._find(self.tables[n - 1]["hash"], _hash(columns))
            total[at[hit]] = down[at[hit]] + self.tables[n - 1]["value"][row[hit]]
            open_[at[hit]] = False
            if n > 1 and not hit.all():
                row, known = self._find(self.back_hash, _hash([c[~hit] for c in columns[:-1]]))
                down[at[~hit][known]] += self.back[row[known]]
        total[open_] = down[open_] + self.floor
        return np.column_stack([np.add.reduceat(total, starts), np.where(skipped, 0, lengths - 1)])


class Scorer:
    """Sentence scores with remembered words."""

    def __init__(self, model: KneserNey) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.languages) + 1))

    def _learn(self, words: list[str]) -> None:
        new = sorted(set(words).difference(self.known))
        if not new:
            return
        n = len(self.known)
        while n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(new)] = self.model.words(new)
        self.known.update(zip(new, range(n, n + len(new))))

    def score(self, sentences: list[list[str]]) -> np.ndarray:
        """[sentences, languages + 1]: summed log2 probabilities and number of characters."""
        if len(self.known) > MEMORY:
            self.known.clear()
        flat = [w for ws in sentences for w in ws]
        if not flat:
            return np.zeros((len(sentences), self.rows.shape[1]))
        self._learn(flat)
        lengths = np.array([len(ws) for ws in sentences], dtype=np.int64)
        numbers = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        some = lengths > 0
        out = np.zeros((len(sentences), self.rows.shape[1]))
        out[some] = np.add.reduceat(self.rows[numbers], (np.cumsum(lengths) - lengths)[some], axis=0)
        return out

    def decide(self, sentences: list[list[str]], texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, confidence, cross-entropy) of each sentence; texts: the text's number of each."""
        s = self.score(sentences)
        logp, n = s[:, :-1], np.maximum(s[:, -1], 1)
        best = logp.argmax(axis=1)
        top = logp[np.arange(len(s)), best]
        entropy = -top / n
        share = 1 / np.exp2((logp - top[:, None]) / self.model.temperature).sum(axis=1)
        out = (entropy > self.model.threshold) | (s[:, -1] == 0)
        if texts is not None:
            sure = ~out & (share >= SURE)
            seen = np.zeros((int(texts.max()) + 1, logp.shape[1]), bool)
            seen[texts[sure], best[sure]] = True
            doubt = ~out & ~sure & seen[texts].any(axis=1)
            best[doubt] = np.where(seen[texts[doubt]], logp[doubt], -np.inf).argmax(axis=1)
        best[out] = -1
        return best, share, entropy


def _noisy(text: str, rng: random.Random, rate: float) -> str:
    """Scanning errors: letters lost, doubled, exchanged or turned into others."""
    out = []
    for c in text:
        x = rng.random()
        if not c.isalpha() or x > rate:
            out.append(c)
        elif x < rate / 3:
            out.append(c + c)
        elif x < rate * 2 / 3:
            out.append(chr(97 + rng.randrange(26)))
    return "".join(out)


def fit(samples: list[tuple[str, str]], folds: int = 4, noise: float = 0.08) -> KneserNey:
    """Models of all samples, with threshold and temperature from held-out folds."""
    rng = random.Random(9)
    entropies, cases = [], []
    piece = MIN_WORDS + 1
    for f in range(folds):
        train = [s for i, s in enumerate(samples) if i % folds != f]
        held = [s for i, s in enumerate(samples) if i % folds == f]
        if not train or not held:
            continue
        try:
            model = KneserNey(train)
        except ValueError:
            continue
        scorer = Scorer(model)
        for rate in (0.0, noise):
            texts = [(l, WORD.findall(_noisy(t, rng, rate).lower())) for l, t in held if l in model.languages]
            if not texts:
                continue
            s = scorer.score([w for _, w in texts])
            for (lang, _), row in zip(texts, s):
                if row[-1]:
                    cases.append((row[:-1], model.languages.index(lang)))
                    entropies.append(-row[model.languages.index(lang)] / row[-1])
            short = [(l, w[k : k + piece]) for l, w in texts for k in range(0, len(w) - piece + 1, piece)]
            if short:
                cases += [(row[:-1], model.languages.index(l)) for (l, _), row in zip(short, scorer.score([w for _, w in short])) if row[-1]]
    model = KneserNey(samples)
    if entropies:
        e = np.array(entropies)
        model.threshold = float(e.max() + 2 * e.std())
        grid = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]

        def loss(t: float) -> float:
            return sum(np.log2(np.exp2((x - x.max()) / t).sum()) + (x.max() - x[k]) / t for x, k in cases)

        model.temperature = min(grid, key=loss)
    return model


_MARKER = re.compile(r"\s*(?:(?:[-•*>–—«»\"“]+|#+|\[[^\]\s]{1,12}\]|\d+(?:\.\d+)*[.)]?)\s+|\*+(?=\S))*")
_STOP = re.compile(r"[.!?…]+[\"'»”’)\]*]*(?:\s+[»”\"]+)?(?=\s|$)")


_LEADER = re.compile(r"[.…]{4,}")


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each whole sentence."""
    at = 0
    for line in text.split("\n"):
        lo = _MARKER.match(line).end()
        for m in _STOP.finditer(line, lo):
            ws = WORD.findall(line[lo : m.end()].lower())
            if _LEADER.search(m.group()):
                ws = []
            if len(ws) >= MIN_WORDS and sum(map(str.isalpha, ws)) >= MIN_WORDS:
                yield at + lo, at + m.end(), ws
            lo = m.end()
            while lo < len(line) and line[lo].isspace():
                lo += 1
        at += len(line) + 1


_SEGMENT = "doc_id long, label string, segment_no int, start_pos int, end_pos int, sentences int, lang string, confidence double"


def _segment_batches(model: KneserNey):
    names = ["doc_id", "label", "segment_no", "start_pos", "end_pos", "sentences", "lang", "confidence"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            held, size = [], 0
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            for i, row in enumerate(rows):
                held.append(row)
                size += len(row[2])
                if size > 1_000_000 or i + 1 == len(rows):
                    out = _stretches(scorer, held)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    held, size = [], 0

    return run


def _stretches(scorer: Scorer, rows: list[tuple]) -> list[tuple]:
    """Runs of sentences in one language, text by text; rejected sentences are passed over."""
    found = [(i, *s) for i, row in enumerate(rows) for s in sentences(row[2])]
    if not found:
        return []
    best, share, _ = scorer.decide([x[3] for x in found], np.array([x[0] for x in found]))
    out: list[tuple] = []
    text, lang_before, no, total = -1, -1, 0, 0.0
    for (i, lo, hi, _), lang, conf in zip(found, best.tolist(), share.tolist()):
        if lang < 0:
            continue
        if i != text:
            text, lang_before, no = i, -1, 0
        if lang == lang_before:
            doc, label, n, begin, _, count, name, _ = out[-1]
            total += conf
            out[-1] = (doc, label, n, begin, hi, count + 1, name, total / (count + 1))
        else:
            out.append((rows[i][0], rows[i][1], no, lo, hi, 1, scorer.model.languages[lang], conf))
            no, lang_before, total = no + 1, lang, conf
    return out


def fit_samples(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> KneserNey:
    """Fit on at most ``max_samples`` labelled rows (lang, text): the languages take turns, each in the order of a hash of the text."""
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    rows = samples.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", nth.alias("nth")).orderBy("nth", "lang").limit(max_samples).collect()
    return fit(sorted((r.lang, r.text) for r in rows))


def segments(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """doc_id, label, segment_no, start_pos, end_pos, sentences, lang, confidence of each stretch in one language."""
    model = fit_samples(samples)
    rows = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"), "text")
    return rows.mapInArrow(_segment_batches(model), _SEGMENT)


def document_languages(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """doc_id, lang, sentences, confidence, mixed, label_ok: one row per document and language."""
    parts = segments(documents, samples)
    per = parts.groupBy("doc_id", "label", "lang").agg(F.sum("sentences").alias("sentences"), (F.sum(F.col("confidence") * F.col("sentences")) / F.sum("sentences")).alias("confidence"))
    # a text's languages are at most as many as there are models
    text = per.groupBy("doc_id", "label").agg(F.collect_list(F.struct("lang", "sentences", "confidence")).alias("parts"))
    named = label_language(F.col("label"))
    return text.select("doc_id", "label", (F.size("parts") > 1).alias("mixed"), named.alias("named"), F.explode("parts").alias("p")).select(
        "doc_id", "p.lang", "p.sentences", "p.confidence", "mixed", F.coalesce(F.col("named") == F.col("p.lang"), F.lit(False)).alias("label_ok")
    )


def found(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """doc_id, lang of documents that are unlabelled, wrongly labelled or mixed."""
    per = document_languages(documents, samples)
    return per.where(F.col("mixed") | ~F.col("label_ok")).select("doc_id", "lang").distinct()
