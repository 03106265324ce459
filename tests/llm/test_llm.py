"""Training-text operators: exact against brute force, edge cases, round trips."""

import random
import re
import subprocess
import threading
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheafline.llm import copies, language, leaks, lookalike, neardup, packing, split

WORD = re.compile(r"[^\W_]+")
CHUNK = "chunk_no long, text string, kind string, config_id int, doc_id string, row_no long, raw string, h1 long, band long"
CONFIG = "config_id int, max_tokens int, overlap_sentences int, text string"
SENTENCE = "The site diary for the pump station describes the risk matrix number {}. "


def chunk_rows(spark, rows):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(n, t, k, c, "d", 7, "x", 1, 2) for n, t, k, c in rows], CHUNK)


def values(df):
    return sorted(map(tuple, df.collect()))


# ---------------------------------------------------------------- splitting


def test_pieces_keep_limit_order_and_overlap():
    text = "".join(SENTENCE.format(i) for i in range(200))
    for overlap in (0, 1, 3):
        got = split.pieces(text, 128, overlap, False)
        assert all(hi - lo <= 512 for lo, hi, _ in got) and got[0][0] == 0
        covered = np.zeros(len(text), bool)
        for lo, hi, _ in got:
            covered[lo:hi] = True
        assert all(c.isspace() for c, yes in zip(text, covered) if not yes)
        assert all(shared == overlap for _, _, shared in got[1:])
        assert all(text[:hi].endswith(".") for _, hi, _ in got)
        for (a, b, _), (c, d, shared) in zip(got, got[1:]):
            assert len(re.findall(r"\.(?= |$)", text[c:b])) == shared if c < b else shared == 0


def test_overlap_counts_sentences_not_clauses():
    """Marks before lower-case letters end no sentence, and a valley that leaves no room for the overlap isn't taken."""
    text = "".join(f"Step {i}: the pump runs; the valve, e.g. number {i}, stays shut: all is well. " for i in range(60))
    got = split.pieces(text, 100, 2, False)
    assert len(got) > 5 and all(shared == 2 for _, _, shared in got[1:])
    assert all(text[lo:].startswith("Step") and text[:hi].endswith("well.") for lo, hi, _ in got)
    clauses = "the valve stays shut; " * 40
    assert all(clauses[lo:hi].endswith(";") for lo, hi, _ in split.pieces(clauses, 30, 0, False))


def test_topic_change_is_preferred():
    a, b = "Pumps move water quickly. " * 14, "Invoices list prices clearly. " * 30
    first = split.pieces(a + b, 128, 0, False)[0]
    assert first[1] == len(a.rstrip())


def test_monster_words_tables_and_blank_texts():
    assert all(hi - lo <= 40 for lo, hi, _ in split.pieces("x" * 1001, 10, 2, False))
    assert "".join("x" * 1001)[: split.pieces("x" * 1001, 10, 0, False)[-1][1]] == "x" * 1001
    rows = "\n".join(f"row {i} : value {i}" for i in range(50))
    assert all(rows[lo:].startswith("row") for lo, _, _ in split.pieces(rows, 20, 0, True))
    fields = " ; ".join(f"name {i} : value {i}" for i in range(50))
    assert all(fields[lo:].startswith("name") for lo, _, _ in split.pieces(fields, 20, 0, True))
    assert split.pieces(" " * 999, 10, 1, False) == [(0, 0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.;|\n é", max_size=300), st.integers(1, 20), st.integers(0, 3), st.booleans())
def test_split_properties(text, most, overlap, table):
    got = split.pieces(text, most, overlap, table)
    seen = set()
    for lo, hi, _ in got:
        assert hi - lo <= 4 * most
        seen.update(range(lo, hi))
    assert all(text[i].isspace() for i in range(len(text)) if i not in seen)
    assert all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(got, got[1:]))


def test_split_edge_cases(spark):
    long = "".join(SENTENCE.format(i) for i in range(3000))
    rows = chunk_rows(spark, [(1, long, "text", 1), (2, None, "text", 1), (3, "", None, 1), (4, long, "text", None), (5, long, None, 9), (6, "short", "list", 1), (1, long, "text", 1)])
    cfg = spark.createDataFrame([(1, 128, None, "clash"), (2, None, 1, ""), (None, 5, 1, "")], CONFIG)
    assert [r.chunk_no for r in split.found(rows, cfg).collect()] == [1, 1]
    assert all(r.token_count <= 128 for r in split.split_oversized(rows, cfg).collect())
    assert not split.found(rows.limit(0), cfg).collect()


# ---------------------------------------------------------------- copies


def brute_copies(rows):
    sets = defaultdict(list)
    for n, t, k, _ in rows:
        if t is not None:
            table = k == "table"
            key = tuple(sorted(w for w in (tuple(WORD.findall(f)) for f in re.split("[;|\n\r]", t.lower())) if w)) if table else tuple(WORD.findall(t.lower()))
            sets[table, key].append(n)
    return sorted((min(v), n) for v in sets.values() if len(v) > 1 for n in sorted(v)[1:])


def reformatted(rng, text):
    out = "".join(c.upper() if rng.random() < 0.3 else c for c in text)
    return re.sub(" ", lambda m: rng.choice([" ", "  ", "\t", ", ", " - "]), out)


def test_copies_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        base = " ".join(rng.choice(["pump", "matrix", "état", "Straße", "line", "x2", "αβ"]) for _ in range(rng.randint(1, 4)))
        rows.append((i, base if i % 3 else reformatted(rng, base), rng.choice(["text", "table", None]), 1))
    for i in range(150, 220):
        fields = [f"{k} : {rng.randint(1, 2)}" for k in ("size", "unit")]
        rng.shuffle(fields)
        rows.append((i, rng.choice([" ; ", "|", "\n"]).join(fields), rng.choice(["table", "text"]), 1))
    rows += [(300, None, "text", 1), (301, "", "text", 1), (302, "", "table", 1), (303, " - ", "text", 1), (304, "", None, 1), (305, "ab c", "text", 1), (306, "a bc", "text", 1), (307, "İx", "text", 1), (308, "i̇x", "text", 1)]
    assert values(copies.found(chunk_rows(spark, rows))) == brute_copies(rows)
    assert not copies.found(chunk_rows(spark, rows).limit(0)).collect()


def test_collisions_are_rebuilt(spark, monkeypatch):
    """With a hash that sees only the first letter, the exact digest still separates the groups."""
    rows = [(1, "ab", "text", 1), (2, "ac", "text", 1), (3, "AB.", "text", 1), (4, "b", "text", 1), (5, "A-c", "text", 1)]
    real = copies._hash_batches

    def weak(batches):
        import pyarrow as pa

        for b in real(batches):
            zero = pa.array(np.zeros(b.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), zero, zero, b.column(4)], names=b.schema.names)

    monkeypatch.setattr(copies, "_hash_batches", weak)
    assert values(copies.found(chunk_rows(spark, rows))) == brute_copies(rows) == [(1, 3)]


def test_hot_copy_group(spark):
    rows = [(i, "The same text." if i % 3 else "the SAME text", "text", 1) for i in range(900)] + [(i, f"other {i}", "text", 1) for i in range(900, 1000)]
    assert values(copies.found(chunk_rows(spark, rows))) == [(0, i) for i in range(1, 900)]
    assert values(copies.collapsed(chunk_rows(spark, rows))) == [(0, 900, 2)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB c.;é", max_size=12), st.text(alphabet="aB c.;é", max_size=12))
def test_pointers_and_hashes_agree(a, b):
    want = WORD.findall(a.lower()) == WORD.findall(b.lower())
    assert copies.same_words(a, b) == want
    h1, h2 = copies.fingerprints([a, b], np.array([False, False]))
    assert (h1[0] == h1[1] and h2[0] == h2[1]) == want
    t1, t2 = copies.fingerprints([a, b], np.array([True, True]))
    assert (t1[0] == t1[1] and t2[0] == t2[1]) == (copies.fields(a) == copies.fields(b))


# ---------------------------------------------------------------- look-alikes


@pytest.mark.parametrize(
    ("odd", "plain"),
    [("Ｌａ　ｆｉｃｈｅ", "La fiche"), ("état", "état"), ("a​b­c﻿", "abc"), ("un mot fin", "un mot fin"), ("соde", "code"), ("ЕН-27", "EH-27"), ("ﬁn", "fin"), ("A‐7", "A-7"), ("10 Ω", "10 Ω"), ("µm", "μm")],
)
def test_same_look_same_form(odd, plain):
    assert lookalike.normalize(odd) == lookalike.normalize(plain)


@pytest.mark.parametrize(("a", "b"), [("m2", "m²"), ("1", "①"), ("1/2", "½"), ("Objet", "OBJET"), ("modele", "modèle"), ("Maß", "Mass"), ("a.b", "a b"), ("α = 1", "a = 1"), ("ν = 1", "v = 1")])
def test_visible_differences_stay(a, b):
    assert lookalike.normalize(a) != lookalike.normalize(b)


def test_other_scripts_stay():
    for t in ("Общие положения", "Αριθμός παρτίδας", "品質記録", "690 kΩ", "γ-globuline", "Приложение Б"):
        assert lookalike.normalize(t) == t
    assert lookalike.normalize("Приложение A") == lookalike.normalize("Приложение А")
    for t in ("Օրենք", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎽᏚ", "ρυθμός ρ", "нова"):
        assert lookalike.normalize(t) == t
    assert lookalike.normalize(None) is None and lookalike.normalize("​ ") == ""


@settings(max_examples=200, deadline=None)
@given(st.from_regex(lookalike.OWN_FORM.rstrip("$") + r"\Z", fullmatch=False))
def test_own_forms_are_their_forms(text):
    assert lookalike.normalize(text) == text


def test_script_flags_and_classes(spark):
    texts = ["соde", "СОРЕ", "plain", "États", "Общие положения", "NOTE СОРЕ", None, ""]
    paras = spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)] + [(20, "d", "code"), (21, "d", "code"), (22, "e", "code")], "para_no long, doc_id string, text string")
    cells = spark.createDataFrame([], "cell_no long, doc_id string, text string")
    got = {r.row_no: (r.form, r.mixed, r.whole_script) for r in lookalike.normalized(paras, cells).collect()}
    assert got[0] == ("code", True, False) and got[2] == ("plain", False, False) and got[4][1:] == (False, False)
    assert got[5] == ("NOTE COPE", False, True) and got[6] == (None, False, False)
    assert values(lookalike.classes(paras, cells)) == [("para_blocks", "d", "code", 3, 2, 0)]


def test_lookalike_pairs(spark):
    paras = spark.createDataFrame([(1, "d", "État", 0), (2, "d", "État", 0), (3, "d", "État", 0), (4, "e", "État", 0), (5, None, "État", 0), (6, "d", None, 0), (7, "d", "", 0), (8, "d", "​", 0)], "para_no long, doc_id string, text string, form int")
    cells = spark.createDataFrame([(1, "d", "État", "x"), (9, "d", "É‍tat", "x")], "cell_no long, doc_id string, text string, src string")
    assert values(lookalike.found(paras, cells)) == [("cell_data", 1, 9), ("para_blocks", 1, 2), ("para_blocks", 2, 3)]
    assert not lookalike.found(paras.limit(0), cells.limit(0)).collect()


# ---------------------------------------------------------------- near duplicates


def brute_near(rows):
    sets = [(n, t, set(zip(*(WORD.findall(t.lower())[k:] for k in range(3))))) for n, t, _, _ in rows if t is not None]
    out = []
    for (a, ta, x), (b, tb, y) in combinations(sorted(sets), 2):
        if ta == tb or (x | y and len(x & y) >= 0.6 * len(x | y) - 1e-9):
            out.append((a, b))
    return out


def edited(rng, ws, rate):
    out = []
    for w in ws:
        x = rng.random()
        out += [] if x < rate / 2 else [w, f"n{rng.randint(0, 999)}"] if x < rate else [w]
    return out


def near_rows(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 4)):
            rows.append((len(rows), " ".join(edited(rng, base, rng.choice([0, 0.02, 0.06, 0.1]))), "text", 1))
    return rows + [(n + 10, None, "text", 1), (n + 11, "", "text", 1), (n + 12, "", "text", 1), (n + 13, "two words", "text", 1), (n + 14, "Two words", "text", 1), (n + 15, "two words", "text", 1)]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows(1, 500)
    want, got = set(brute_near(rows)), values(neardup.found(chunk_rows(spark, rows)))
    assert len(got) == len(set(got)) and not set(got) - want and len(want - set(got)) <= 0.01 * len(want)
    groups = {r.row_no: r for r in neardup.groups(chunk_rows(spark, rows)).collect()}
    assert len(groups) == sum(t is not None for _, t, _, _ in rows)
    assert not neardup.found(chunk_rows(spark, rows).limit(0)).collect()


def test_hot_buckets_are_cut_and_complete(spark):
    """Blocks of 8 rows give the same links as whole buckets."""
    rows = near_rows(2, 200)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows += [(1000 + i, " ".join(edited(rng, base, 0.03)), "text", 1) for i in range(60)]
    df = chunk_rows(spark, rows)
    whole, cut = (values(neardup.class_links(df, bucket_rows=n)[1].select("a", "b")) for n in (2048, 8))
    assert whole == cut and len(whole) > 500


def test_every_row_is_counted_for_the_order(spark, monkeypatch):
    seen = []
    real = neardup._sketch_batches
    monkeypatch.setattr(neardup, "COUNTED_ROWS", 50, raising=False)
    monkeypatch.setattr(neardup, "_sketch_batches", lambda counts, similarity: seen.append(int(counts.value.sum())) or real(counts, similarity))
    rows = near_rows(7, 300)
    neardup.class_links(chunk_rows(spark, rows))
    assert seen == [sum(len(set(zip(*(WORD.findall(t.lower())[k:] for k in range(3))))) for _, t, _, _ in rows if t is not None)]


def phrase_rows(n):
    """Every row has 16 of 40 phrases in any order: their runs are met by two rows of five, few rows are similar."""
    rng = random.Random(11)
    phrases = [" ".join(f"p{i}w{k}" for k in range(12)) for i in range(40)]
    return [(i, " ".join(rng.sample(phrases, 16)), "text", 1) for i in range(n)]


def test_crowded_runs_take_little_disk(spark):
    """Runs of 2,400 rows: the shuffle files stay below 60 MB, as such buckets aren't divided."""
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    rows, most, done = chunk_rows(spark, phrase_rows(6000)), [0], threading.Event()

    def used():
        return sum(int(x.split()[0]) for x in subprocess.run(["du", "-sk", *dirs], capture_output=True, text=True).stdout.splitlines()) / 1000

    def watch():
        while not done.wait(0.2):
            most[0] = max(most[0], used())

    neardup.Scratch(spark, "none").free()
    before, watcher = used(), threading.Thread(target=watch)
    watcher.start()
    try:
        neardup.class_links(rows)
    finally:
        done.set()
        watcher.join()
    assert most[0] - before < 60


def test_rounds_and_divided_buckets_lose_no_pair(spark, monkeypatch):
    rows = near_rows(4, 150) + [(1000 + n, t, k, c) for n, t, k, c in phrase_rows(60)]
    df = chunk_rows(spark, rows)
    whole = values(neardup.class_links(df)[1].select("a", "b"))
    monkeypatch.setattr(neardup, "LEAST_POSTINGS", 2000)
    monkeypatch.setattr(neardup, "ROUND_POSTINGS", 1)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    assert whole and values(neardup.class_links(df)[1].select("a", "b")) == whole


def test_wide_sketches_dismiss_no_similar_pair():
    rng = np.random.default_rng(8)
    sets = []
    for n in (137, 200, 357, 360, 700, 720, 1500, 3000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        sets += [base, base[: -(-6 * n // 10)], np.concatenate([base[n // 4 :], rng.integers(0, 2**63, n // 7, dtype=np.uint64)]), rng.integers(0, 2**63, n, dtype=np.uint64)]
    size = np.array([len(x) for x in sets])
    wide = neardup.wide_sketches(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size)
    i, j = (np.array(x) for x in zip(*combinations(range(len(sets)), 2)))
    near = neardup.Wide(np.array(wide, dtype=object)).near(i, j, neardup.most_apart(size[i], size[j], 0.6))
    similar = np.array([len(set(sets[a]) & set(sets[b])) >= 0.6 * len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j)])
    assert similar.sum() > 8 and near[similar].all() and not near[~similar].all()


def test_bit_slices_count_exactly():
    rng = np.random.default_rng(0)
    sketch = rng.integers(0, 2**63, (200, neardup.BITS // 64), dtype=np.uint64)
    sketch[50:90] = sketch[:40] ^ (np.uint64(1) << rng.integers(0, 63, (40, 1), dtype=np.uint64))
    far = np.bitwise_count(sketch[:, None, :] ^ sketch[None, :, :]).sum(axis=2)
    for radius in (0, 5, 60, 90):
        ask, word = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(4)))
        wanted = np.where(word == 3, np.uint64(255), ~np.uint64(0))
        q, r = neardup.within(sketch, ask, word, wanted, np.full(len(ask), radius))
        assert set(zip(q.tolist(), r.tolist())) == set(zip(*np.nonzero(far <= radius)))


def test_buckets_of_all_sizes_meet_only_themselves():
    rng = np.random.default_rng(3)
    each = np.array([2, 1, 3, 70, 2, 130, 5])
    bucket = np.repeat(np.arange(len(each)), each)
    size = rng.integers(60, 120, len(bucket))
    order = np.lexsort((size, bucket))
    size = size[order]
    most = size + rng.integers(-3, 40, len(size))
    sketch = rng.integers(0, 2**63, (len(size), neardup.BITS // 64), dtype=np.uint64) & rng.integers(0, 2**63, (len(size), 3), dtype=np.uint64) & rng.integers(0, 2**63, (len(size), 3), dtype=np.uint64)
    a, b = neardup.bucket_pairs(bucket, np.arange(len(size)), size, most, sketch, np.zeros(len(size), int))
    want = {
        (i, j) for i, j in combinations(range(len(size)), 2)
        if bucket[i] == bucket[j] and size[i] <= most[j] and size[j] <= most[i] and np.bitwise_count(sketch[i] ^ sketch[j]).sum() <= neardup.most_apart(size[i], size[j], 0.6)
    }
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) > 20


def test_shared_runs_are_counted_exactly():
    left = ["a b c d e", "", "x y", "a a a a", "A b c, d"]
    right = ["b c d e f", "a b c", "x y", "a a a", "a b c d"]
    both, either = neardup.shared_runs(left, right)
    assert both.tolist() == [2, 0, 0, 1, 2] and either.tolist() == [4, 1, 0, 1, 2]


def test_no_pair_at_the_threshold_is_lost(spark):
    """2,000 pairs of similarity exactly 0.6 (30 runs of 50), long, short and many-sized ones beside them."""
    rows = []
    for i in range(2000):
        ws = [f"p{i}w{k}" for k in range(42)]
        rows += [(2 * i, " ".join(ws), "text", 1), (2 * i + 1, " ".join(ws[:17] + [f"q{i}w{k}" for k in range(8)] + ws[25:]), "text", 1)]
    assert values(neardup.found(chunk_rows(spark, rows))) == [(2 * i, 2 * i + 1) for i in range(2000)]
    rng = random.Random(9)
    base = [f"w{k}" for k in range(1500)]
    texts = [" ".join(edited(rng, base[:n], rng.choice([0, 0.05, 0.1, 0.2]))) for n in (3, 4, 5, 8, 30, 100, 400, 1500) for _ in range(40)]
    mixed = [(i, t, "text", 1) for i, t in enumerate(texts)]
    want = set(brute_near(mixed))
    assert set(values(neardup.found(chunk_rows(spark, mixed)))) == want and len(want) > 500


# ---------------------------------------------------------------- packing


TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def test_token_counts_equal_the_whole_encoding():
    counts = packing.TokenCounts(TOKENIZER)
    for t in ("", "a", " a  b", "L'été\n\n  1.5 kg…", "x" * 300, "a \n b\t c ", "don't 'stop"):
        assert counts.of(t) == len(counts.encode(t))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab' 1.\n\té…", max_size=60))
def test_token_counts_property(text):
    counts = packing.TokenCounts(TOKENIZER)
    assert counts.of(text) == len(counts.encode(text))


def test_plan_is_complete_and_tight():
    rng = np.random.default_rng(4)
    for capacity in (100, 513):
        items = np.clip(rng.lognormal(4, 0.8, 3000).astype(int), 1, capacity)
        size, number = np.unique(items, return_counts=True)
        plan, programmed = packing.plan(size, number, capacity)
        held = np.zeros(len(size), np.int64)
        for at, count, copies in plan:
            assert (count > 0).all() and (count * size[at]).sum() <= capacity
            held[at] += count * copies
        assert (held == number).all()
        used = sum(n for _, _, n in plan)
        assert sum(n for _, _, n in plan[:programmed]) >= 0.9 * used
        least = max(-(-items.sum() // capacity), (items > capacity / 2).sum())
        assert used <= 1.005 * least + 1
    assert packing.plan(np.empty(0, np.int64), np.empty(0, np.int64), 10) == ([], 0)


def test_the_knapsack_is_exact():
    """Against all choices: the fullest patterns come first, the highest price decides among them."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, capacity = int(rng.integers(1, 5)), int(rng.integers(1, 40))
        size, most, price = rng.choice(np.arange(1, 30), n, replace=False), rng.integers(0, 4, n), rng.random(n)
        got = packing.best_pattern(price, size, most, capacity)
        options = [c for c in product(*(range(m + 1) for m in most)) if np.dot(c, size) <= capacity]
        best = max((int(np.dot(c, size)), float(np.dot(c, price))) for c in options)
        assert (got <= most).all() and int(got @ size) == best[0] and abs(float(got @ price) - best[1]) < 1e-9


def test_packing_edge_cases(spark):
    rng = random.Random(1)
    docs = [(i, "word " * rng.randint(1, 300)) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 5000), (5, "word word"), (5, "word word"), (None, "word")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, size int")
    caps = spark.createDataFrame([(1, 256, 1), (2, 1000, None), (3, None, 1), (4, 0, 1)], "capacity_id int, capacity_tokens int, separator_tokens int")
    rows = packing.packed(df, caps, TOKENIZER).collect()
    counts = packing.TokenCounts(TOKENIZER)
    for capacity_id, capacity, sep in ((1, 256, 1), (2, 1000, 0)):
        held = defaultdict(list)
        per_doc = Counter()
        for r in rows:
            if r.capacity_id == capacity_id:
                held[r.container_no].append(r.n_tokens)
                per_doc[r.doc_id] += r.n_tokens
                assert r.pieces == 1 or per_doc is not None and counts.of(dict(docs)[r.doc_id]) > capacity
        assert all(sum(v) + sep * (len(v) - 1) <= capacity for v in held.values())
        want = Counter()
        for i, t in docs:
            if t:
                want[i] += counts.of(t)
        assert per_doc == want
        assert sorted(held) == list(range(len(held)))
    assert {r.capacity_id for r in rows} == {1, 2}
    assert not packing.packed(df.limit(0), caps, TOKENIZER).collect() and not packing.packed(df, caps.limit(0), TOKENIZER).collect()


# ---------------------------------------------------------------- leaks


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 11, 12, 13, 40, 90])))) for i in range(60)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for d in range(300):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            w = rng.choice([t for _, t in items if t]).split()
            n = rng.choice([5, 11, 12, 13, 30])
            at = rng.randint(0, max(0, len(w) - n))
            ws[len(ws) // 2 : len(ws) // 2] = w[at : at + n]
        docs.append((d, " ".join(ws).upper() if d % 2 else ", ".join(ws)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    want = set()
    for i, t in items:
        w = WORD.findall((t or "").lower())
        m = min(12, len(w))
        grams = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set()
        for d, x in docs:
            y = WORD.findall((x or "").lower())
            if any(tuple(y[k : k + m]) in grams for k in range(len(y) - m + 1)):
                want.add((d, i))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    ev = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    assert values(leaks.found(df, ev)) == sorted(want)
    assert values(leaks.leaks(df, ev, max_words=300).select("doc_id", "item_id")) == sorted(want)  # several groups
    assert not leaks.found(df.limit(0), ev).collect() and not leaks.found(df, ev.limit(0)).collect()


def test_many_items_stay_small():
    """100,000 items of 40 words: postings and block maxima grow with the words."""
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(20_000)])
    drawn = rng.integers(0, len(words), (100_000, 40))
    index = leaks.ItemIndex([(i, " ".join(words[d])) for i, d in enumerate(drawn)])
    held = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray))
    assert held < 400_000_000
    text = np.concatenate([drawn[7][5:20], drawn[9][:11], drawn[99_999][-12:]])
    codes = np.array([index.vocabulary[w] for w in words[text]])
    p, k = index.retrieve(index.terms(codes), np.array([0, 15, 26]))
    assert {index.ids[x] for x in k} == {7, 99_999}


def test_leak_in_a_very_long_text_and_shares(spark):
    item = "Question: which document governs the pump? Answer: The " + " ".join(f"step{i}" for i in range(30)) + "."
    text = "filler word here. " * 60_000 + item + " more filler" * 50_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = leaks.leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.longest_run, r.question_share, r.answer_share) for r in got] == [(1, 7, 38, 1.0, 1.0)]


# ---------------------------------------------------------------- languages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{SF}/lang_samples.parquet")


def test_held_out_accuracy(samples):
    rows = [(r.lang, r.text) for r in samples.orderBy("sample_id").collect()]
    scorer = language.Scorer(language.fit(rows[::2]))
    best, share, _ = scorer.decide([WORD.findall(t.lower()) for _, t in rows[1::2]])
    assert np.mean([scorer.model.languages[k] == lang if k >= 0 else False for k, (lang, _) in zip(best, rows[1::2])]) >= 0.98


def test_bounded_fit_keeps_every_language(spark, samples):
    """Of many labelled rows each language keeps its share; a language with few keeps them all."""
    rows = [(r.lang, f"{r.text} {k}") for r in samples.collect() for k in range(10 if r.lang != "pt" else 1)]
    model = language.fit_samples(spark.createDataFrame(rows, "lang string, text string"), max_samples=210)
    assert set(model.languages) == {lang for lang, _ in rows}


def test_probabilities_sum_to_one(samples):
    model = language.KneserNey([(r.lang, r.text) for r in samples.limit(60).collect()], order=3)
    bag = Counter({"pompe": 3, "plan": 2, "ligne": 1})
    fitted = model._fit(bag, 12)
    letters = sorted({c for w in bag for c in w}) + [language._END, language._OTHER]
    for history in ("", language._BEGIN, "p", "xx", "pl"):
        total = sum(model._probability(fitted, (history + c)[-3:], len(letters)) for c in letters)
        assert abs(total - 1) < 1e-9 or history == ""


def test_sentences_and_labels(spark):
    text = "# A heading\n1. La ligne de peinture ........ 12\nPage 3 / 9\n- Le plan de contrôle décrit la ligne. Une autre phrase suit ici ! Non.\n\n*Figure 2 : x*"
    assert [text[a:b] for a, b, _ in language.sentences(text)] == ["Le plan de contrôle décrit la ligne.", "Une autre phrase suit ici !"]
    df = spark.createDataFrame([("fr",), ("FR-be",), (" fra ",), ("en_GB",), ("xx",), ("",), (None,), ("?",), ("français",)], "l string")
    assert [r[0] for r in df.select(language.label_language(df.l)).collect()] == ["fr", "fr", "fr", "en", None, None, None, None, "fr"]


def test_language_cases(spark, samples):
    fr, en = "Le plan de contrôle de la ligne de peinture décrit la liste des réserves.", "The inspection plan of the paint line describes the defect register for selected vendors."
    docs = [(1, fr, "fr"), (2, fr, "en"), (3, fr, None), (4, f"{fr} {en}", "fr"), (5, None, None), (6, "", ""), (7, "12 ; 13\nAB-12", None), (8, fr.upper(), "FRA"), (9, f"{fr}\n# The inspection plan", "fr"), (10, fr * 20_000, "de"), (3, fr, None)]
    df = spark.createDataFrame([(d, t, l, 0) for d, t, l in docs], "doc_id long, text string, lang string, sentences int")
    assert values(language.found(df, samples)) == [(2, "fr"), (3, "fr"), (4, "en"), (4, "fr"), (10, "fr")]
    parts = [(r.doc_id, r.segment_no, r.lang) for r in language.segments(df, samples).collect() if r.doc_id == 4]
    assert parts == [(4, 0, "fr"), (4, 1, "en")]
    assert not language.found(df.limit(0), samples).collect()
    with pytest.raises(ValueError):
        language.fit_samples(samples.limit(0))
