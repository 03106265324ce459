"""Visually identical text with different characters (problem 4).

Method.  Invisible characters go, blanks become one plain blank, and compatibility
forms that look like their plain letters (full-width, ligatures, font variants, not
superscripts, circles or fractions) are decomposed.  Each letter then has a shape
and the scripts in which that shape exists.  Intersecting these sets over a token's
letters gives the scripts it could be written in: one script left means a plain or a
mixed token whose spelling is known; several mean a whole-script confusable, which
takes the script of the text's other tokens; none means letters of several scripts
that can't be one (``kΩ``), where every letter with a choice follows the text.
Letters are respelled in the chosen script and marks composed.  The result depends
only on shapes, so two texts read the same exactly if their forms are equal.  Beside
the form come two flags: ``mixed`` where a token's letters are of several scripts that
one script explains, ``whole_script`` where a token stood wholly in another script than
the one chosen for it.

Texts of Latin letters, digits and signs that nothing replaces are their own form: the
scan's stage recognises them, so that only the others reach Python.

Defined results: null stays null; a text without visible characters becomes empty;
letter case, accents, superscript and circled digits, fractions and signs stay
different; texts in another script stay as they are; a token of one small Greek letter
is a symbol and stays; a null doc_id is compared with nothing.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, small

# Letters that have the shape of a Latin one, by script.
LOOKALIKES = {
    "CYRILLIC": "AА BВ CС EЕ HН IІ IӀ JЈ KК MМ OО PР SЅ TТ VѴ XХ YУ GԌ aа cс eе iі jј lӏ oо pр sѕ vѵ xх yу hһ dԁ qԛ wԝ",
    "GREEK": "AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ oο vν uυ pρ iι",
    "ARMENIAN": "OՕ SՏ UՍ LԼ oօ nո uս hհ gց jյ qզ",
    "CHEROKEE": "DᎠ RᎡ RᏒ TᎢ AᎪ JᎫ EᎬ WᎳ WᏔ MᎷ HᎻ YᎩ YᎽ GᏀ ZᏃ SᏕ SᏚ VᏙ LᏞ CᏟ PᏢ KᏦ BᏴ iᎥ bᏏ",
    "LATIN": "aɑ gɡ iı iɩ jȷ",
}
#: Small Greek letters that stand alone are symbols.
SYMBOLS = "νυρι"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE")
# Signs that look like a plain one, and what they become.
SIGNS = {"‐": "-", "‑": "-", "⁃": "-", "ʼ": "'", "∶": ":"}

#: Lists of hashes up to this long are broadcast, longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000

_VISIBLE_FORMS = {"<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>"}


def _shapes() -> dict[str, dict[str, str]]:
    """Each letter that has a shape in several spellings: the scripts of that shape and their letters."""
    by_shape: dict[str, dict[str, str]] = {}
    pairs = [(shape, script, letter) for script, listed in LOOKALIKES.items() for shape, letter in listed.split()]
    for shape, script, letter in pairs:
        by_shape.setdefault(shape, {"LATIN": shape}).setdefault(script, letter)
    return {letter: by_shape[shape] for shape, _, letter in pairs} | {shape: spelled for shape, spelled in by_shape.items()}


SHAPES = _shapes()
_script_cache: dict[str, str | None] = {}


def script(c: str) -> str | None:
    """Latin, Cyrillic, Greek, another script's name, or None for what belongs to none."""
    if c not in _script_cache:
        if not c.isalpha():
            _script_cache[c] = None
        else:
            _script_cache[c] = unicodedata.name(c, "UNKNOWN").split(" ")[0]
    return _script_cache[c]


_plain_cache: dict[str, str] = {}


def _plain(c: str) -> str:
    """Invisible to nothing, blanks to a blank, look-alike compatibility forms to their letters."""
    got = _plain_cache.get(c)
    if got is not None:
        return got
    kind = unicodedata.category(c)
    if c.isspace() or kind in ("Zs", "Zl", "Zp"):
        got = " "
    elif kind in ("Cf", "Cc") or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️":
        got = ""
    elif c in SIGNS:
        got = SIGNS[c]
    else:
        form = unicodedata.decomposition(c)
        mark = form.split(" ", 1)[0] if form.startswith("<") else ""
        if mark and mark not in _VISIBLE_FORMS:
            wide = "".join(chr(int(x, 16)) for x in form.split(" ")[1:])
            # a spacing accent is a sign of its own, and so is the long s
            got = c if wide[:1] == " " or c in "ſ…" else "".join(_plain(x) for x in wide)
        else:
            got = c
    _plain_cache[c] = got
    return got


def normalize(text: str | None) -> str | None:
    """The one form of all texts that read like this one."""
    return _respelled(text, [False, False])


def _respelled(text: str | None, flags: list[bool]) -> str | None:
    if text is None or text.isascii() and "  " not in text and text.isprintable() and text == text.strip():
        return text
    plain = "".join(map(_plain, text))
    plain = unicodedata.normalize("NFD", " ".join(plain.split()))
    if plain.isascii():
        return plain
    # possible scripts of each token
    tokens: list[tuple[int, int]] = []
    start = -1
    for i, c in enumerate(plain):
        inside = c.isalpha() or (start >= 0 and unicodedata.combining(c))
        if inside and start < 0:
            start = i
        elif not inside and start >= 0:
            tokens.append((start, i))
            start = -1
    if start >= 0:
        tokens.append((start, len(plain)))
    choices: list[set[str]] = []
    weight: Counter = Counter()
    for lo, hi in tokens:
        letters = [c for c in plain[lo:hi] if c.isalpha()]
        sets = [set(SHAPES[c]) if c in SHAPES else {script(c)} for c in letters]
        common = set.intersection(*sets) if sets else set()
        if len(letters) == 1 and letters[0] in SYMBOLS:
            common = {"GREEK"}
        choices.append(common)
        if len(common) == 1:
            weight[next(iter(common))] += hi - lo
    order = sorted(SCRIPTS, key=lambda s: (-weight[s], SCRIPTS.index(s)))
    out = list(plain)
    for (lo, hi), common in zip(tokens, choices):
        pick = next(iter(common)) if len(common) == 1 else next((s for s in order if s in common), None)
        were = {script(c) for c in plain[lo:hi] if c.isalpha()}
        flags[0] |= pick is not None and len(were) > 1
        flags[1] |= pick is not None and len(were) == 1 and pick not in were
        for i in range(lo, hi):
            c = plain[i]
            if c in SHAPES:
                spelled = SHAPES[c]
                want = pick or next(s for s in order if s in spelled)
                # within its own script a letter stays, but for the variants of Latin ones
                out[i] = c if want == script(c) and want != "LATIN" else spelled[want]
    return unicodedata.normalize("NFC", "".join(out).replace("i\u0307", "i"))


#: Characters that are their own form among each other: printable ASCII, Latin-1 letters and some typographic signs.
_OWN = "!-~À-ÖØ-öø-ÿŒœ«»‘’“”–—•…°€"
OWN_FORM = f"^[{_OWN}]+( [{_OWN}]+)*$"


def _normalize_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forms: dict[str, tuple[str | None, bool, bool]] = {}
    for b in batches:
        out = []
        for t in b.column(b.num_columns - 1).to_pylist():
            if t not in forms:
                if len(forms) > 50_000:
                    forms.clear()
                flags = [False, False]
                forms[t] = (_respelled(t, flags), *flags)
            out.append(forms[t])
        columns = list(zip(*out)) or [(), (), ()]
        kinds = [pa.string(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*b.schema.names, "form", "mixed", "whole_script"])


def normalized(paras: DataFrame, cells: DataFrame) -> DataFrame:
    """src, doc_id, row_no, text, form, mixed, whole_script of both tables."""
    no = F.lit(False)
    both = paras.select(F.lit("para_blocks").alias("src"), "doc_id", F.col("para_no").cast("long").alias("row_no"), "text").unionByName(
        cells.select(F.lit("cell_data").alias("src"), "doc_id", F.col("cell_no").cast("long").alias("row_no"), "text")
    )
    own = F.coalesce(F.col("text").rlike(OWN_FORM), F.lit(False))
    odd = both.where(~own).mapInArrow(_normalize_batches, "src string, doc_id string, row_no long, text string, form string, mixed boolean, whole_script boolean")
    return both.where(own).select("*", F.col("text").alias("form"), no.alias("mixed"), no.alias("whole_script")).unionByName(odd)


KEY = ["src", "doc_id", "form"]


def _several(paras: DataFrame, cells: DataFrame) -> DataFrame:
    """src, doc_id, form, text, row_no of the rows whose form has another spelling than itself in their document.

    Of the rows, only those with an odd spelling name such forms; their hashes find the
    others, and the forms themselves, not the hashes, decide what belongs together.
    """
    scratch = Scratch(paras.sparkSession, "lookalike")
    rows = normalized(paras, cells).where(F.col("doc_id").isNotNull() & (F.col("form") != ""))
    rows = rows.select(*KEY, "row_no", F.when(F.col("text") != F.col("form"), F.col("text")).alias("odd"), F.xxhash64(*KEY).alias("h"))
    rows = scratch.keep(rows, "forms")  # normalised once, read by both sides
    hashes = scratch.keep(rows.where(F.col("odd").isNotNull()).select("h").distinct(), "hashes")
    kept = rows.join(small(hashes, BROADCAST_ROWS), "h", "left_semi")
    return scratch.keep(kept.select(*KEY, "row_no", F.coalesce("odd", "form").alias("text")), "kept")


def classes(paras: DataFrame, cells: DataFrame) -> DataFrame:
    """src, doc_id, form, members, spellings, first_row: one row for each form found in several spellings."""
    per = _several(paras, cells).groupBy(*KEY, "text").agg(F.count("*").alias("n"), F.min("row_no").alias("first"))
    return per.groupBy(*KEY).agg(F.sum("n").alias("members"), F.count("*").alias("spellings"), F.min("first").alias("first_row")).where(F.col("spellings") > 1)


def found(paras: DataFrame, cells: DataFrame) -> DataFrame:
    """src, row_a, row_b: rows of one document that read the same in different characters.

    The spellings of a form are joined with each other first, their rows last, so the
    join never holds more than its result.
    """
    kept = _several(paras, cells)
    spellings = kept.select(*KEY, "text").distinct()
    pairs = spellings.join(spellings.withColumnRenamed("text", "text_b"), KEY).where(F.col("text") < F.col("text_b"))
    a = pairs.join(kept.withColumnRenamed("row_no", "no_a"), [*KEY, "text"])
    b = a.join(kept.select(*KEY, F.col("text").alias("text_b"), F.col("row_no").alias("no_b")), [*KEY, "text_b"])
    return b.select("src", F.least("no_a", "no_b").alias("row_a"), F.greatest("no_a", "no_b").alias("row_b"))
