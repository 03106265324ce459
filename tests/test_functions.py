"""Plain functions: splitting, tables, structured documents."""

from hypothesis import given, settings
from hypothesis import strategies as st

from sheafline.functions import splitting as S
from sheafline.functions.structured import Document, as_table, document_id, grid
from sheafline.functions.tables import Table
from sheafline.operators.structured import common_section, joined, pack

WORDS = S.count_words


def test_recursive_split_bound_and_lossless():
    text = " ".join(f"This is sentence number {i} of the text." for i in range(300))
    got = S.recursive(text, 50, WORDS)
    assert all(WORDS(p) <= 50 and p.endswith(".") for p in got) and " ".join(got).split() == text.split()


def test_words_are_never_glued():
    text = " ".join(f"clause {i} says something, then; more" for i in range(60))
    for limit in (190, 40, 7):
        assert " ".join(S.recursive(text, limit, WORDS)).split() == text.split()
    assert [len(p) for p in S.recursive("x" * 50, 20, len)] == [20, 20, 10]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(1, 12))
def test_recursive_split_properties(text, limit):
    got = S.recursive(text, limit, WORDS)
    assert "".join("".join(got).split()) == "".join(text.split()) and all(p == p.strip() and p for p in got)
    assert all(WORDS(p) <= limit or len(p.split()) == 1 for p in got)


def test_overlap_is_bounded():
    a, b = " ".join(f"a{i}" for i in range(10)), "b0 b1 b2"
    got = S.with_overlap([a, b], 4, WORDS, 10)
    assert got[0] == a and got[1].endswith(b) and WORDS(got[1]) <= 10 and got[1].startswith("a6")
    assert S.with_overlap([a, b], 0, WORDS) == [a, b] and S.with_overlap([], 3, WORDS) == []


def test_prefix_and_budget():
    assert S.context_prefix("doc", "Intro", 0, False) == "DOC — Intro — page 1"
    assert S.context_prefix("doc", "", None, True) == "DOC"
    long = S.context_prefix("doc", "x" * 100, 1, True)
    assert long == "DOC — …" + "x" * 79 + " — page ~2"
    assert S.child_limit(64, 20, True, "doc", "a section", WORDS) == 16 and S.child_limit(64, 20, False, "d", "", WORDS) == 64


TABLE = Table.of({"header": ["Name", ""], "rows": [["a|b", "1\n2"], ["Lot 2", ""], ["c", "—"], [None, " "]], "types": ["donnee", "intercalaire", "donnee", "donnee"]})


def test_table_rows_and_markdown():
    assert TABLE.row_texts() == [(0, "Name : a|b ; col1 : 1\n2"), (2, "[Lot 2] Name : c")]
    assert TABLE.markdown().split("\n")[:3] == ["| Name | col1 |", "|---|---|", "| a\\|b | 1<br>2 |"]
    assert Table.of({"header": ["one"], "rows": [["x"]]}).row_texts() == [] and Table.of(None).windows("", 10, WORDS) == []


def test_windows_carry_the_open_group():
    t = Table.of({"header": ["A", "B"], "rows": [["Lot", ""], *([f"r{i}", str(i)] for i in range(30))], "types": ["intercalaire", *["donnee"] * 30]})
    got = t.windows("Caption", 70, WORDS)
    assert len(got) > 1 and got[0][0] == 0 and got[-1][1] == 31 and all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert all("| Lot |" in x[2] and "| A | B |" in x[2] and x[2].startswith("Caption (lignes ") for x in got)


def test_pack_keeps_headings_with_what_follows():
    p = lambda label, n: {"label": label, "n": n, "text": label}
    got = pack([p("text", 40), p("section_header", 5), p("text", 40)], 50)
    assert [[x["n"] for x in g] for g in got] == [[40], [5, 40]]
    assert pack([], 5) == [] and [[x["n"] for x in g] for g in pack([p("text", 90), p("text", 1)], 50)] == [[90], [1]]


def test_common_section_and_join():
    assert common_section(["1 > 1.1", "1 > 1.2 > x"]) == "1" and common_section(["", "1"]) == "" and common_section(["a", "a"]) == "a"
    item = lambda t: {"label": "list_item", "text": t}
    assert joined([item("a"), item("b"), {"label": "text", "text": "c"}]) == "a\nb\n\nc"


def cell(r, c, text, rows=1, cols=1, **kw):
    return {"start_row_offset_idx": r, "end_row_offset_idx": r + rows, "start_col_offset_idx": c, "end_col_offset_idx": c + cols, "row_span": rows, "col_span": cols, "text": text, **kw}


def test_structured_table():
    data = {"num_rows": 5, "num_cols": 2, "table_cells": [cell(0, 0, "V", cols=2, column_header=True), cell(1, 0, "Min", column_header=True), cell(1, 1, "Max", column_header=True), cell(2, 0, "Lot", cols=2), cell(3, 0, "x", rows=2), cell(3, 1, "1"), cell(4, 1, "2")]}
    t = as_table({"data": data})
    assert t.header == ["V / Min", "V / Max"] and t.rows == [["Lot", ""], ["x", "1"], ["x", "2"]] and t.types == ["intercalaire", "donnee", "donnee"]
    assert len(grid(data)) == 5 and as_table({"data": None}).rows == []


def figure(**kw):
    item = {"self_ref": "#/pictures/0", "label": "picture", "captions": [], **kw}
    return Document({"pictures": [item]}).figure_text(item)


def test_figure_texts():
    new, old = figure(meta={"description": {"text": "A pump."}}), figure(annotations=[{"kind": "description", "text": "A pump."}])
    assert new == old == "Description : A pump."
    assert figure(meta={"docx__props": {"alt_text": "Image 3", "title": "Pump", "chart_text": "1 | 2"}}) == "Pump\nDonnées : 1 | 2"
    assert figure(meta={"docx__props": {"decorative": True, "alt_text": "x"}}) == ""


def test_document_walk():
    texts = [{"self_ref": "#/texts/0", "label": "text", "text": "a", "children": []}, {"self_ref": "#/texts/1", "label": "page_header", "text": "h", "children": []}, {"self_ref": "#/texts/2", "label": "list_item", "marker": "1.", "text": "b", "children": [], "prov": [{"page_no": 3}]}]
    loop = {"self_ref": "#/groups/0", "label": "list", "children": [{"$ref": "#/texts/2"}, {"$ref": "#/groups/0"}, {"$ref": "#/texts/99"}]}
    inline = {"self_ref": "#/groups/1", "label": "inline", "children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/2"}]}
    d = Document({"body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/1"}, {"$ref": "#/groups/0"}, {"$ref": "#/groups/1"}, {"self_ref": "#/texts/7", "label": "text", "text": "nested here"}]}, "texts": texts, "groups": [loop, inline]})
    assert [(b["kind"], b["text"], b["page"]) for b in d.blocks()] == [("text", "a", None), ("text", "1. b", 2), ("text", "a 1. b", 2), ("text", "nested here", 2)]
    assert document_id({"origin": {"filename": "a.b.docx"}}) == "a.b" and document_id({"name": "n"}) == "n" and document_id({}, "stem") == "stem"
