"""DataFrame operators: hierarchies, shredding, page and document chunks, SQL parity at the smallest scale."""

import glob
import json
import os
import random

import pytest

from sheafline import fixtures as D
from sheafline import queries
from sheafline.config import ChunkSettings
from pyspark.sql import functions as F

from sheafline.operators import hierarchy, linked, pages, shred, word

SF = "/root/testdata/sf0.001"
S = ChunkSettings(chunk_tokens=64, max_seq_length=128)


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- hierarchies

ITEM = "item_no long, doc_id string, self_ref string, parent string, received_at long, grp string, node string, top string"


def item_rows(spark, rows):
    return spark.createDataFrame([(i, d, r, p, t, "x", "y", "z") for i, (d, r, p, t) in enumerate(rows)], ITEM)


def brute_tree(rows):
    parent = {}
    for i, (d, r, p, t) in enumerate(rows):
        if d is not None and r is not None:
            best = parent.get((d, r))
            if best is None or (t is not None and (best[1] is None or t >= best[1])) or (t is None and best[1] is None):
                parent[d, r] = (p, t)
    out = {}
    for d, r in parent:
        path, seen = [r], {r}
        while True:
            p = parent[d, path[0]][0]
            if p is None or p in hierarchy.ROOT_MARKERS or (d, p) not in parent:
                out[d, r] = (0, path[0], p, len(path) - 1, path)
                break
            if p in seen:
                out[d, r] = (1, None, None, None, None)
                break
            seen.add(p)
            path.insert(0, p)
    return out


@pytest.mark.parametrize("seed", [1])
def test_hierarchy_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for d, n in (("a", 400), ("b", 40), ("c", 1)):
        for i in range(n):
            p = rng.choice([f"#/texts/{rng.randrange(n)}", f"#/texts/{max(0, i - 1)}", "#/body", "#/furniture", None, "#/missing"])
            rows.append((d, f"#/texts/{i}", p, rng.randint(0, 3)))
    rows += [("chain", f"n{i}", f"n{i - 1}" if i else "#/body", 1) for i in range(700)]
    rows += [("ring", f"r{i}", f"r{(i + 1) % 50}", 1) for i in range(50)] + [("ring", "leaf", "r7", 1)]
    rows += [(None, "x", "y", 1), ("d", None, "x", 1), ("d", "self", "self", 1), ("a", "#/texts/3", "#/body", 9), ("d", "n", None, None)]
    rng.shuffle(rows)
    want = brute_tree(rows)
    got = {(r.grp, r.node): (1 if r.state == hierarchy.CYCLE else 0, r.root, r.anchor, r.depth, r.path) for r in hierarchy.resolve(item_rows(spark, rows)).collect()}
    assert got == want
    assert values(hierarchy.endless(item_rows(spark, rows)).select("grp", "node")) == sorted(k for k, v in want.items() if v[0])


def test_descendants_and_empty(spark):
    rows = [("d", "a", "#/body", 1), ("d", "b", "a", 1), ("d", "c", "b", 1), ("d", "x", "y", 1), ("d", "y", "x", 1)]
    r = hierarchy.resolve(item_rows(spark, rows))
    assert values(hierarchy.descendants(r)) == [("d", "a", "b", 1), ("d", "a", "c", 2), ("d", "b", "c", 1)]
    assert not hierarchy.resolve(item_rows(spark, rows).limit(0)).collect()


def test_forest_offsets():
    f = hierarchy.WeightedForest(4)
    f.link(1, 0)
    f.link(3, 2)
    f.link(2, 1)
    assert f.find(3) == (0, 3) and not any(f.cyclic)
    f.link(0, 3)
    assert f.cyclic[0]


# ---------------------------------------------------------------- shredding


def record(**kw):
    return {"schema_name": "DoclingDocument", "body": {"self_ref": "#/body", "children": [], "meta": {"x": 1}}, **kw}


def test_parts_of_all_layouts(spark):
    docs = [
        record(tables=[{"self_ref": "#/tables/0", "parent": {"$ref": "#/body"}, "data": {"table_cells": [{"text": "a"}, {}, None, {"text": None}, {"text": "b"}]}, "image": None, "meta": {}}]),
        record(body={"self_ref": "#/body", "children": [{"self_ref": "#/tables/0", "cells": [{"text": "a", "tables": [{"self_ref": "#/tables/1", "cells": [{"text": "in"}], "meta": {"image": {"uri": "u"}}}]}]}]}),
        record(pictures=[{"self_ref": "#/pictures/0", "image": {"uri": "u"}, "meta": {"docx__props": {}}}, {"self_ref": "#/pictures/1", "image": {}, "meta": {"docx__props": {"image": {"uri": "u"}}}}], x_docx={"items": {"#/pictures/0": {"alt_text": "a"}, "#/pictures/9": {"alt_text": "b"}, "#/body": {"a": 1}}}),
        record(groups=[{"self_ref": "#/groups/0", "meta": None}], x_docx={"items": {"#/groups/0": {"image": {"uri": "u"}}}}),
    ]
    payloads = [json.dumps(d) for d in docs] + [None, "", "null", "[1]", "{", json.dumps(docs[0]) + "x", '{"a": NaN}']
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)] + [(0, payloads[0], "again")], "rec_id long, payload string, self_ref string")
    assert values(shred.parts(df)) == sorted(
        [(0, "#/tables/0", "cell", 0), (0, "#/tables/0", "cell", 4), (1, "#/tables/0", "cell", 0), (1, "#/tables/1", "cell", 0), (1, "#/tables/1", "image", 0), (1, "#/tables/1", "meta", 0), (2, "#/pictures/0", "image", 0), (2, "#/pictures/0", "meta", 0)]
        + [(2, "#/pictures/1", "image", 0), (2, "#/pictures/1", "meta", 0), (3, "#/groups/0", "image", 0), (3, "#/groups/0", "meta", 0)],
        key=repr,
    )
    cells, images, meta = shred.document_tables(df)
    assert cells.where("self_ref = '#/tables/1'").first().parent_ref == "#/tables/0"
    assert not shred.parts(df.limit(0)).collect()


def test_objects_in_nested_lists_and_listed_maps(spark):
    doc = record(
        groups=[[[[{"self_ref": "#/groups/0", "meta": {"a": 1}}], {"self_ref": "#/groups/1"}]]],
        tables={"#/tables/0": [{"self_ref": "#/tables/0", "cells": [{"text": "x"}]}]},
        x_docx={"items": {"#/groups/1": [{"alt_text": "b"}]}},
    )
    df = spark.createDataFrame([(0, json.dumps(doc))], "rec_id long, payload string")
    assert values(shred.parts(df)) == [(0, "#/groups/0", "meta", 0), (0, "#/groups/1", "meta", 0), (0, "#/tables/0", "cell", 0)]


def test_deep_nesting_and_round_trip():
    deep = '{"a":' * 30_000 + "1" + "}" * 30_000
    assert shred.parse_object(deep) is not None and shred._parse_deep('{"a": [1, {"b": "x\\n"}, [], {}], "c": -1.5e3, "d": null}') == {"a": [1, {"b": "x\n"}, [], {}], "c": -1500.0, "d": None}
    for bad in ("{", "[1,]", '{"a" 1}', "{}}", '{"a":}', "[}", '{"a":1,}', "1 2"):
        with pytest.raises(ValueError):
            shred._parse_deep(bad)
    item = {"self_ref": "#/tables/0", "cells": [{"text": "x"}]}
    for i in range(1, 3000):
        item = {"self_ref": f"#/tables/{i}", "cells": [{"text": str(i), "tables": [item]}]}
    whole = shred.Parsed(None)
    whole.top = record(tables=[item])
    todo = [whole.top]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            whole.entries[id(x)] = len(x)
        todo.extend(y for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (dict, list)))
    rows = list(shred.shred_object(whole, shred.SchemaGraph((("item", "cells", True), ("cells", "item", True)))))
    assert sum(r[0] == "item" for r in rows) == 3001 and sum(r[0] == "cells" for r in rows) == 3000


def test_schema_graph_inlines_singletons():
    g = shred.SchemaGraph((("record", "item", True), ("item", "meta", False), ("meta", "size", False), ("item", "image", False), ("meta", "image", False)))
    assert g.tables == {"record", "item", "image"}
    assert g.parts("item") == {"": "item", "meta.": "meta", "meta.size.": "size"}


def test_relations_are_typed_and_related(spark):
    doc = record(tables=[{"self_ref": "#/tables/0", "label": "t", "data": {"num_rows": 2, "share": 0.5, "ok": True, "odd": "x"}, "cells": [{"text": "a", "n": 1}, {"text": "b", "n": 2.5}]}, {"self_ref": "#/tables/1", "data": {"odd": 3}}])
    df = spark.createDataFrame([(7, json.dumps(doc))], "rec_id long, payload string")
    graph = shred.analyse(df)
    rows = shred.shred(df, graph)
    assert "data" not in graph.tables and "cells" in graph.tables
    items = shred.relation_table(rows, graph, "item")
    assert dict(items.dtypes)["data_num_rows"] == "bigint" and dict(items.dtypes)["data_share"] == "double" and dict(items.dtypes)["data_ok"] == "boolean" and dict(items.dtypes)["data_odd"] == "string"
    cells = shred.relation_table(rows, graph, "cells")
    got = cells.join(items.select(items.row_no.alias("up"), "label", "data_num_rows"), cells.up_row == F.col("up")).select("text", "n", "label", "data_num_rows")
    assert values(got) == [("a", 1.0, "t", 2), ("b", 2.5, "t", 2)]
    data = shred.elements(rows, graph, "data", ["odd"])
    assert values(data.select("self_ref", "place", "odd")) == [("#/tables/0", "held", "x"), ("#/tables/1", "held", "3")]


# ---------------------------------------------------------------- chunks


def page(**kw):
    return {"page_no": 1, "doc_id": "guide", "page": 0, "text": "", "etat": None, "source": None, "est_figure": None, "headings": None, "tables": None} | kw


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "page_no long, " + pages.PAGE_SCHEMA)


def test_page_record_with_heading_and_table(spark):
    table = {"header": ["Name", "Value"], "rows": [["a", "1"], ["b", "2"]], "types": None, "bbox": [0.0, 50.0, 1.0, 1.0]}
    heads = [{"text": "Intro", "bbox": [0.0, 10.0, 1.0, 1.0]}, {"text": "Later", "bbox": [0.0, 90.0, 1.0, 1.0]}]
    rows = [page(text="Intro\nSome words stand here. Later\nMore.", headings=heads, tables=[table]), page(page_no=2, etat="error", text="lost"), page(page_no=3, doc_id=None, page=None, text="no name")]
    chunks, parents = pages.build(page_rows(spark, rows), S)
    got = {r.text: r for r in chunks.collect()}
    assert got["Intro\nSome words stand here."].text_indexed.startswith("GUIDE — Intro — page 1\n")
    assert got["Name : a ; Value : 1"].section == "Intro" and "lost" not in got and got["no name"].doc_id == "unknown"
    ids = {r.parent_id for r in chunks.collect()}
    assert ids == {r.parent_id for r in parents.collect()} and len({r.chunk_id for r in chunks.collect()}) == len(got)


def test_parents_are_bounded_and_ids_stable(spark):
    s = ChunkSettings(chunk_tokens=64, max_seq_length=128, parent_tokens=256)
    text = D.text(80)
    chunks, parents = pages.build(page_rows(spark, [page(text=text)]), s)
    assert all(r.n_tokens <= 256 for r in parents.collect()) and all(r.n_tokens_indexed + 2 <= 128 for r in chunks.collect())
    again, _ = pages.build(page_rows(spark, [page(page_no=0, page=7, text="A new first page."), page(text=text)]), s)
    assert {r.chunk_id for r in chunks.collect()} < {r.chunk_id for r in again.collect()}


def test_repeats_across_pages(spark):
    notice = D.text(3)
    heads = lambda t: [{"text": t, "bbox": None}]
    rows = [page(page_no=i, page=i, text=f"{t}\n\n{notice}", headings=heads(t)) for i, t in enumerate("ABC")]
    chunks, _ = pages.build(page_rows(spark, rows), ChunkSettings(chunk_tokens=200, max_seq_length=300))
    assert chunks.count() == 3  # the headings differ, so the texts do
    rows = [page(page_no=i, page=i, text=notice, headings=None) for i in range(3)]
    chunks, parents = pages.build(page_rows(spark, rows), ChunkSettings(chunk_tokens=200, max_seq_length=300))
    assert (chunks.count(), parents.count()) == (1, 1)
    off, _ = pages.build(page_rows(spark, rows), ChunkSettings(chunk_tokens=200, max_seq_length=300, dedup=False))
    assert len({r.chunk_id for r in off.collect()}) == 3


def test_strategies_overlap_and_empty(spark):
    rows = page_rows(spark, [page(text=D.text(20))])
    for strategy in ("structural", "recursive", "fixed"):
        s = ChunkSettings(strategy=strategy, chunk_tokens=64, max_seq_length=128, chunk_overlap=8)
        assert pages.build(rows, s)[0].count() > 3
    chunks, parents = pages.build(rows.limit(0), S)
    assert (chunks.count(), parents.count()) == (0, 0)
    assert linked.diagnostics(*pages.build(rows, S), S).first().over_limit == 0


def test_word_folder(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(D.package(D.heading("Intro"), D.para(D.text(5)), D.table([["A", "B"], ["1", "2"]])))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "~$good.docx").write_bytes(b"lock")
    docs = word.documents(word.packages(spark, str(tmp_path))).cache()
    assert {r.path.rsplit("/", 1)[-1]: bool(r.error) for r in docs.collect()} == {"good.docx": False, "bad.docx": True}
    chunks, parents = word.chunked(docs, S)
    got = chunks.collect()
    assert {r.doc_id for r in got} == {"good"} and {r.source for r in got} == {"word"} and {r.block_type for r in got} == {"text", "table"}
    assert {r.parent_id for r in got} == {r.parent_id for r in parents.collect()}
    assert word.sectioned(docs).count() >= 2
    assert word.as_markdown(docs.where("payload is not null")).first().markdown.startswith("## Intro")


# ---------------------------------------------------------------- SQL parity


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_parity(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.SQL[name])
    order = sorted(rel.columns)
    assert sorted(df.columns) == order
    key = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    at = [rel.columns.index(c) for c in order]
    assert key([tuple(r[c] for c in order) for r in df.collect()]) == key([tuple(r[i] for i in at) for r in rel.fetchall()])


def test_table_rows_equal_the_plain_function(spark):
    from sheafline.functions.tables import Table
    from sheafline.operators.tables import row_texts

    cases = [
        {"header": ["A", None, ""], "rows": [["x", "y", "z"], ["Lot", None, "-"], [None, "v"], [], None, ["—", " ", "|"]], "types": ["donnee", "intercalaire", "donnee", "donnee", "donnee", "donnee"]},
        {"header": None, "rows": [["a", "b"], ["c"]], "types": None},
        {"header": ["A"], "rows": [["x"]], "types": []},
        {"header": ["A", "B"], "rows": [["x", "y"], ["late", "row"]], "types": ["donnee"]},
        {"header": ["A", "B"], "rows": None, "types": None},
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, tbl struct<header: array<string>, rows: array<array<string>>, types: array<string>>")
    want = sorted((k, i, t) for k, c in enumerate(cases) for i, t in Table.of(c).row_texts())
    assert values(row_texts(df, ["k"])) == want
