"""Sources, sinks, entries, descriptions of pictures, incremental chunking."""

import json
from datetime import datetime

from sheafline import fixtures as D
from sheafline.config import ChunkSettings, VisionSettings
from sheafline.operators import vision, word
from sheafline.plans import pipeline, sinks
from sheafline.sources import files
from sheafline.streaming import incremental

S = ChunkSettings(chunk_tokens=64, max_seq_length=128)


def test_pages_entry_and_json_lines(spark, tmp_path):
    lines = [{"doc_id": "guide", "page": i, "text": D.text(10, i), "headings": [], "tables": []} for i in range(3)]
    (tmp_path / "pages.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    assert pipeline.main(["--pages", str(tmp_path / "pages.jsonl"), "--out", str(tmp_path / "out"), "--chunk-tokens", "64"]) == 0
    chunks = [json.loads(x) for f in (tmp_path / "out/chunks").glob("*.json") for x in f.read_text().splitlines()]
    parents = {json.loads(x)["parent_id"] for f in (tmp_path / "out/parents").glob("*.json") for x in f.read_text().splitlines()}
    assert len(chunks) > 5 and {c["parent_id"] for c in chunks} == parents and set(chunks[0]) == set(sinks.CHUNK_FIELDS)
    (tmp_path / "none.jsonl").write_text("")
    assert pipeline.main(["--pages", str(tmp_path / "none.jsonl"), "--out", str(tmp_path / "none")]) == 1


def test_structured_documents_entry(spark, tmp_path):
    doc = {"schema_name": "DoclingDocument", "body": {"children": [{"$ref": "#/texts/0"}]}, "texts": [{"self_ref": "#/texts/0", "label": "text", "text": D.text(3), "children": []}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({"schema_name": "Other"}))
    chunks, _ = pipeline.from_documents(spark, str(tmp_path), S)
    assert {r.doc_id for r in chunks.collect()} == {"a"} and "page" not in chunks.first().text_indexed
    assert pipeline.from_documents(spark, str(tmp_path), S)[1].count() >= 1


def test_describer_cache_last_line_wins(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"key":"a","value":"1"}\n{"key":"b","value":"2"}\n{"key":"a","value":"3"}\n')
    assert {r.key: r.value for r in files.describer_cache(spark, str(tmp_path / "c.jsonl")).collect()} == {"a": "3", "b": "2"}


def test_images_are_exported_once(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.docx").write_bytes(D.package(D.drawing("x")))
    got = sinks.exported_images(word.packages(spark, str(tmp_path))).collect()
    assert len(got) == 1 and got[0].name == got[0].sha256[:20] + ".png" and bytes(got[0].content) == D.PNG


def test_descriptions(spark):
    rows = [("d", f"#/pictures/{i}", i, sha, "p", False, dec, w, 100) for i, (sha, dec, w) in enumerate([("s1", False, 100), ("s2", False, 10), ("s3", True, 100), ("s1", None, 100), (None, False, 100), ("s5", False, None), ("s6", False, 900)])]
    rows += [("d", f"#/pictures/l{i}", 50 + i, "logo", "p", False, False, 100, 100) for i in range(3)]
    pictures = spark.createDataFrame(rows, "doc_id string, self_ref string, pos int, sha256 string, part string, external boolean, decorative boolean, width int, height int")
    chosen = vision.eligible(pictures)
    assert sorted({r.sha256 for r in chosen.collect()}) == ["s1", "s5", "s6"]
    uses = vision.first_uses(chosen)
    assert sorted((r.sha256, r.pos) for r in uses.collect()) == [("s1", 0), ("s5", 5), ("s6", 6)]
    assert [r.sha256 for r in vision.first_uses(chosen, VisionSettings(max_images=1)).collect()] == ["s1"]
    contents = spark.createDataFrame([("s1", bytearray(b"one"), "image/png"), ("s6", bytearray(b"bad"), "image/png")], "sha256 string, content binary, mimetype string")
    cache = spark.createDataFrame([("s5|local:m|1", "from cache")], "key string, value string")

    def make():
        def call(data, context):
            if data == b"bad":
                raise RuntimeError("no")
            return f"{len(data)} bytes {context['mimetype']}"

        return call

    results = vision.described(uses, contents, cache, "local:m", make)
    assert sorted((r.sha256, r.text, r.state) for r in results.where("state <> 'error'").collect()) == [("s1", "3 bytes image/png", "described"), ("s5", "from cache", "cached")]
    assert results.where("state = 'error'").first().error == "RuntimeError: no"
    assert vision.fan_back(pictures, results).where("text is not null").count() == 3


def test_logos_are_counted_within_a_document(spark):
    rows = [(d, "#/pictures/0", 0, "figure") for d in ("a", "b", "c", None)] + [("d", f"#/pictures/{i}", i, "logo") for i in range(3)] + [("e", "#/pictures/0", 0, "logo")]
    rows += [("f", "#/pictures/0", 0, "again")] * 3  # one place, delivered three times
    pictures = spark.createDataFrame([(*r, "p", False, False, 100, 100) for r in rows], "doc_id string, self_ref string, pos int, sha256 string, part string, external boolean, decorative boolean, width int, height int")
    got = {(r.doc_id, r.sha256) for r in vision.eligible(pictures).collect()}
    assert got == {("a", "figure"), ("b", "figure"), ("c", "figure"), (None, "figure"), ("e", "logo"), ("f", "again")}


def test_registry():
    vision.register("local", lambda model: lambda data, context: model)
    assert vision.describer("local:m")(b"", {}) == "m"
    try:
        vision.describer("unknown:m")
        raise AssertionError
    except KeyError:
        pass


def test_neighbour_text(spark):
    rows = [("d", 0, "", True), ("d", 1, "first", False), ("d", 2, None, True), ("d", 3, "own", True)]
    got = vision.neighbour_text(spark.createDataFrame(rows, "doc_id string, pos int, text string, is_picture boolean"))
    assert sorted((r.pos, r.near) for r in got.collect()) == [(0, "first"), (2, "first"), (3, "own")]


def test_incremental_chunking(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "tables")
    folder.mkdir()

    def deliver(name, rows):
        (folder / name).write_text("\n".join(json.dumps({"doc_id": d, "page": p, "text": t, "page_no": n, "received_at": f"2025-01-0{day + 1}T00:00:00Z"}) for d, p, t, n, day in rows))
        incremental.start(spark, str(folder), base, str(tmp_path / "check"), S).awaitTermination()
        return {r.chunk_id: (r.doc_id, r.text) for r in spark.read.parquet(f"{base}/chunks").collect()}

    first = deliver("1.json", [("a", 0, D.text(5), 1, 1), ("b", 0, D.text(5, 1), 2, 1)])
    second = deliver("2.json", [("a", 1, D.text(5, 2), 3, 2), ("a", 0, "late and older", 4, 0)])
    assert set(first) < set(second) and {d for d, _ in second.values()} == {"a", "b"}
    third = deliver("3.json", [("a", 0, "Replaced.", 5, 3)])
    assert "Replaced." in {t for _, t in third.values()} and {k for k, v in first.items() if v[0] == "b"} <= set(third)
    assert not any(v[0] == "a" for k, v in third.items() if k in first)


def test_unknown_pages_stay_apart_and_parents_are_kept(spark, tmp_path):
    base = str(tmp_path / "tables")
    schema = incremental.P.PAGE_SCHEMA + ", page_no long, received_at timestamp"
    day = [datetime(2025, 1, d) for d in (1, 2, 3)]

    def page(doc, number, text, page_no, at):
        return (doc, number, text, None, None, None, None, None, page_no, at)

    first = [page(None, 3, D.text(5, 1), 1, day[0]), page("unknown", 3, D.text(5, 2), 2, day[0]), page("a", None, D.text(5, 3), 3, day[0]), page("a", None, D.text(5, 4), 4, day[0]), page("a", 1, "Old.", 5, day[0])]
    second = [page(None, 3, D.text(5, 7), 6, day[1]), page("a", 1, "New.", 7, day[1])]
    for rows in (first, second, second):  # the last is a replay
        incremental.upsert(spark.createDataFrame(rows, schema), base, S)
    want, parents = incremental.P.build(spark.createDataFrame([r for r in first + second if r[2] != "Old."], schema), S)
    got = spark.read.parquet(f"{base}/chunks")
    assert sorted(r.text for r in got.collect()) == sorted(r.text for r in want.collect())
    stored = sorted(r.parent_id for r in spark.read.parquet(f"{base}/parents").collect())
    assert stored == sorted({r.parent_id for r in got.collect()}) and len(stored) == parents.count()
