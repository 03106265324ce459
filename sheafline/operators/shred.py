"""Deeply nested records to related flat tables (problem 5): shared inlining.

The schema graph of all records is analysed first: its nodes are element types
(the field that holds an object; every object with an identity field is one type,
``item``), its edges say which type occurs in which and whether several times, and each
type's scalar fields have their JSON kinds.  A type that is repeated, occurs under several
types, or can contain itself gets a table of its own; every other type is inlined into the
table of its nearest ancestor that has one, under its path.  A second pass shreds each
record into rows of these tables with the row's number, its parent's table and row (the
foreign key), the field and position it came from, and the item it belongs to.
``relation_table`` gives a relation with typed columns, ``elements`` all elements of a type
wherever the graph has put them.  The record is the unit of both passes, so neither shuffles
the payloads; the graph - one row for each distinct edge and field, as many as there are
field names - is all that reaches the driver.

Objects whose keys are references (``#/...``) are maps: each entry is a row of the
entry's type under its key.  Defined results: a payload that is null, empty, cut
off or no JSON object gives no rows; null and (recursively) empty objects and
lists aren't entries; repeated records keep their own rows; depth is unlimited.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch

IDENTITY = "self_ref"
ITEM = "item"
ROOT_TYPE = "record"

_SPACE = " \t\n\r"
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def _reject(name: str):
    raise ValueError(name)


def _parse_deep(text: str):
    """JSON of any depth without recursion: containers on a stack, scalars by the library."""
    scan = json.JSONDecoder(parse_constant=_reject).raw_decode
    n, i, stack, key = len(text), 0, [], None
    value: object = None
    state = "value"
    while True:
        while i < n and text[i] in _SPACE:
            i += 1
        if i >= n:
            raise ValueError("cut off")
        c = text[i]
        if state in ("value", "first") and not (state == "first" and c == "]"):
            if c in "{[":
                stack.append(({} if c == "{" else [], key))
                key, i = None, i + 1
                state = "key1" if c == "{" else "first"
                continue
            value, i = scan(text, i) if c == '"' else _atom(text, i)
        elif state in ("key", "key1") and c == '"':
            key, i = scan(text, i)
            while i < n and text[i] in _SPACE:
                i += 1
            if i >= n or text[i] != ":":
                raise ValueError("no colon")
            i, state = i + 1, "value"
            continue
        elif state == "first" or (state in ("key1", "after") and c == "}") or (state == "after" and c == "]"):
            box, outer = stack.pop()
            if (c == "}") != isinstance(box, dict):
                raise ValueError("brackets")
            value, key, i = box, outer, i + 1
        elif state == "after" and c == ",":
            i, state = i + 1, "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        else:
            raise ValueError(f"unexpected {c!r}")
        if not stack:
            if text[i:].strip(_SPACE):
                raise ValueError("trailing text")
            return value
        box = stack[-1][0]
        if isinstance(box, dict):
            box[key] = value
            key = None
        else:
            box.append(value)
        state = "after"


def _atom(text: str, i: int):
    m = _ATOM.match(text, i)
    if not m:
        raise ValueError("no value")
    return json.loads(m.group()), m.end()


class Parsed:
    """A payload's object and, for every object in it, how many of its fields hold something.

    Null, and lists and objects without content however deep, hold nothing.
    """

    def __init__(self, payload: str | None) -> None:
        self.top: dict | None = None
        self.entries: dict[int, int] = {}
        if not payload or not isinstance(payload, str):
            return
        try:
            value = json.loads(payload, object_hook=self._count, parse_constant=_reject)
        except RecursionError:
            try:
                value = _parse_deep(payload)
            except ValueError:
                return
            self.entries = {}
            todo = [(value, False)]
            while todo:
                x, back = todo.pop()
                if back:
                    if isinstance(x, dict):
                        self._count(x)
                    else:
                        self.entries[id(x)] = sum(map(self._holds, x))
                else:
                    todo.append((x, True))
                    todo.extend((y, False) for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (dict, list)))
        except ValueError:
            return
        if isinstance(value, dict):
            self.top = value

    def _holds(self, value) -> bool:
        t = type(value)
        if t is dict:
            return self.entries[id(value)] > 0
        if t is list:
            known = self.entries.get(id(value))
            return any(map(self._holds, value)) if known is None else known > 0
        return value is not None

    def _count(self, value: dict) -> dict:
        n = 0
        for v in value.values():
            t = type(v)
            n += (t is not dict and t is not list and v is not None) or (v is not None and self._holds(v))
        self.entries[id(value)] = n
        return value


def parse_object(payload: str | None) -> dict | None:
    """The payload's object, or None if it isn't one."""
    return Parsed(payload).top


def _is_map(value: dict) -> bool:
    return bool(value) and all(k.startswith("#/") for k in value)


def _is_item(value: dict) -> bool:
    return isinstance(value.get(IDENTITY), str) and value[IDENTITY] != ""


def _type(name: str, value: dict) -> str:
    return ITEM if _is_item(value) else name


def _objects(value: dict):
    """(field, position or None, key or None, object) of every object directly held, scalars apart."""
    for name, v in value.items():
        if isinstance(v, dict):
            if _is_map(v):
                for k, x in v.items():
                    if isinstance(x, dict):
                        yield name, None, k, x
                    elif isinstance(x, list):
                        yield from _listed(name, k, x)
            else:
                yield name, None, None, v
        elif isinstance(v, list):
            yield from _listed(name, None, v)


def _listed(name: str, key: str | None, entries: list):
    """Every object of a list and of the lists in it, however deep; those of a grid's rows count as entries of the row."""
    todo = [(name, i, x) for i, x in reversed(list(enumerate(entries)))]
    while todo:
        at, i, x = todo.pop()
        if isinstance(x, dict):
            yield at, i, key, x
        elif isinstance(x, list):
            todo.extend((f"{name}_row", j, y) for j, y in reversed(list(enumerate(x))))


@dataclass(frozen=True)
class SchemaGraph:
    """Element types, their scalar fields, and which types have tables of their own."""

    edges: tuple[tuple[str, str, bool], ...]
    #: (type, field, SQL type) of scalar fields.
    fields: tuple[tuple[str, str, str], ...] = ()
    tables: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        parents: dict[str, set[str]] = {}
        below: dict[str, set[str]] = {}
        repeated = set()
        for parent, child, many in self.edges:
            parents.setdefault(child, set()).add(parent)
            below.setdefault(parent, set()).add(child)
            if many:
                repeated.add(child)
        recursive = set()
        for start in below:
            todo, seen = list(below[start]), set()
            while todo:
                x = todo.pop()
                if x == start:
                    recursive.add(start)
                    break
                if x not in seen:
                    seen.add(x)
                    todo.extend(below.get(x, ()))
        shared = {c for c, p in parents.items() if len(p) > 1}
        object.__setattr__(self, "tables", frozenset({ROOT_TYPE, ITEM} | repeated | recursive | shared))

    def parts(self, table: str) -> dict[str, str]:
        """Path and type of every element in a table's rows: the row itself under the empty path, and what is inlined."""
        out, todo = {}, [("", table)]
        while todo:
            path, kind = todo.pop()
            out[path] = kind
            todo.extend((f"{path}{c}.", c) for p, c, _ in self.edges if p == kind and c not in self.tables)
        return dict(sorted(out.items()))


#: SQL types by kind of JSON scalar; a field of several kinds is a string, one of integers and fractions a double.
_KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def _graph_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges: Counter = Counter()
    fields: Counter = Counter()
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            top = parse_object(payload)
            todo = [(ROOT_TYPE, top)] if top else []
            while todo:
                name, value = todo.pop()
                for k, v in value.items():
                    if isinstance(v, list):
                        if v and not isinstance(v[0], (dict, list)):
                            fields[name, k, "string"] += 1
                    elif v is not None and not isinstance(v, dict):
                        fields[name, k, _KINDS[type(v)]] += 1
                for child, pos, key, x in _objects(value):
                    kind = _type(child, x)
                    edges[name, kind, pos is not None or key is not None] += 1
                    todo.append((kind, x))
    rows = [(p, c, m, None) for p, c, m in edges] + [(t, f, None, k) for t, f, k in fields]
    if rows:
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["parent", "child", "many", "kind"])


def analyse(records: DataFrame, payload: str = "payload") -> SchemaGraph:
    """The schema graph of all records (one row per distinct edge or field reaches the driver)."""
    rows = records.select(F.col(payload).alias("payload")).mapInArrow(_graph_batches, "parent string, child string, many boolean, kind string").distinct().collect()
    kinds: dict[tuple[str, str], set[str]] = {}
    for r in rows:
        if r.kind:
            kinds.setdefault((r.parent, r.child), set()).add(r.kind)
    typed = tuple(sorted((t, f, k.pop() if len(k) == 1 else "double" if k == {"bigint", "double"} else "string") for (t, f), k in kinds.items()))
    return SchemaGraph(tuple(sorted((r.parent, r.child, r.many) for r in rows if r.kind is None)), typed)


_ROW = "rec_id long, relation string, row_no long, up_relation string, up_row long, field string, pos int, entry_key string, self_ref string, parent_ref string, place string, n_entries int, cols map<string,string>, parts map<string,int>"


def _text(value) -> str:
    if value is True or value is False:
        return "true" if value else "false"
    return str(value) if type(value) is int else json.dumps(value, ensure_ascii=False)


def shred_object(record: Parsed, graph: SchemaGraph) -> Iterator[tuple]:
    """Rows of one record, parents before children; the last two columns are lists of pairs.

    cols: scalars by path, those of the row's own element under their names; parts: the inlined
    elements' paths and how many of their fields hold something.

    place: ``held`` for an object directly in its item, ``own`` for an entry of a list
    directly in the item or in an object it holds, ``meta`` for what lies in an item's
    metadata or in an entry of the record's sidecar, ``inner`` for anything deeper.
    """
    row_no = 0
    top, entries, tables = record.top, record.entries, graph.tables
    # value, relation type, up relation, up row, field, pos, key, self_ref, parent_ref, place
    todo = [(top, ROOT_TYPE, None, None, None, None, None, None, None, "record")]
    while todo:
        value, kind, up_rel, up_row, name, pos, key, ref, parent_ref, place = todo.pop()
        if kind == ITEM:
            outer, ref = ref, value[IDENTITY]
            up = value.get("parent")
            parent_ref = up.get("$ref") if isinstance(up, dict) else up if isinstance(up, str) else None
            parent_ref = parent_ref if isinstance(parent_ref, str) else outer
            place = "item"
        elif key is not None:
            ref, place = key, "sidecar"
        own = row_no
        row_no += 1
        cols: list[tuple[str, str]] = []
        parts: list[tuple[str, int]] = []
        children = []
        inline = [(value, "", place)]
        while inline:
            part, prefix, at = inline.pop()
            if prefix:
                parts.append((prefix, entries[id(part)]))
            nested = False
            for field_name, v in part.items():
                t = type(v)
                if t is str:
                    if prefix or kind != ITEM or field_name != IDENTITY:
                        cols.append((prefix + field_name, v))
                elif t is dict:
                    nested = True
                elif t is not list:
                    if v is not None:
                        cols.append((prefix + field_name, _text(v)))
                elif any(type(x) is dict or type(x) is list for x in v):
                    nested = True
                elif v:
                    cols.append((prefix + field_name, _text(v)))
            for child, p, k, x in _objects(part) if nested else ():
                child_kind = _type(child, x)
                if at == "item":
                    where = "meta" if child == "meta" and p is None else "held" if p is None else "own"
                elif at in ("meta", "sidecar"):
                    where = "meta"
                else:
                    where = "own" if at == "held" and p is not None else "inner"
                if child_kind in tables:
                    children.append((x, child_kind, kind, own, child, p, k, ref, parent_ref, where))
                else:
                    inline.append((x, f"{prefix}{child}.", where))
        yield kind, own, up_rel, up_row, name, pos, key, ref, parent_ref, place, entries[id(value)], cols, parts
        todo.extend(reversed(children))


def _pairs(lists: list[list[tuple]], kind: pa.DataType) -> pa.MapArray:
    ends = [0]
    for x in lists:
        ends.append(ends[-1] + len(x))
    keys, values = zip(*(p for x in lists for p in x)) if ends[-1] else ((), ())
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, kind))


def _row_batch(rec_ids: list, rows: list[tuple]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = [text, number, text, number, text, pa.int32(), text, text, text, text, pa.int32()]
    *plain, cols, parts = zip(*rows)
    arrays = [pa.array(rec_ids, number), *(pa.array(c, k) for c, k in zip(plain, kinds)), _pairs(cols, text), _pairs(parts, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _ROW.replace("map<string,", "map<string;").split(", ")])


def shred(records: DataFrame, graph: SchemaGraph, *, rec_id: str = "rec_id", payload: str = "payload") -> DataFrame:
    """All relations' rows as one table; ``relation_table`` takes one relation out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            out: list[tuple] = []
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = Parsed(text)
                for row in shred_object(record, graph) if record.top is not None else ():
                    ids.append(rec)
                    out.append(row)
                    if len(out) >= 20_000:
                        yield _row_batch(ids, out)
                        ids, out = [], []
            if out:
                yield _row_batch(ids, out)

    return records.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(payload).alias("payload")).mapInArrow(run, _ROW)


KEYS = ["rec_id", "row_no", "up_relation", "up_row", "field", "pos", "entry_key", "self_ref", "parent_ref", "place", "n_entries"]


def relation_table(rows: DataFrame, graph: SchemaGraph, relation: str) -> DataFrame:
    """One relation as a flat table: keys, foreign keys and the scalars of the row and its inlined elements, typed.

    Columns are named by their paths (``size_width``); a path that clashes with another column gets a number.
    """
    taken, columns = set(KEYS), []
    for path, kind in graph.parts(relation).items():
        for owner, name, sql_type in graph.fields:
            if owner == kind and not (path == "" and kind == ITEM and name == IDENTITY):
                label = base = (path + name).replace(".", "_")
                n = 2
                while label.lower() in taken:
                    label, n = f"{base}_{n}", n + 1
                taken.add(label.lower())
                columns.append(_typed(F.col("cols")[path + name], sql_type).alias(label))
    return rows.where(F.col("relation") == relation).select(*KEYS, *columns)


def _typed(value: Column, sql_type: str) -> Column:
    return value if sql_type == "string" else value.try_cast(sql_type)


def elements(rows: DataFrame, graph: SchemaGraph, name: str, columns: list[str]) -> DataFrame:
    """All elements of a type with content, from its own table or out of the tables it is inlined in.

    rec_id, self_ref, parent_ref, up_relation, pos, place and the named scalars; place as in ``shred_object``.
    """
    found = None
    for table in sorted(graph.tables):
        for path, kind in graph.parts(table).items():
            if kind != name:
                continue
            here = rows.where((F.col("relation") == table) & (F.col("n_entries") if path == "" else F.coalesce(F.col("parts")[path], F.lit(0))).cast("int").__gt__(0))
            inside = "meta" if path.startswith("meta.") else "held" if path.count(".") == 1 else "inner"
            place = F.col("place") if path == "" else F.when(F.col("place") == "item", inside).when(F.col("place").isin("meta", "sidecar"), "meta").otherwise("inner")
            holder = F.col("up_relation") if path == "" else F.lit(graph.parts(table)[path[:-1].rpartition(".")[0] + "." if path.count(".") > 1 else ""])
            pos = F.col("pos") if path == "" else F.lit(None).cast("int")
            scalars = F.map_filter("cols", lambda k, v: k.startswith(path)) if path else F.col("cols")
            part = here.select("rec_id", "self_ref", "parent_ref", holder.alias("up_relation"), pos.alias("pos"), place.alias("place"), *(F.col("cols")[path + c].alias(c.replace(".", "_")) for c in columns), scalars.alias("entries"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.where(F.lit(False)).select("rec_id", "self_ref", "parent_ref", "up_relation", "pos", "place", *(F.col("cols")[c].alias(c.replace(".", "_")) for c in columns), F.col("cols").alias("entries"))
    return found


CELL_LISTS = ("cells", "table_cells")


def document_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cells, images and metadata: each row with its record, item and that item's parent.

    A cell belongs to the item whose own list holds it; an image is an item's own
    field or lies in its metadata; metadata is the item's ``meta`` or the record's
    sidecar entry under the item's name.  The item ``#/body`` is the root, not an item.
    """
    graph = analyse(records)
    rows = Scratch(records.sparkSession, "shred").keep(shred(records, graph), "rows")  # read by every table
    real = F.col("self_ref") != "#/body"
    whole, truth = ["start_row", "start_col", "start_row_offset_idx", "start_col_offset_idx", "row_span", "col_span"], ["column_header", "row_header", "row_section"]
    cells = None
    for name in CELL_LISTS:
        part = elements(rows, graph, name, ["text", *whole, *truth]).where((F.col("place") == "own") & F.col("pos").isNotNull() & real)
        part = part.select("rec_id", "self_ref", "parent_ref", "pos", "text", *(F.col(c).try_cast("int").alias(c) for c in whole), *(F.col(c).try_cast("boolean").alias(c) for c in truth))
        cells = part if cells is None else cells.unionByName(part)
    names = rows.where((F.col("relation") == ITEM) & real).groupBy("rec_id", "self_ref").agg(F.min("parent_ref").alias("parent_ref"))
    image_columns = ["uri", "mimetype", "dpi", "sha256", "size.width", "size.height", "display_size_cm.width", "display_size_cm.height"]
    found = elements(rows, graph, "image", image_columns).where(F.col("place").isin("held", "meta") & F.col("pos").isNull() & real).withColumn("dpi", F.col("dpi").try_cast("double"))
    found = found.select("*", *(F.col(c).try_cast("double").alias(f"{c}_") for c in found.columns if c.startswith(("size_", "display_size_"))))
    wanted = ["rec_id", "self_ref", "uri", "mimetype", "dpi", "sha256", *(F.col(f"{c}_").alias(c) for c in found.columns if c.startswith(("size_", "display_size_")) and not c.endswith("_"))]
    # the sidecar's entries name their item; whose parent that is, the item says
    beside = (F.col("up_relation") == "items") & (F.col("place") == "meta")
    images = found.where(~beside).select("parent_ref", *wanted).unionByName(found.where(beside).select(*wanted).join(names, ["rec_id", "self_ref"]), allowMissingColumns=False)
    inside = elements(rows, graph, "meta", []).where((F.col("up_relation") == ITEM) & F.col("pos").isNull() & (F.col("place") == "meta") & real)
    side = elements(rows, graph, "items", []).where((F.col("place") == "sidecar") & (F.col("up_relation") != ITEM) & real)
    meta = (
        inside.select("rec_id", "self_ref", "parent_ref", F.lit("item").alias("kept_in"), F.to_json("entries").alias("entries"))
        .unionByName(side.select("rec_id", "self_ref", F.lit("sidecar").alias("kept_in"), F.to_json("entries").alias("entries")).join(names, ["rec_id", "self_ref"]))
    )
    return cells, images, meta


def parts(records: DataFrame) -> DataFrame:
    """rec_id, self_ref, part_kind, pos: one row for each cell, image and metadata holder."""
    cells, images, meta = document_tables(records)
    zero = F.lit(0).alias("pos")
    return (
        cells.select("rec_id", "self_ref", F.lit("cell").alias("part_kind"), "pos")
        .unionByName(images.select("rec_id", "self_ref", F.lit("image").alias("part_kind"), zero))
        .unionByName(meta.select("rec_id", "self_ref", F.lit("meta").alias("part_kind"), zero))
        .distinct()
    )
