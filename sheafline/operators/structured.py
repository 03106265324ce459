"""Structured documents (JSON) to linked chunks; a document is one row and one unit of work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ChunkSettings
from ..functions.splitting import counter, fixed, recursive, with_overlap
from ..functions.structured import TITLE_LABELS, Document, as_table, document_id, plain
from .linked import EMISSION, FRAME_ROWS, OTHER_SECTIONS, Emitter, emission_frame, link
from .shred import parse_object

ARROW = " > "


def pack(paras: list[dict], limit: int) -> list[list[dict]]:
    """Whole paragraphs up to the limit; a heading never ends a group but opens the next one."""
    groups: list[list[dict]] = [[]]
    used = 0
    for para in paras:
        here = groups[-1]
        if here and used + para["n"] > limit:
            moved = [here.pop()] if len(here) > 1 and here[-1]["label"] in TITLE_LABELS else []
            groups.append(moved)
            used = sum(p["n"] for p in moved)
        groups[-1].append(para)
        used += para["n"]
    return [g for g in groups if g]


def common_section(paths: list[str]) -> str:
    """The longest beginning that all heading paths share."""
    steps = [p.split(ARROW) if p else [] for p in paths]
    shared = []
    for level in zip(*steps):
        if len(set(level)) > 1:
            break
        shared.append(level[0])
    return ARROW.join(shared)


def joined(paras: list[dict]) -> str:
    """Blank lines between paragraphs, single line ends between list items."""
    out = [paras[0]["text"]]
    for before, para in zip(paras, paras[1:]):
        out += ["\n" if before["label"] == para["label"] == "list_item" else "\n\n", para["text"]]
    return "".join(out)


class Builder:
    """One document's headings, paragraphs and repeats while its blocks pass by."""

    def __init__(self, doc: dict, settings: ChunkSettings, order: int, stem: str | None = None) -> None:
        self.s = settings
        self.count = counter(settings.counter)
        self.reader = Document(doc)
        self.out = Emitter(settings, self.count, document_id(doc, stem), order, "word" if self.reader.from_word else "docling")
        self.path: list[tuple[int, str]] = []
        self.paras: list[dict] = []
        self.first: dict[str, dict] = {}
        self.opened: int | None = None
        self.held_title: dict | None = None
        self.structural = settings.strategy == "structural"
        self.titles_as_text = not self.structural or not settings.context_prefix

    @property
    def section(self) -> str:
        return ARROW.join(t for _, t in self.path)

    def para(self, text: str, block: dict) -> dict:
        return {"text": text, "label": block["label"], "page": block["page"], "approx": block["approx"], "section": self.section, "n": self.count(text), "key": None, "others": []}

    def heading(self, block: dict) -> None:
        text, level = block["text"], block["level"]
        if not text:
            return
        # a short section stays open for a sister or daughter of the one that opened it
        merging = self.structural and bool(self.paras) and self.opened is not None and level >= self.opened and sum(p["n"] for p in self.paras) < self.s.min_section_tokens
        if self.structural and not merging:
            self.flush()
            self.opened, self.held_title = level, None
        while self.path and self.path[-1][0] >= level:
            self.path.pop()
        self.path.append((level, text))
        title = self.para(text, block)
        if self.titles_as_text:
            self.paras.append(title)
        elif merging:
            if self.held_title is not None:
                self.paras.insert(0, self.held_title)
                self.held_title = None
            self.paras.append(title)
        else:
            self.held_title = title

    def repeat(self, para: dict) -> bool:
        """A long paragraph seen before in the document; the first one learns where else it stands."""
        if not self.s.dedup or para["n"] < self.s.dedup_min_tokens:
            return False
        para["key"] = plain(para["text"])
        known = self.first.setdefault(para["key"], para)
        if known is para:
            return False
        where = para["section"]
        if where != known["section"] and where not in known["others"] and len(known["others"]) < OTHER_SECTIONS:
            known["others"].append(where)
        return True

    def run(self) -> list[tuple]:
        for block in self.reader.blocks():
            kind = block["kind"]
            if kind == "heading":
                self.heading(block)
            elif kind == "text":
                para = self.para(block["text"], block)
                if not self.repeat(para):
                    self.paras.append(para)
            elif kind == "table":
                table, caption = as_table(block["item"]), self.reader.caption(block["item"])
                if table.rows and not self.out.table(table, caption, self.section, block["page"], block["approx"]):
                    self.paras.append(self.para((caption + "\n\n" + table.markdown()).strip(), block))
            else:
                text = self.reader.figure_text(block["item"])
                if text:
                    owner = self.out.parent("f", self.section, text, block["page"], block["approx"])
                    for piece in recursive(text, self.out.limit(self.section), self.count):
                        self.out.child(owner, self.section, "figure", piece, block["page"], block["approx"], figure=True)
        self.flush()
        return self.out.rows

    def flush(self) -> None:
        """The buffered paragraphs become bounded parents and their children."""
        paras, self.paras = self.paras, []
        if not paras:
            return
        named = self.s.title_in_parent
        room = max(32, self.s.parent_limit - ((max(self.count(p["section"]) for p in paras) + 2) if named else 0))
        bounded = []
        for p in paras:
            bounded += [p] if p["n"] <= room else [p | {"text": t, "n": self.count(t)} for t in recursive(p["text"], room, self.count)]
        for group in pack(bounded, room):
            head, section = group[0], common_section([p["section"] for p in group])
            body = joined(group)
            starts_with_title = head["label"] in TITLE_LABELS and section.endswith(head["text"])
            shown = f"{section}\n\n{body}" if named and section and not starts_with_title else body
            owner = self.out.parent("p", section, shown, head["page"], head["approx"], pages=sorted({p["page"] for p in group if p["page"] is not None}))
            limit = self.out.limit(section)
            if self.s.strategy == "fixed":
                cut = [(t, head, section, group) for t in fixed(body, max(1, limit))]
            else:
                cut = []
                for g in pack(group, limit):
                    whole, where = joined(g), common_section([p["section"] for p in g])
                    parts = recursive(whole, limit, self.count) if len(g) == 1 and g[0]["n"] > limit else [whole]
                    cut += [(t, g[0], where, g) for t in parts]
            texts = with_overlap([c[0] for c in cut], self.s.chunk_overlap, self.count, limit)
            for text, (_, first, where, g) in zip(texts, cut):
                self.out.child(owner, where, "text", text, first["page"], first["approx"], paras=g)


def emissions(records: DataFrame, settings: ChunkSettings, *, payload: str = "payload", order: str = "rec_id", stem: str | None = None) -> DataFrame:
    """Emissions of every record that is a structured document; others (schema_name differs, no object) give none."""
    rows = records.select(F.col(order).cast("long").alias("ord"), F.col(payload).alias("payload"), (F.col(stem) if stem else F.lit(None).cast("string")).alias("stem"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for batch in batches:
            for ord_, text, name in zip(batch["ord"].tolist(), batch["payload"].tolist(), batch["stem"].tolist()):
                doc = parse_object(text)
                if doc is not None and doc.get("schema_name") == "DoclingDocument":
                    out += Builder(doc, settings, ord_, name).run()
                if len(out) >= FRAME_ROWS:
                    yield emission_frame(out)
                    out = []
        if out:
            yield emission_frame(out)

    return rows.mapInPandas(run, EMISSION)


def build(records: DataFrame, settings: ChunkSettings, **kw) -> tuple[DataFrame, DataFrame]:
    return link(emissions(records, settings, **kw), settings)
