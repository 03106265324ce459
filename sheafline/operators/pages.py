"""Page records to linked chunks.

One pass over the pages cuts each into sections at its headings, sections into
bounded parents, parents into children, and tables into windows and rows; see
``linked`` for what holds across pages.  Failed pages are dropped; a null doc_id is
``unknown``, a null page 0, a null source ``native``; null headings, tables and boxes
count as absent; pages without text give tables only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkSettings
from ..functions.splitting import counter, recursive
from ..functions.tables import Table
from .linked import EMISSION, FRAME_ROWS, Emitter, emission_frame, link

PAGE_SCHEMA = (
    "doc_id string, page int, text string, etat string, source string, est_figure boolean, headings array<struct<text: string, bbox: array<double>>>, "
    "tables array<struct<header: array<string>, rows: array<array<string>>, types: array<string>, bbox: array<double>>>"
)


def usable(pages: DataFrame) -> DataFrame:
    """Pages that didn't fail, with defaults for what is absent."""
    return pages.where(F.coalesce("etat", F.lit("")) != "error").withColumns(
        {"doc_id": F.coalesce("doc_id", F.lit("unknown")), "page": F.coalesce("page", F.lit(0)), "source": F.coalesce("source", F.lit("native")), "text": F.coalesce("text", F.lit("")), "est_figure": F.coalesce("est_figure", F.lit(False))}
    )


def heading_positions(text: Column, headings: Column) -> Column:
    """Headings found one after the other in the text: array of (start from 1, title); unfound ones are passed over."""
    titles = F.filter(F.transform(F.coalesce(headings, F.array().cast("array<struct<text:string,bbox:array<double>>>")), lambda h: F.trim(h["text"])), lambda t: t.isNotNull() & (t != ""))
    start = F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<at:int,title:string>>").alias("found"))

    def step(acc, title):
        at = F.call_function("locate", title, text, acc["from"])
        hit = at > 0
        return F.struct(F.when(hit, at + F.length(title)).otherwise(acc["from"]).alias("from"), F.when(hit, F.concat(acc["found"], F.array(F.struct(at.alias("at"), title.alias("title"))))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(titles, start, step)["found"]


def page_sections(pages: DataFrame) -> DataFrame:
    """One row per section of a page: its title (empty before the first heading) and text."""
    found = pages.withColumn("found", heading_positions(F.col("text"), F.col("headings")))
    lead = F.when((F.size("found") == 0) | (F.element_at("found", 1)["at"] > 1), F.array(F.struct(F.lit(1).alias("at"), F.lit("").alias("title")))).otherwise(F.array().cast("array<struct<at:int,title:string>>"))
    marks = found.withColumn("marks", F.concat(F.when(F.size("found") > 0, lead).otherwise(F.array(F.struct(F.lit(1).alias("at"), F.lit("").alias("title")))), "found"))
    out = marks.select("*", F.posexplode("marks").alias("section_no", "mark"))
    nxt = F.when(F.col("section_no") + 1 < F.size("marks"), F.element_at("marks", F.col("section_no") + 2)["at"]).otherwise(F.length("text") + 1)
    body = F.substr(F.col("text"), F.col("mark.at"), nxt - F.col("mark.at"))
    return out.withColumns({"section": F.col("mark.title"), "body": body}).where(F.regexp_replace("body", r"(?U)[\s\x1c-\x1f]+", "") != "").drop("found", "marks", "mark")


def title_above(headings: Column, box: Column) -> Column:
    """The lowest heading above a table (first on ties), by the top edges of their boxes; empty if none."""
    y = F.get(box, F.lit(1))
    above = F.filter(
        F.transform(F.coalesce(headings, F.array().cast("array<struct<text:string,bbox:array<double>>>")), lambda h, i: F.struct(F.get(h["bbox"], F.lit(1)).alias("y"), (-i).alias("pos"), F.coalesce(F.trim(h["text"]), F.lit("")).alias("text"))),
        lambda h: h["y"].isNotNull() & (h["y"] < y),
    )
    return F.coalesce(F.array_max(above)["text"], F.lit(""))


def page_tables(pages: DataFrame) -> DataFrame:
    """One row per table of a page with the title above it."""
    return pages.select("*", F.posexplode("tables").alias("table_no", "tbl")).withColumn("title", title_above(F.col("headings"), F.col("tbl.bbox")))


def emissions(pages: DataFrame, settings: ChunkSettings, order: str = "page_no") -> DataFrame:
    """The page-local part: sections and titles are found by expressions, splitting runs per Arrow batch."""
    rows = usable(pages).withColumn("ord", F.col(order).cast("long"))
    base = ["doc_id", "ord", "page", "source", "est_figure"]
    empty_table = F.lit(None).cast("struct<header: array<string>, rows: array<array<string>>, types: array<string>>")
    if settings.strategy == "structural":
        texts = page_sections(rows).select(*base, (F.col("section_no")).alias("unit"), F.col("section").alias("title"), "body", empty_table.alias("tbl"))
    else:
        texts = rows.select(*base, F.lit(0).alias("unit"), F.lit("").alias("title"), F.col("text").alias("body"), empty_table.alias("tbl"))
    tables = page_tables(rows).select(*base, (F.col("table_no") + 1_000_000).alias("unit"), "title", F.lit(None).cast("string").alias("body"), F.struct("tbl.header", "tbl.rows", "tbl.types").alias("tbl"))
    units = texts.unionByName(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(settings.counter)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples(index=False):
                # units of a page follow each other; a page has fewer than 2^20 units
                e = Emitter(settings, count, r.doc_id, (int(r.ord) << 21) + int(r.unit), r.source)
                if r.body is not None:
                    for block in recursive(r.body, settings.parent_limit, count):
                        parent = e.parent("p", r.title, block, int(r.page), False)
                        for piece in e.pieces(block, e.limit(r.title)):
                            e.child(parent, r.title, "text", piece, int(r.page), False, figure=bool(r.est_figure))
                else:
                    value = {k: _plain(r.tbl[k]) for k in ("header", "rows", "types")}
                    e.table(Table.of(value), "", r.title, int(r.page), False)
                out += e.rows
                if len(out) >= FRAME_ROWS:
                    yield emission_frame(out)
                    out = []
            if out:
                yield emission_frame(out)

    return units.mapInPandas(run, EMISSION)


def _plain(value):
    """Arrow's arrays as lists."""
    return None if value is None else [_plain(v) if not isinstance(v, (str, type(None))) else v for v in value]


def build(pages: DataFrame, settings: ChunkSettings, order: str = "page_no") -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) of page records."""
    return link(emissions(pages, settings, order), settings)
