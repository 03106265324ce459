"""Word packages and structured documents on Spark: one document is one row and one unit of work.

``binaryFile`` brings packages; everything below runs inside the scan's tasks, so a
document is never shuffled as bytes.  A package that can't be read gives a row with
its error instead of failing the job; lock files are skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkSettings, HierarchySettings, ParserSettings
from ..functions.roles import classify
from ..functions.sections import Sectioner
from ..functions.structured import document_id
from ..functions.tree import markdown, to_document
from ..sources.word import Para, read
from . import structured
from .linked import link
from .shred import parse_object


def packages(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every package below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


_DOCUMENT = "path string, payload string, error string, warnings array<string>"


def documents(files: DataFrame, settings: ParserSettings = ParserSettings(), mode: str = "sidecar") -> DataFrame:
    """path, payload (JSON of the structured document), error, warnings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"].tolist(), batch["content"].tolist()):
                payload = error = None
                warnings: list[str] = []
                try:
                    parsed = read(content, settings)
                    payload = json.dumps(to_document(parsed, path.rsplit("/", 1)[-1], settings, mode), ensure_ascii=False)
                    warnings = parsed.warnings
                except Exception as e:  # one broken file must not end the job
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [path], "payload": [payload], "error": [error], "warnings": [warnings]})

    return files.mapInPandas(run, _DOCUMENT)


_BLOCK = (
    "path string, pos int, kind string, role string, level int, source string, confidence double, marker string, text string, style string, outline int, page int, size double, bold double, "
    "seq string, toc_level int, toc_page string, target int, images int, notes array<string>, links array<string>, in_textbox boolean, header_source string, nested int, "
    "cells array<struct<row:int,col:int,rows:int,cols:int,text:string,header:boolean>>"
)


def blocks(files: DataFrame, settings: ParserSettings = ParserSettings()) -> DataFrame:
    """Every block of every readable package in reading order, with its role; a table's cells are an array."""
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def rows(path: str, content: bytes) -> Iterator[dict]:
        parsed = read(content, settings)
        classify(parsed.blocks, settings)
        for pos, b in enumerate(parsed.blocks):
            row = dict.fromkeys(names) | {"path": path, "pos": pos, "page": b.page}
            if isinstance(b, Para):
                row |= {k: getattr(b, k) for k in ("role", "level", "source", "confidence", "marker", "text", "outline", "size", "bold", "seq", "toc_level", "toc_page", "target", "in_textbox")}
                row |= {"kind": "paragraph", "style": b.style_name, "images": len(b.images), "notes": [n for _, n in b.notes], "links": b.hyperlinks}
            else:
                row |= {"kind": "table", "header_source": b.header_source, "nested": len(b.nested), "cells": [(c.row, c.col, c.rows, c.cols, c.text, c.header) for c in b.cells]}
            yield row

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"].tolist(), batch["content"].tolist()):
                try:
                    got = list(rows(path, content))
                except Exception:  # ``documents`` names the error
                    continue
                frame = pd.DataFrame(got, columns=names)
                for c in ("level", "outline", "toc_level", "target", "images", "nested"):
                    frame[c] = frame[c].astype("Int64")
                yield frame

    return files.select("path", "content").mapInPandas(run, _BLOCK)


def items(docs: DataFrame) -> DataFrame:
    """path, self_ref, parent, label, layer, text, level, marker of every item of structured documents."""
    node = "array<struct<self_ref:string,parent:struct<`$ref`:string>,label:string,content_layer:string,text:string,level:int,marker:string>>"
    doc = F.from_json("payload", f"texts {node}, tables {node}, pictures {node}, groups {node}")
    every = F.explode(F.concat(*(F.coalesce(F.col("d")[k], F.array()) for k in ("groups", "texts", "tables", "pictures"))))
    return docs.select("path", doc.alias("d")).select("path", every.alias("i")).select("path", "i.self_ref", F.col("i.parent")["$ref"].alias("parent"), "i.label", F.col("i.content_layer").alias("layer"), "i.text", "i.level", "i.marker")


def chunked(docs: DataFrame, settings: ChunkSettings) -> tuple[DataFrame, DataFrame]:
    """Linked chunks and parents of structured documents (path, payload)."""
    rows = docs.where(F.col("payload").isNotNull()).select(F.xxhash64("path").alias("rec_id"), "payload", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"))
    return link(structured.emissions(rows, settings, stem="stem"), settings)


_HCHUNK = (
    "doc_id string, chunk_id string, text string, embed_text string, heading_path array<string>, kind string, item_refs array<string>, order_start int, order_end int, page_start int, page_end int, "
    "token_count int, content_hash string, prev string, next string, duplicate_refs array<string>"
)


def sectioned(records: DataFrame, settings: HierarchySettings = HierarchySettings(), *, payload: str = "payload", doc_id: str | None = None) -> DataFrame:
    """Chunks of the heading-driven chunker; ``doc_id`` names a column, else the document's own id is used."""
    rows = records.select(F.col(payload).alias("payload"), (F.col(doc_id).cast("string") if doc_id else F.lit(None).cast("string")).alias("id"))
    names = [c.split()[0] for c in _HCHUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[dict] = []
            for text, given in zip(batch["payload"].tolist(), batch["id"].tolist()):
                doc = parse_object(text)
                if doc is None or doc.get("schema_name") != "DoclingDocument":
                    continue
                sha = (((doc.get("x_docx") or {}).get("document") or {}).get("sha256") or "")[:16]
                out += Sectioner(doc, settings).chunks(given or sha or document_id(doc))
                if len(out) >= 5_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, _HCHUNK)


def as_markdown(docs: DataFrame) -> DataFrame:
    """path, markdown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [markdown(d) if (d := parse_object(p)) and "body" in d else None for p in batch["payload"]]
            yield pd.DataFrame({"path": batch["path"], "markdown": texts})

    return docs.select("path", "payload").mapInPandas(run, "path string, markdown string")
