"""The three entries: Word packages, structured documents, page records; each to chunks and parents."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..config import ChunkSettings, HierarchySettings
from ..operators import linked, pages, structured, word
from ..operators.linked import link
from ..shared import Scratch
from ..sources import files
from . import sinks


def from_pages(spark: SparkSession, path: str, settings: ChunkSettings) -> tuple[DataFrame, DataFrame]:
    return pages.build(files.page_records(spark, path), settings)


def from_documents(spark: SparkSession, path: str, settings: ChunkSettings) -> tuple[DataFrame, DataFrame]:
    rows = structured.emissions(files.structured_documents(spark, path), settings, stem="stem")
    return link(rows, settings)


def from_word(spark: SparkSession, path: str, settings: ChunkSettings) -> tuple[DataFrame, DataFrame]:
    docs = Scratch(spark, "word").keep(word.documents(word.packages(spark, path)), "documents")
    return word.chunked(docs, settings)


def sectioned_word(spark: SparkSession, path: str, settings: HierarchySettings = HierarchySettings()) -> DataFrame:
    return word.sectioned(word.documents(word.packages(spark, path)), settings)


def main(argv: list[str] | None = None) -> int:
    """0 if there are chunks, else 1."""
    p = argparse.ArgumentParser(prog="sheafline", description="page records, structured documents or Word packages to chunks and parents")
    source = p.add_mutually_exclusive_group(required=True)
    for name in ("pages", "documents", "word"):
        source.add_argument(f"--{name}")
    p.add_argument("--out", required=True)
    p.add_argument("--structured", action="store_true", help="of Word packages also the structured JSON and the Markdown, below --out")
    p.add_argument("--format", choices=["json", "parquet"], default="json")
    p.add_argument("--strategy", choices=["structural", "recursive", "fixed"])
    p.add_argument("--chunk-tokens", type=int)
    p.add_argument("--parent-tokens", type=int)
    p.add_argument("--overlap", type=int)
    p.add_argument("--counter")
    p.add_argument("--no-dedup", action="store_true")
    a = p.parse_args(argv)
    given = {"strategy": a.strategy, "chunk_tokens": a.chunk_tokens, "parent_tokens": a.parent_tokens, "chunk_overlap": a.overlap, "counter": a.counter, "dedup": False if a.no_dedup else None}
    settings = replace(ChunkSettings(), **{k: v for k, v in given.items() if v is not None})
    spark = SparkSession.builder.appName("sheafline").getOrCreate()
    read = {"pages": from_pages, "documents": from_documents, "word": from_word}
    kind = next(k for k in read if getattr(a, k))
    chunks, parents = read[kind](spark, getattr(a, kind), settings)
    sinks.write_tables(chunks, parents, a.out, a.format)
    if a.structured and a.word:
        docs = Scratch(spark, "structured").keep(word.documents(word.packages(spark, a.word)), "documents")
        sinks.write_documents(docs, f"{a.out}/documents")
        word.as_markdown(docs.where("payload IS NOT NULL")).write.mode("overwrite").json(f"{a.out}/markdown")
    report = linked.diagnostics(chunks, parents, settings).first()
    for name, value in (report.asDict() if report else {}).items():
        print(f"{name}: {value}")
    return 0 if report and report.chunks else 1
