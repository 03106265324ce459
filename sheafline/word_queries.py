"""Queries over the Word packages and picture rows of ``fixtures``; their SQL holds the expected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .config import ChunkSettings, HierarchySettings, VisionSettings
from .operators import vision, word


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, bytearray(b)) for n, b in fixtures.packages().items()], "path string, content binary")


def _documents(spark: SparkSession, *names: str) -> DataFrame:
    return word.documents(_files(spark).where(F.col("path").isin(*names)) if names else _files(spark))


def docx_errors(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark)
    return d.select("path", F.split("error", ":")[0].alias("error"), F.get_json_object("payload", "$.x_docx.document.core_properties.title").alias("title"), F.get_json_object("payload", "$.origin.filename").alias("filename"))


def docx_roles(spark: SparkSession, sf: str) -> DataFrame:
    b = word.blocks(_files(spark)).where("kind = 'paragraph' AND path NOT IN ('inline.docx', 'tables.docx', 'chunks.docx')")
    head = F.col("role").isin("heading", "title")
    return b.select("path", "pos", "role", "level", F.when(head, F.col("source")).alias("source"), F.when(head, F.col("confidence")).alias("confidence"), F.when(F.col("text") == fixtures.LONG, "LONG").otherwise(F.col("text")).alias("text"))


def docx_levels(spark: SparkSession, sf: str) -> DataFrame:
    b = word.blocks(_files(spark)).where("role IN ('list_item', 'toc', 'caption')")
    return b.select("path", "pos", "role", "marker", "toc_level", "toc_page", "target")


def docx_inline(spark: SparkSession, sf: str) -> DataFrame:
    b = word.blocks(_files(spark)).where("path = 'inline.docx'")
    return b.select("pos", "text", "style", "page", "seq", F.array_join("notes", ",").alias("notes"), F.array_join("links", ",").alias("links"), "in_textbox")


def docx_cells(spark: SparkSession, sf: str) -> DataFrame:
    b = word.blocks(_files(spark)).where("kind = 'table' AND path = 'tables.docx'")
    return b.select("pos", "header_source", "nested", F.explode("cells").alias("c")).select("pos", "header_source", "nested", "c.row", "c.col", "c.rows", "c.cols", "c.text", "c.header")


def docx_items(spark: SparkSession, sf: str) -> DataFrame:
    i = word.items(_documents(spark, "headings.docx", "contents.docx", "captions.docx", "lists.docx", "running.docx"))
    return i.select("path", "self_ref", "parent", "label", "layer", F.substring("text", 1, 24).alias("begins"), "level", "marker")


def docx_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return word.as_markdown(_documents(spark, "captions.docx", "lists.docx", "chunks.docx", "tables.docx")).withColumn("markdown", F.replace("markdown", F.lit(fixtures.LONG), F.lit("LONG")))


def docx_sections(spark: SparkSession, sf: str) -> DataFrame:
    c = word.sectioned(_documents(spark, "chunks.docx"), HierarchySettings(max_tokens=120, min_tokens=20, overlap_sentences=1))
    return c.select(F.array_join("heading_path", " > ").alias("heading_path"), "kind", "text", F.array_join("item_refs", ",").alias("refs"), "token_count", F.col("prev").isNull().alias("first"), F.col("next").isNull().alias("last"))


def docx_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c, _ = word.chunked(_documents(spark, "chunks.docx", "tables.docx"), ChunkSettings(chunk_tokens=40, max_seq_length=80, chunk_overlap=6))
    return c.select("doc_id", "section", "block_type", "page", "text", "n_tokens", "n_tokens_indexed")


def docx_parents(spark: SparkSession, sf: str) -> DataFrame:
    _, p = word.chunked(_documents(spark, "chunks.docx", "tables.docx"), ChunkSettings(chunk_tokens=40, max_seq_length=80, parent_tokens=60))
    return p.select("doc_id", "section", "page", "text", "n_tokens")


def _pictures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.PICTURES, "doc_id string, self_ref string, pos int, sha256 string, part string, external boolean, decorative boolean, width int, height int")


def image_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return vision.eligible(_pictures(spark)).select("doc_id", "self_ref", "sha256")


def image_first_uses(spark: SparkSession, sf: str) -> DataFrame:
    return vision.first_uses(vision.eligible(_pictures(spark)), VisionSettings(max_images=2)).select("doc_id", "sha256", "self_ref", "part")


def _described(spark: SparkSession) -> DataFrame:
    def make():
        def call(content: bytes, context: dict) -> str:
            if content == b"bad":
                raise ValueError("no picture")
            return f"{len(content)} bytes of {context['mimetype']}"

        return call

    contents = spark.createDataFrame([("s1", bytearray(b"12345"), "image/png"), ("logo", bytearray(b"bad"), "image/png")], "sha256 string, content binary, mimetype string")
    cache = spark.createDataFrame([("s2|v:m|1", "another image"), ("x", "y")], "key string, value string")
    uses = vision.first_uses(_pictures(spark).where(F.col("sha256").isin("s1", "s2", "s4", "logo")))
    return vision.described(uses, contents, cache, "v:m", make)


def image_described(spark: SparkSession, sf: str) -> DataFrame:
    return _described(spark).select("sha256", "text", "state")


def image_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return vision.statistics(vision.fan_back(_pictures(spark), _described(spark)))


QUERIES = {f.__name__: f for f in (docx_errors, docx_roles, docx_levels, docx_inline, docx_cells, docx_items, docx_markdown, docx_sections, docx_chunks, docx_parents, image_eligible, image_first_uses, image_described, image_statistics)}
