"""Sinks: chunk and parent tables, JSON lines, structured documents, exported images."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, small

CHUNK_FIELDS = ["chunk_id", "parent_id", "doc_id", "page", "page_approx", "section", "block_type", "source", "text", "text_indexed", "n_tokens", "n_tokens_indexed", "est_figure", "ingest_version", "autres_sections"]
PARENT_FIELDS = ["parent_id", "doc_id", "page", "page_approx", "pages", "section", "text", "n_tokens", "lignes_tableau"]


def write_tables(chunks: DataFrame, parents: DataFrame, path: str, form: str = "json") -> None:
    """chunks and parents below ``path``, as JSON lines (absent values kept as null) or Parquet.

    Both come from one written set of emissions if the caller kept them; the order of
    emission is kept inside a document by sorting each output partition.
    """
    for name, df, fields in (("chunks", chunks, CHUNK_FIELDS), ("parents", parents, PARENT_FIELDS)):
        out = df.repartition("doc_id").sortWithinPartitions("doc_id", "doc_order", "seq").select(*fields)
        writer = out.write.mode("overwrite")
        writer.option("ignoreNullFields", "false").json(f"{path}/{name}") if form == "json" else writer.parquet(f"{path}/{name}")


def write_documents(docs: DataFrame, path: str) -> None:
    """One JSON document per line; the file a document came from is in its ``origin``."""
    docs.where(F.col("payload").isNotNull()).select("payload").write.mode("overwrite").text(path)


#: Lists of image parts up to this long are broadcast to the second reading, longer ones are joined by shuffle.
LISTED_PARTS = 500_000


def exported_images(files: DataFrame) -> DataFrame:
    """sha256, name, mimetype, content of every distinct image of the packages: ``{sha256[:20]}.{extension}``, once per hash.

    The packages (path, content) are read twice: hashes decide first which part of which package
    stands for an image, so bytes are read for these only and not grouped.
    """

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = [(path, part, kind, hashlib.sha256(data).hexdigest()) for part, kind, data in _images(content)]
                yield pd.DataFrame(rows, columns=["path", "part", "mimetype", "sha256"])

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, wanted in zip(batch["content"], batch["wanted"]):
                held = {part: data for part, _, data in _images(content)}
                for w in wanted:
                    yield pd.DataFrame([(w["sha256"], w["name"], w["mimetype"], held[w["part"]])], columns=["sha256", "name", "mimetype", "content"])

    found = files.select("path", "content").mapInPandas(parts, "path string, part string, mimetype string, sha256 string")
    ending = F.regexp_extract("part", r"\.([A-Za-z0-9]+)$", 1)
    named = found.withColumn("name", F.concat(F.substring("sha256", 1, 20), F.lit("."), F.when(ending != "", ending).otherwise("bin")))
    first = named.groupBy("sha256").agg(F.min(F.struct("path", "part", "name", "mimetype")).alias("f")).select("f.path", F.struct("sha256", "f.part", "f.name", "f.mimetype").alias("w"))
    # a package holds few images, so its list is short
    wanted = Scratch(files.sparkSession, "images").keep(first.groupBy("path").agg(F.collect_list("w").alias("wanted")), "wanted")
    return files.select("path", "content").join(small(wanted, LISTED_PARTS), "path").select("content", "wanted").mapInPandas(contents, "sha256 string, name string, mimetype string, content binary")


def _images(content: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(part, type, bytes) of the images in a package; none of a broken one."""
    from ..sources.package import Package, PackageError

    try:
        package = Package(content)
        for part in sorted(package.names):
            kind = package.content_type(part)
            if kind.startswith("image/"):
                yield part, kind, package.read(part)
    except PackageError:
        return


def write_images(files: DataFrame, folder: str) -> None:
    """Every distinct image as a file of its name below ``folder``, a path that the executors see."""

    def write(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, r.name), "wb") as f:
                f.write(r.content)

    exported_images(files).foreachPartition(write)


def data_uri(mimetype, content):
    """Content as a data URI."""
    return F.concat(F.lit("data:"), mimetype, F.lit(";base64,"), F.base64(content))
