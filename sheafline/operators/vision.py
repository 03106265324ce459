"""Optional descriptions of pictures: one call per distinct image, cached, joined back.

Pictures are rows (doc_id, self_ref, pos, sha256, part, external, decorative, width,
height); a describer is any callable from image bytes and a context to text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import VisionSettings

Describer = Callable[[bytes, dict], str]
#: Part of every cache key; raise it when the prompt changes.
PROMPT_VERSION = "1"

_registry: dict[str, Callable[[str], Describer]] = {}


def register(provider: str, make: Callable[[str], Describer]) -> None:
    _registry[provider] = make


def describer(name: str) -> Describer:
    """``provider:model``; an unknown provider is a KeyError."""
    provider, _, model = name.partition(":")
    return _registry[provider](model)


def occurrences(pictures: DataFrame) -> DataFrame:
    """doc_id, sha256, n: at how many places of a document each image is used; redelivered rows are one place."""
    return pictures.where(F.col("sha256").isNotNull()).groupBy("doc_id", "sha256").agg(F.count_distinct(F.struct("self_ref", "pos")).alias("n"))


def eligible(pictures: DataFrame, settings: VisionSettings = VisionSettings()) -> DataFrame:
    """Pictures worth describing: inside the package, not decoration, not tiny, not repeated in its document like a logo."""
    area = F.col("width") * F.col("height")
    fits = F.col("sha256").isNotNull() & F.col("part").isNotNull() & ~F.coalesce("external", F.lit(False)) & (area.isNull() | (area >= settings.min_pixels))
    if settings.skip_decorative:
        fits &= ~F.coalesce("decorative", F.lit(False))
    rare = occurrences(pictures).where(F.col("n") < settings.skip_repeated_min).select(F.col("doc_id").alias("rare_doc"), F.col("sha256").alias("rare_sha"))
    return pictures.where(fits).join(rare, F.col("doc_id").eqNullSafe(F.col("rare_doc")) & (F.col("sha256") == F.col("rare_sha")), "left_semi")


def first_uses(pictures: DataFrame, settings: VisionSettings = VisionSettings()) -> DataFrame:
    """One row per document and image, its first use, for the first ``max_images`` images of a document."""
    uses = pictures.groupBy("doc_id", "sha256").agg(F.min_by(F.struct("self_ref", "pos", "part"), "pos").alias("first"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("first.pos"))
    return uses.withColumn("nth", nth).where(F.col("nth") <= settings.max_images).select("doc_id", "sha256", "first.*")


def cache_key(sha256: Column, name: str) -> Column:
    return F.concat_ws("|", sha256, F.lit(name), F.lit(PROMPT_VERSION))


def described(uses: DataFrame, contents: DataFrame, cache: DataFrame, name: str, make: Callable[[], Describer], settings: VisionSettings = VisionSettings()) -> DataFrame:
    """sha256, text, state (cached, described, skipped or error), error.

    Images in the cache aren't called for (anti join); the rest go to the describer
    with bounded concurrency per task, and a failing call is that image's error only.
    """
    keyed = uses.select("sha256").distinct().withColumn("key", cache_key(F.col("sha256"), name))
    known = keyed.join(cache, "key").select("sha256", F.col("value").alias("text"), F.lit("cached").alias("state"), F.lit(None).cast("string").alias("error"))
    todo = keyed.join(cache, "key", "left_anti").join(contents.select("sha256", "content", "mimetype"), "sha256", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()

        def one(row) -> tuple:
            if row.content is None:
                return row.sha256, None, "skipped", "part is missing"
            try:
                return row.sha256, call(bytes(row.content), {"mimetype": row.mimetype, "language": settings.language}), "described", None
            except Exception as e:
                return row.sha256, None, "error", f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(settings.concurrency) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch.itertuples(index=False))), columns=["sha256", "text", "state", "error"])

    return known.unionByName(todo.mapInPandas(run, "sha256 string, text string, state string, error string"))


def fan_back(pictures: DataFrame, results: DataFrame) -> DataFrame:
    """Every picture with the description of its image."""
    return pictures.join(results.select("sha256", "text", "state"), "sha256", "left")


def statistics(pictures: DataFrame) -> DataFrame:
    """doc_id, described, cached, skipped, errors: pictures by what became of their image; those not asked for count as skipped."""
    counts = [F.count_if(F.col("state") == state).alias(name) for state, name in (("described", "described"), ("cached", "cached"), ("error", "errors"))]
    return pictures.groupBy("doc_id").agg(*counts, F.count_if(F.col("state").isNull() | (F.col("state") == "skipped")).alias("skipped"))


def append_cache(results: DataFrame, name: str, path: str) -> None:
    """Appends newly described images to a cache that ``sources.files.describer_cache`` reads; the last entry of a key counts."""
    rows = results.where(F.col("state") == "described").select(cache_key(F.col("sha256"), name).alias("key"), F.col("text").alias("value"))
    rows.write.mode("append").json(path)


def neighbour_text(blocks: DataFrame) -> DataFrame:
    """For each picture block the text of its paragraph, else the last before, else the first after."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    said = F.when(F.length(F.trim("text")) > 0, F.col("text"))
    before = F.last(said, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(said, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return blocks.withColumn("near", F.coalesce(said, before, after)).where("is_picture").select("doc_id", "pos", "near")
