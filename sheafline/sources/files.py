"""File sources other than Word packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.pages import PAGE_SCHEMA


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """pages.jsonl: one page per line under a fixed schema; lines that aren't JSON are dropped.

    ``page_no`` orders a file's pages as they stand in it (JSON lines are read in blocks
    whose order the file offset gives).
    """
    rows = spark.read.schema(PAGE_SCHEMA + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record").withColumn("page_no", F.monotonically_increasing_id())


def structured_documents(spark: SparkSession, path: str) -> DataFrame:
    """rec_id, stem, payload of every ``*.json`` file that is a structured document; other files are passed over."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    rows = files.select(F.input_file_name().alias("path"), F.col("value").alias("payload"))
    named = rows.where(F.get_json_object("payload", "$.schema_name") == "DoclingDocument")
    return named.select(F.xxhash64("path").alias("rec_id"), F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("stem"), "payload")


def describer_cache(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a cache of JSON lines; the last line of a key wins."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    parsed = files.select("path", "pos", F.from_json("line", "key string, value string").alias("j")).where(F.col("j.key").isNotNull())
    return parsed.groupBy(F.col("j.key").alias("key")).agg(F.max_by(F.struct(F.col("j.value").alias("value")), F.struct("path", "pos")).alias("kept")).select("key", F.col("kept.value").alias("value"))


def last_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by an order."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
