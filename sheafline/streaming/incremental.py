"""Incremental chunking: new page records re-chunk only the documents they belong to.

Content-stable identifiers keep unchanged chunks' names, so an index can be updated by
difference.  State is three Parquet tables, pages, parents and chunks, partitioned by a
bucket of the document: a micro-batch rewrites only the buckets it meets.  A batch that
is replayed after a failure gives the same tables, since the latest record of a page
counts whenever it came.  Only where document and page are known is a later record a
redelivery of that page; other records are pages of their own, told apart by page_no,
as in the batch entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ChunkSettings
from ..operators import pages as P
from ..operators.paragraphs import latest
from ..plans.sinks import CHUNK_FIELDS, PARENT_FIELDS
from ..shared import Scratch

#: Buckets of the tables where the caller names no number; a store keeps its number for ever.
BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(like.schema).parquet(path)
    return like.limit(0)


def _own_key():
    """Null for a known page of a known document, else the record's number."""
    return F.when((F.col("doc_id") == "unknown") | F.col("page").isNull(), F.col("page_no"))


def upsert(batch: DataFrame, base: str, settings: ChunkSettings, buckets: int = BUCKETS) -> None:
    """Merge a batch of page records (PAGE_SCHEMA, page_no, received_at) into the tables below ``base``.

    ``buckets`` bounds what a batch rewrites: the tables' size over it is what one changed
    document costs, so it should grow with the store.  Pages are written last: a batch that
    ended early is replayed against the pages it has not changed yet.
    """
    spark = batch.sparkSession
    scratch = Scratch(spark, "incremental")
    new = batch.withColumn("doc_id", F.coalesce("doc_id", F.lit("unknown"))).withColumn("bucket", _bucket(buckets))
    new = scratch.keep(new, "new")
    touched = new.select("bucket").distinct()
    old = _stored(spark, f"{base}/pages", new).join(F.broadcast(touched), "bucket", "left_semi")  # at most BUCKETS rows
    records = old.unionByName(new.select(*old.columns))
    merged = scratch.keep(latest(records.withColumn("own_key", _own_key()), ["doc_id", "page", "own_key"], ["received_at", "page_no"]).select(*new.columns), "pages")
    changed = new.select("doc_id").distinct()
    chunks, parents = P.build(merged.join(changed, "doc_id", "left_semi").drop("bucket"), settings)
    whole = []
    for name, df, fields in (("parents", parents, PARENT_FIELDS), ("chunks", chunks, CHUNK_FIELDS)):
        fresh = df.select(*fields).withColumn("bucket", _bucket(buckets))
        kept = _stored(spark, f"{base}/{name}", fresh).join(F.broadcast(touched), "bucket", "left_semi").join(changed, "doc_id", "left_anti")
        whole.append((name, scratch.keep(kept.select(*fresh.columns).unionByName(fresh), name)))
    for name, df in [*whole, ("pages", merged)]:
        df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{base}/{name}")


def start(spark: SparkSession, folder: str, base: str, checkpoint: str, settings: ChunkSettings, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Stream of JSON lines files in ``folder`` (pages with page_no and received_at)."""
    source = spark.readStream.schema(P.PAGE_SCHEMA + ", page_no long, received_at timestamp").json(folder)
    writer = source.writeStream.foreachBatch(lambda df, _: upsert(df, base, settings, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
