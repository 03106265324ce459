"""Shared folder for written intermediate tables.

Iterative operators cut their lineage by writing a table below the folder named
in ``spark.checkpoint.dir`` (all executors see it, so a lost executor costs
nothing) and reading it back.  Only where the setting is absent - local tests -
a folder of our own is created and removed at exit.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sheafline-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


class Scratch:
    """Tables of one query run.  ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/sheafline-{name}-{uuid.uuid4().hex}"
        self.step = 0
        atexit.register(_remove, spark, self.base)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return a reader of the written table."""
        self.step += 1
        path = f"{self.base}/{self.step:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sheafline_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_sheafline_path", None)
        if path:
            _remove(self.spark, path)

    def free(self) -> None:
        """Let Spark remove the shuffle files of finished steps now; else they stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has been counted and found within the bound, else as it is.

    ``df`` should be a written table of a few narrow columns, so that counting reads
    only metadata and the bound in rows bounds the bytes.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most_rows else df


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Number of partitions for an explicit repartition: the session's shuffle setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
