"""Operators on texts and their paragraphs: counting, repeats, packing, runs, identifiers.

Texts are cut with array expressions inside their row, so nothing is shuffled before
an aggregate needs it.  Null texts have no paragraphs and no counts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def latest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key: the one received last (map-side combined, so a hot key needs no single task)."""
    others = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*newest)).alias("kept"))
    return kept.select(*keys, *(F.col("kept")[c].alias(c) for c in others))


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, pos, para: every non-blank line of every text."""
    return docs.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "para"))


def repeats(paras: DataFrame, least_tokens: int) -> DataFrame:
    """First place and number of copies of each long paragraph within its document."""
    rows = paras.where(T.tokens_words(F.col("para")) >= least_tokens).withColumn("h", T.content_hash(F.col("para")))
    return rows.groupBy("doc_id", "h").agg(F.min("pos").alias("first_pos"), F.count("*").alias("copies"))


def packed(docs: DataFrame, limit: int) -> DataFrame:
    """doc_id, pos, n, grp: whole paragraphs packed in order up to the limit (one fold over the row's sizes)."""
    @F.pandas_udf("array<int>")
    def groups(sizes: pd.Series) -> pd.Series:
        def fold(row) -> list[int]:
            out: list[int] = []
            grp = used = 0
            for n in row:
                if used > 0 and used + n > limit:
                    grp, used = grp + 1, 0
                used += n
                out.append(grp)
            return out

        return sizes.map(fold)

    sized = docs.where(F.col("text").isNotNull()).select("doc_id", F.transform(T.paragraphs(F.col("text")), lambda p: T.tokens_words(p)).alias("n"))
    both = sized.withColumn("grp", groups("n"))
    return both.select("doc_id", F.posexplode(F.arrays_zip("n", "grp")).alias("pos", "g")).select("doc_id", "pos", "g.n", "g.grp")


CONTENTS_LINE = r"(?i)^.*\S\s*(\t+|\.{3,}|…+|[._·]{3,}|\s{3,})[\s._·…]*(\d{1,4}|[ivxlcdm]{1,7})\s*$"


def contents_runs(paras: DataFrame, least: int = 3, longest: int = 250) -> DataFrame:
    """Runs of at least ``least`` consecutive contents lines: doc_id, first_pos, lines (gaps and islands)."""
    hit = (F.length("para") < longest) & F.col("para").rlike(CONTENTS_LINE)
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = paras.select("doc_id", "pos", hit.alias("hit")).withColumn("island", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(w))
    return marked.where("hit").groupBy("doc_id", "island").agg(F.min("pos").alias("first_pos"), F.count("*").alias("lines")).where(F.col("lines") >= least).select("doc_id", "first_pos", "lines")


def occurrence_ids(rows: DataFrame, kind: str, version: str) -> DataFrame:
    """Content-stable ids of (doc_id, section, text) rows; ``place`` orders equal texts of a section."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "section", F.sha2("text", 256)).orderBy("place")) - 1
    return rows.select("place", "doc_id", T.stable_id(F.col("doc_id"), F.lit(kind), F.col("section"), F.col("text"), nth, F.lit(version)).alias("chunk_id"))


def neighbours(chunks: DataFrame) -> DataFrame:
    """chunk_no with the chunks before and after it in its document."""
    w = Window.partitionBy("doc_id").orderBy("order_start", "chunk_no")
    return chunks.select("chunk_no", F.lag("chunk_no").over(w).alias("prev_no"), F.lead("chunk_no").over(w).alias("next_no"))


def shared_beginning(a: Column, b: Column) -> Column:
    """The longest common beginning of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(a, 1, n), lambda x, i: x == F.get(b, i))
    first_other = F.array_position(same, F.lit(False))
    return F.slice(a, 1, F.when(first_other > 0, first_other.cast("int") - 1).otherwise(n))


def quantiles(rows: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles per group from the histogram of values: the element at floor(n * p)."""
    hist = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(group))
    ranked = hist.select(group, F.col(value).alias("v"), upto.alias("upto"), total.alias("total"))
    pick = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p))), F.col("v")))
    return ranked.groupBy(group).agg(F.max("total").alias("n"), *(pick(p).alias(name) for name, p in points.items()), F.max("v").alias("most"))
