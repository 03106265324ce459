"""Child chunks linked to bounded parents.

Every entry point (page records, structured documents, Word packages) turns its
documents into *emissions*: rows in reading order, each a parent or a child of one.
What holds across a document - repeated passages, content-stable identifiers,
parents without children - is then relational: aggregates and windows on (document,
text), so a large document spreads over tasks by its texts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkSettings
from ..functions import text as T
from ..functions.splitting import Counter, child_limit, fixed, recursive, with_overlap
from ..functions.tables import Table
from ..shared import Scratch

#: One row per parent (kind p, t, f) or child (kind c); ``parent`` is the parent's ``seq``.
EMISSION = (
    "doc_id string, doc_order long, seq long, kind string, parent long, section string, block_type string, text string, n_tokens int, page int, "
    "page_approx boolean, pages array<int>, source string, is_figure boolean, table_rows array<int>, para_keys array<string>, para_sections array<array<string>>"
)
OTHER_SECTIONS = 20


def emission_frame(rows: list[tuple]):
    """Emissions as a pandas frame with nullable numbers."""
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in EMISSION.split(", ")])
    for c in ("parent", "page"):
        frame[c] = frame[c].astype("Int64")
    return frame


#: Emissions gathered before a frame is handed back to Spark.
FRAME_ROWS = 5_000


class Emitter:
    """Collects the emissions of one unit (a page or a document)."""

    def __init__(self, settings: ChunkSettings, count: Counter, doc_id: str, order: int, source: str) -> None:
        self.s, self.count, self.doc_id, self.order, self.source = settings, count, doc_id, order, source
        self.rows: list[tuple] = []

    def parent(self, kind: str, section: str, text: str, page, approx: bool, pages=None, table_rows=None) -> int:
        seq = len(self.rows)
        pages = pages if pages is not None else [] if page is None else [page]
        self.rows.append((self.doc_id, self.order, seq, kind, None, section, None, text, self.count(text), page, approx, pages, self.source, False, table_rows, None, None))
        return seq

    def child(self, parent: int, section: str, block_type: str, text: str, page, approx: bool, figure: bool = False, paras=()) -> None:
        text = text.strip()
        if text:
            keyed = [p for p in paras if p.get("key")]
            self.rows.append((self.doc_id, self.order, len(self.rows), "c", parent, section, block_type, text, self.count(text), page, approx, None, self.source, figure, None, [p["key"] for p in keyed], [p["others"] for p in keyed]))

    def limit(self, section: str) -> int:
        return child_limit(self.s.chunk_tokens, self.s.max_seq_length, self.s.context_prefix, self.doc_id, section, self.count)

    def table(self, table: Table, caption: str, section: str, page, approx: bool) -> bool:
        """Windows as parents, rows as children; False if the table has no usable rows."""
        lines = table.row_texts() if self.s.rows_as_chunks else []
        if not lines:
            return False
        title = " > ".join(x for x in (section, caption) if x)
        limit = self.limit(title)
        for start, end, text in table.windows(caption, self.s.parent_limit, self.count):
            parent = self.parent("t", title, text, page, approx, table_rows=[start, end])
            for i, line in lines:
                if start <= i < end:
                    for piece in [line] if self.count(line) <= limit else recursive(line, limit, self.count):
                        self.child(parent, title, "table", piece, page, approx)
        return True

    def pieces(self, text: str, limit: int) -> list[str]:
        if self.s.strategy == "fixed":
            found = fixed(text, max(1, min(self.s.chunk_tokens, limit)))
        else:
            found = recursive(text, limit, self.count)
        return with_overlap(found, self.s.chunk_overlap, self.count, limit)


def link(emissions: DataFrame, settings: ChunkSettings) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents) from emissions: repeats dropped, identifiers made, childless parents pruned.

    The emissions are written once, so the splitting in Python runs once for both results.
    """
    emissions = Scratch(emissions.sparkSession, "linked").keep(emissions, "emissions")
    version = F.lit(settings.ingest_version)
    at = F.struct("doc_order", "seq")
    texts = emissions.where(F.col("kind") == "c").withColumn("norm", F.when(F.lit(settings.dedup) & (F.col("block_type") != "table") & (F.col("n_tokens") >= settings.dedup_min_tokens), F.sha2(T.normalized(F.col("text")), 256)))

    repeated = texts.where(F.col("norm").isNotNull()).groupBy("doc_id", "norm", "section").agg(F.min(at).alias("at"), F.count("*").alias("n"))
    per_text = repeated.groupBy("doc_id", "norm").agg(F.sum("n").alias("n"), F.min("at").alias("first")).where(F.col("n") > 1)
    # the first section is the kept chunk's own; of the others only so many leave the sort
    nth_section = F.row_number().over(Window.partitionBy("doc_id", "norm").orderBy("at"))
    listed = repeated.withColumn("nth", nth_section).where(F.col("nth") <= OTHER_SECTIONS + 1).where(F.col("nth") > 1)
    listed = listed.groupBy("doc_id", "norm").agg(F.array_sort(F.collect_list(F.struct("at", "section"))).alias("seen"))
    per_text = per_text.join(listed, ["doc_id", "norm"], "left").select("doc_id", "norm", "first", F.transform("seen", lambda x: x["section"]).alias("repeat_sections"))
    marked = texts.join(per_text, ["doc_id", "norm"], "left")
    kept = marked.where(F.col("first").isNull() | (F.col("first") == at))

    nth = F.row_number().over(Window.partitionBy("doc_id", "section", F.sha2("text", 256)).orderBy("doc_order", "seq")) - 1
    owners = emissions.where(F.col("kind") != "c")
    nth_parent = F.row_number().over(Window.partitionBy("doc_id", "kind", "section", F.sha2("text", 256)).orderBy("doc_order", "seq")) - 1
    named = owners.withColumn("parent_id", F.concat_ws("_", "kind", T.stable_id(F.col("doc_id"), F.col("kind"), F.col("section"), F.col("text"), nth_parent, version)))

    head = T.prefix(F.col("doc_id"), F.col("section"), F.col("page"), F.col("page_approx"))
    indexed = F.concat_ws("\n", head, "text") if settings.context_prefix else F.col("text")
    given = F.array_distinct(F.flatten(F.coalesce("para_sections", F.array().cast("array<array<string>>"))))
    all_others = F.array_distinct(F.concat(F.coalesce("repeat_sections", F.array().cast("array<string>")), given))
    chunks = kept.join(named.select("doc_id", "doc_order", F.col("seq").alias("parent"), "parent_id"), ["doc_id", "doc_order", "parent"]).select(
        T.stable_id(F.col("doc_id"), F.lit("c"), F.col("section"), F.col("text"), nth, version).alias("chunk_id"),
        "parent_id",
        "doc_id",
        "page",
        "page_approx",
        "section",
        "block_type",
        "source",
        "text",
        indexed.alias("text_indexed"),
        "n_tokens",
        count_tokens(indexed, settings.counter).alias("n_tokens_indexed"),
        F.col("is_figure").alias("est_figure"),
        version.alias("ingest_version"),
        F.when(F.size(all_others) > 0, all_others).alias("autres_sections"),
        "doc_order",
        "seq",
    )
    parents = named.join(chunks.select("parent_id").distinct(), "parent_id", "left_semi").select(
        "parent_id", "doc_id", "page", "page_approx", "pages", "section", "text", "n_tokens", F.col("table_rows").alias("lignes_tableau"), "doc_order", "seq"
    )
    return chunks, parents


def count_tokens(text, name: str):
    """Tokens of a column: an expression for the estimates, an Arrow function for tokenizer files."""
    if name == "words":
        return T.tokens_words(text)
    if name == "chars":
        return T.tokens_chars(text)
    import pandas as pd

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        from ..functions.splitting import counter

        return texts.map(counter(name)).astype("int32")

    return counted(text)


def diagnostics(chunks: DataFrame, parents: DataFrame, settings: ChunkSettings) -> DataFrame:
    """One row of counts and nearest-rank quantiles of what is encoded."""
    over = F.col("n_tokens_indexed") + (T.RESERVED_TOKENS - 1) > settings.max_seq_length
    # quantiles by rank over the histogram of token counts, so no list of all rows is built
    hist = chunks.groupBy("n_tokens_indexed").agg(F.count("*").alias("n"))
    w = Window.orderBy("n_tokens_indexed")
    ranked = hist.select(F.col("n_tokens_indexed").alias("v"), F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    q = [F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p))), F.col("v"))).alias(name) for name, p in (("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))]
    base = chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if(over).alias("over_limit"),
        F.count_if((F.col("block_type") == "text") & (F.col("n_tokens") < 20)).alias("small_texts"),
        F.count_if(F.col("block_type") == "text").alias("texts"),
        F.count_if(F.col("block_type") == "table").alias("tables"),
        F.count_if(F.col("block_type") == "figure").alias("figures"),
        F.count_if(F.col("page").isNull()).alias("pages_unknown"),
        F.count_if(F.col("page_approx")).alias("pages_estimated"),
        F.max("n_tokens_indexed").alias("longest"),
    )
    # three one-row results side by side
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(base).join(one(ranked.agg(*q)), "k").join(one(parents.agg(F.count("*").alias("parents"), F.max("n_tokens").alias("longest_parent"))), "k").drop("k")
