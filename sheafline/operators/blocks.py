"""Operators on ordered paragraph blocks, table cells and items.

Order within a document is semantic, so these are windows by document; Spark sorts
and spills a long document's rows, and no document is gathered in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paragraphs import latest

#: Signs that look like white space to a reader (fixed values of the normalisation).
_NBSP, _ZWSP = "\u00a0", "\u200b"

PAGE_LINE = r"(?iu)^(page\s*\d+(\s*(/|sur|of|de|von)\s*\d+)?|\d+\s*(/|sur|of)\s*\d+|[-–—]\s*\d+\s*[-–—])$"
CAPTION_LINE = (
    r"(?iu)^(figure|fig\.?|tableau|table|tab\.|illustration|image|graphique|graphe|sch[ée]ma|photo|diagramme|carte|abbildung|abb\.|tabelle|chart|exhibit|planche)"
    r"\s*(n[°o]\.?\s*)?([\dIVXivx]+([.\-–]\d+)*)\s*([:.\-–—]|$|\s)"
)


def plain_text(col: str = "text"):
    """Paragraph text as read: hard blanks to blanks, zero-width ones gone, runs of blanks and line ends to one."""
    out = F.translate(F.col(col), _NBSP + _ZWSP, " ")
    out = F.regexp_replace(out, "[ \u2002\u2003]+", " ")
    out = F.regexp_replace(out, "\n{2,}", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def paragraphs(blocks: DataFrame) -> DataFrame:
    return latest(blocks, ["doc_id", "blk_order"], ["received_at", "para_no"])


def filled_pages(paras: DataFrame) -> DataFrame:
    """A block without a page takes the page of the block before it."""
    w = Window.partitionBy("doc_id").orderBy("blk_order")
    return paras.select("doc_id", "blk_order", F.last("page_hint", ignorenulls=True).over(w).alias("page"), F.col("page_hint").isNull().alias("carried"))


def sections(paras: DataFrame) -> DataFrame:
    """Section number of each block: a new one begins at each heading."""
    w = Window.partitionBy("doc_id").orderBy("blk_order")
    return paras.select("doc_id", "blk_order", F.sum(F.when(F.col("outline_lvl").isNotNull(), 1).otherwise(0)).over(w).alias("section_no"))


def heading_parents(paras: DataFrame) -> DataFrame:
    """Each block's nearest heading above of a smaller level (any level for other blocks)."""
    before = Window.partitionBy("doc_id").orderBy("blk_order").rowsBetween(Window.unboundedPreceding, -1)
    levels = range(9)
    last = [F.max(F.when(F.col("outline_lvl") == k, F.col("blk_order"))).over(before).alias(f"l{k}") for k in levels]
    rows = paras.select("doc_id", "blk_order", "outline_lvl", *last)
    up = F.greatest(*(F.when(F.coalesce("outline_lvl", F.lit(99)) > k, F.col(f"l{k}")) for k in levels))
    return rows.select("doc_id", "blk_order", up.alias("parent_order"))


def repeated_lines(paras: DataFrame, least: int = 3, longest: int = 100) -> DataFrame:
    """Short lines repeated near page changes: doc_id, line, n, near (running heads)."""
    w = Window.partitionBy("doc_id").orderBy("blk_order")
    changed = F.coalesce(F.col("page_hint") != F.lag("page_hint").over(w), F.lit(False)).cast("int")
    marked = paras.select("doc_id", "blk_order", "text", "page_hint").withColumn("changed", changed)
    near = F.max("changed").over(w.rowsBetween(-2, 2))
    rows = marked.withColumn("near", near).where(F.col("text").isNotNull() & (F.length("text") <= longest))
    line = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    out = rows.groupBy("doc_id", line.alias("line")).agg(F.count("*").alias("n"), F.sum("near").alias("near"))
    return out.where((F.col("line") != "") & (F.col("n") >= least) & (F.col("near") * 2 >= F.col("n")))


def body_size(paras: DataFrame) -> DataFrame:
    """The font size that carries most characters of the longer paragraphs; the first seen on ties."""
    rows = paras.where(F.col("font_size").isNotNull() & (F.length("text") >= 40) & ~F.coalesce("in_table", F.lit(False)))
    per = rows.groupBy("doc_id", "font_size").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.min("blk_order").alias("first"))
    return per.groupBy("doc_id").agg(F.max_by("font_size", F.struct("chars", -F.col("first"))).alias("body_size"), F.max("chars").alias("chars"))


def prominence():
    """Size and boldness as one number; half points are rounded half to even."""
    return F.bround(F.coalesce("font_size", F.lit(0.0)) * 2) / 2 * 10 + F.when(F.col("bold_ratio") >= 0.9, 4.0).otherwise(0.0)


def heading_levels(paras: DataFrame) -> DataFrame:
    """Level of each unlevelled look: the first level whose mean prominence it reaches, else one below all."""
    rows = paras.where(F.col("text").isNotNull()).withColumn("prom", prominence())
    known = rows.where(F.col("outline_lvl").isNotNull()).groupBy("doc_id", (F.col("outline_lvl") + 1).alias("level")).agg(F.avg("prom").alias("mean"))
    looks = rows.where(F.col("outline_lvl").isNull() & (F.col("bold_ratio") >= 0.9)).select("doc_id", "prom").distinct()
    # at most nine levels per document, so each look meets at most nine rows
    met = looks.join(known, "doc_id", "left")
    per = met.groupBy("doc_id", "prom").agg(F.min(F.when(F.col("mean") <= F.col("prom") + 0.25, F.col("level"))).alias("reached"), F.max("level").alias("deepest"))
    return per.select("doc_id", "prom", F.coalesce("reached", F.col("deepest") + 1, F.lit(1)).cast("int").alias("level"))


def shape(paras: DataFrame) -> DataFrame:
    """What a paragraph looks like: could be a heading, is a page line, is a caption."""
    t = plain_text()
    could = (F.length(t) > 1) & (F.length(t) <= 200) & (F.size(F.split(t, r"\s+")) <= 25) & ~t.rlike(r"[.;,!?:]$") & t.rlike(r"\p{L}") & ~t.contains("\n")
    return paras.where(F.col("text").isNotNull()).select("para_no", could.alias("heading_shape"), t.rlike(PAGE_LINE).alias("page_line"), t.rlike(CAPTION_LINE).alias("caption_line"))


def dense_grid(cells: DataFrame) -> DataFrame:
    """Every position of a table: a merged cell stands wherever it reaches, the later cell wins."""
    rows = cells.where(F.col("start_row").isNotNull() & F.col("start_col").isNotNull())
    span = lambda start, n: F.sequence(F.col(start), F.col(start) + F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) - 1)
    down = rows.select("doc_id", "table_ref", "cell_no", "text", "start_col", "col_span", F.explode(span("start_row", "row_span")).alias("r"))
    across = down.select("doc_id", "table_ref", "cell_no", "text", "r", F.explode(span("start_col", "col_span")).alias("c"))
    return across.groupBy("doc_id", "table_ref", "r", "c").agg(F.max_by(F.struct("text"), "cell_no").alias("kept")).select("doc_id", "table_ref", "r", "c", F.col("kept.text").alias("text"))


def markdown_cells(cells: DataFrame) -> DataFrame:
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|"))
    return cells.select("cell_no", F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("<br>")).alias("md"))


def header_rows(cells: DataFrame) -> DataFrame:
    """Leading rows of a table all of whose filled cells are header cells."""
    said = F.coalesce(F.trim("text"), F.lit("")) != ""
    per = cells.where(said & F.col("start_row").isNotNull()).groupBy("doc_id", "table_ref", "start_row").agg(F.every(F.coalesce("column_header", F.lit(False))).alias("head"))
    w = Window.partitionBy("doc_id", "table_ref").orderBy("start_row")
    run = per.withColumn("rank", F.row_number().over(w) - 1).withColumn("broken", F.sum(F.when(F.col("head") & (F.col("rank") == F.col("start_row")), 0).otherwise(1)).over(w))
    return run.groupBy("doc_id", "table_ref").agg(F.count_if(F.col("broken") == 0).alias("header_rows"))


def items(rows: DataFrame) -> DataFrame:
    """Items once each, with their reading order."""
    out = latest(rows.select("doc_id", "self_ref", "parent", "label", "text", "meta", "received_at", "item_no"), ["doc_id", "self_ref"], ["received_at", "item_no"])
    return out.withColumn("pos", F.try_element_at("meta", F.lit("order")).try_cast("int"))


def nearest_targets(its: DataFrame) -> DataFrame:
    """For every caption the table or picture nearest before and after it in reading order."""
    target = F.when(F.col("label").isin("table", "picture", "chart"), F.col("self_ref"))
    w = Window.partitionBy("doc_id").orderBy("pos", "self_ref")
    before = F.last(target, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(target, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = its.where(F.col("pos").isNotNull()).select("doc_id", "self_ref", "label", before.alias("before_ref"), after.alias("after_ref"))
    return rows.where(F.col("label") == "caption").select("doc_id", "self_ref", "before_ref", "after_ref")


def referenced(its: DataFrame) -> DataFrame:
    """Items that are some item's parent (left semi join)."""
    used = its.select("doc_id", F.col("parent").alias("self_ref")).distinct()
    return its.join(used, ["doc_id", "self_ref"], "left_semi").select("doc_id", "self_ref", "label")


def dangling(its: DataFrame) -> DataFrame:
    """Items whose parent doesn't exist (left anti join)."""
    wanted = its.where(F.col("parent").isNotNull() & ~F.col("parent").isin("#/body", "#/furniture"))
    have = its.select("doc_id", F.col("self_ref").alias("parent"))
    return wanted.join(have, ["doc_id", "parent"], "left_anti").select("doc_id", "self_ref", "parent")
