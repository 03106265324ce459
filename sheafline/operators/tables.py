"""Table rows as texts by expressions: one row of the result per data row, no Python.

Equals ``functions.tables.Table.row_texts``; used where only the rows are wanted.
Tables of fewer than two columns, empty rows and rows beyond the types have no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import DATA, GROUP
from ..functions.text import strip

BLANK = r"(?U)^[\s\-—|\x1c-\x1f]*$"


def row_texts(tables: DataFrame, key: list[str]) -> DataFrame:
    """``key``, row_no, text from rows with a struct ``tbl`` (header, rows, types)."""
    none = F.array().cast("array<string>")
    t = tables.select(*key, F.coalesce("tbl.header", none).alias("header"), F.col("tbl.rows").alias("rows"), F.coalesce("tbl.types", none).alias("types"))
    width = F.greatest(F.size("header"), F.array_max(F.transform("rows", lambda r: F.size(F.coalesce(r, none)))))
    rows = t.where(width >= 2).select(*key, "header", "types", F.posexplode("rows").alias("row_no", "cells"))
    kind = F.when(F.size("types") == 0, F.lit(DATA)).otherwise(F.get("types", F.col("row_no")))
    rows = rows.withColumn("kind", kind).where((F.size("types") == 0) | (F.col("row_no") < F.size("types")))
    held = F.filter(F.transform(F.coalesce("cells", none), lambda c, j: F.struct(j.alias("j"), c.alias("c"))), lambda x: x["c"].isNotNull() & ~x["c"].rlike(BLANK))
    rows = rows.withColumn("held", held).where(F.size("held") > 0)
    name = lambda j: F.coalesce(F.nullif(F.get("header", j), F.lit("")), F.concat(F.lit("col"), j.cast("string")))
    said = F.array_join(F.transform("held", lambda x: F.concat(name(x["j"]), F.lit(" : "), strip(x["c"]))), " ; ")
    group = F.coalesce(F.col("kind") == GROUP, F.lit(False))
    first = F.concat(F.lit("["), strip(F.get("held", F.lit(0))["c"]), F.lit("] "))
    w = Window.partitionBy(*key).orderBy("row_no")
    context = F.coalesce(F.last(F.when(group, first), ignorenulls=True).over(w), F.lit(""))
    return rows.select(*key, "row_no", group.alias("is_group"), F.concat(context, said).alias("text")).where(~F.col("is_group")).drop("is_group")
