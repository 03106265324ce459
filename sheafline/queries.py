"""Driver queries of the core, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_expected, word_queries
from .config import ChunkSettings
from .functions import text as T
from .operators import blocks, hierarchy, linked, pages, paragraphs, shred, structured, tables, word


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.endless(_table(spark, sf, "items")).select(F.col("grp").alias("doc_id"), F.col("node").alias("self_ref"))


def p1_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    r = hierarchy.resolve(_table(spark, sf, "items"))
    return r.select(F.col("grp").alias("doc_id"), F.col("node").alias("self_ref"), F.col("root").alias("root_ref"), "depth", F.array_join("path", "|").alias("path"), (F.col("state") == hierarchy.CYCLE).alias("endless"))


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    d = hierarchy.descendants(hierarchy.resolve(_table(spark, sf, "items")))
    return d.select(F.col("grp").alias("doc_id"), "ancestor", "descendant", "distance")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return shred.parts(_table(spark, sf, "docling_records"))


def p5_cells(spark: SparkSession, sf: str) -> DataFrame:
    return shred.document_tables(_table(spark, sf, "docling_records"))[0]


def p5_images(spark: SparkSession, sf: str) -> DataFrame:
    return shred.document_tables(_table(spark, sf, "docling_records"))[1]


def p5_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return shred.document_tables(_table(spark, sf, "docling_records"))[2]


# ---------------------------------------------------------------- texts


def t_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", T.tokens_words(F.col("text")).alias("by_words"), T.tokens_chars(F.col("text")).alias("by_chars"))


def t_norm_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", T.content_hash(F.col("text")).alias("h"))


def t_sentences(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def s17_binary_hash(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").where(F.col("text").isNotNull())
    h = F.sha2("text", 256)
    return d.select("doc_id", h.alias("sha256"), F.conv(F.substring(h, 1, 16), 16, 10).alias("binary_hash"))


def x_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs.exploded(_table(spark, sf, "documents"))
    return p.select("doc_id", "pos", "para", F.length("para").alias("n"))


def x10_plain_text(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "para_blocks").where(F.col("text").isNotNull()).select("para_no", blocks.plain_text().alias("plain"))


def para_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.repeats(paragraphs.exploded(_table(spark, sf, "documents")), 25)


def h09_identical(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "hchunks").where(F.col("text").isNotNull())
    return c.groupBy("doc_id", T.content_hash(F.col("text")).alias("h")).agg(F.min("chunk_no").alias("first_no"), F.count("*").alias("copies"))


def greedy_pack(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.packed(_table(spark, sf, "documents"), 64)


def c03_contents_runs(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.contents_runs(paragraphs.exploded(_table(spark, sf, "documents")))


def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = pages.usable(_table(spark, sf, "page_records")).where(F.col("text") != "")
    return paragraphs.occurrence_ids(p.select(F.col("page_no").alias("place"), "doc_id", F.coalesce(F.try_element_at("headings", F.lit(1))["text"], F.lit("")).alias("section"), "text"), "p", "1")


def t11_prefix(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "page_records").where(F.col("doc_id").isNotNull())
    return p.select("page_no", T.prefix(F.col("doc_id"), F.try_element_at("headings", F.lit(1))["text"], F.col("page"), F.coalesce(F.col("est_figure"), F.lit(False))).alias("prefix"))


def h11_prev_next(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.neighbours(_table(spark, sf, "hchunks"))


def h12_ranges(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "hchunks")
    return c.groupBy("doc_id").agg(F.min("order_start").alias("order_start"), F.max("order_end").alias("order_end"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.count_distinct("kind").alias("kinds"))


def common_prefix(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("order_start", "chunk_no")
    c = _table(spark, sf, "hchunks").select("chunk_no", "heading_path", F.lead("heading_path").over(w).alias("after"))
    both = c.where(F.col("after").isNotNull() & F.col("heading_path").isNotNull())
    return both.select("chunk_no", F.array_join(paragraphs.shared_beginning(F.col("heading_path"), F.col("after")), " > ").alias("shared"))


def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs.quantiles(_table(spark, sf, "hchunks"), "kind", "token_count", {"median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99})


# ---------------------------------------------------------------- blocks, cells, items


def _paras(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.paragraphs(_table(spark, sf, "para_blocks"))


def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.filled_pages(_paras(spark, sf))


def h04_sections(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.sections(_paras(spark, sf))


def a01_heading_parent(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.heading_parents(_paras(spark, sf))


def c07_repeated_lines(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.repeated_lines(_paras(spark, sf))


def c12_body_size(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.body_size(_paras(spark, sf))


def c14_shape(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.shape(_table(spark, sf, "para_blocks"))


def c18_levels(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.heading_levels(_paras(spark, sf))


def a13_roles(spark: SparkSession, sf: str) -> DataFrame:
    p = _paras(spark, sf)
    return p.groupBy("doc_id", F.coalesce("para_role", F.lit("")).alias("role")).agg(F.count("*").alias("n"))


def a14_extent(spark: SparkSession, sf: str) -> DataFrame:
    p = _paras(spark, sf)
    return p.groupBy("doc_id").agg(F.coalesce(F.max("page_hint"), F.lit(1)).alias("pages"), F.count("*").alias("blocks"))


def k04_dense_grid(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.dense_grid(_table(spark, sf, "cell_data"))


def k07_markdown_cells(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.markdown_cells(_table(spark, sf, "cell_data"))


def x19_header_rows(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.header_rows(_table(spark, sf, "cell_data"))


def c10_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.nearest_targets(blocks.items(_table(spark, sf, "items")))


def referenced_items(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.referenced(blocks.items(_table(spark, sf, "items")))


def a11_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.dangling(blocks.items(_table(spark, sf, "items")))


# ---------------------------------------------------------------- pages and structured documents


def usable_pages(spark: SparkSession, sf: str) -> DataFrame:
    p = pages.usable(_table(spark, sf, "page_records"))
    return p.select("page_no", "doc_id", "page", "source", F.length("text").alias("chars"))


def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_sections(pages.usable(_table(spark, sf, "page_records"))).select("page_no", "section_no", "section", "body")


def asof_title(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_tables(_table(spark, sf, "page_records")).select("page_no", "table_no", "title")


SETTINGS = ChunkSettings(chunk_tokens=64, max_seq_length=128, chunk_overlap=0)


def c_page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return pages.build(_table(spark, sf, "page_records"), SETTINGS)[0]


def c_page_parents(spark: SparkSession, sf: str) -> DataFrame:
    return pages.build(_table(spark, sf, "page_records"), SETTINGS)[1]


def b_document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return structured.build(_table(spark, sf, "docling_records"), SETTINGS)[0]


def b_document_parents(spark: SparkSession, sf: str) -> DataFrame:
    return structured.build(_table(spark, sf, "docling_records"), SETTINGS)[1]


def diagnostic(spark: SparkSession, sf: str) -> DataFrame:
    return linked.diagnostics(*pages.build(_table(spark, sf, "page_records"), SETTINGS), SETTINGS)


def i03_image_uses(spark: SparkSession, sf: str) -> DataFrame:
    images = shred.document_tables(_table(spark, sf, "docling_records"))[1]
    return images.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.count("*").alias("n"), F.min("rec_id").alias("first_rec"))


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "page_records").select("page_no", F.posexplode("tables").alias("table_no", "tbl"))
    return tables.row_texts(p, ["page_no", "table_no"])


def t09_fixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", T.split_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(64))
    return d.select("doc_id", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, 64), " "))).alias("window_no", "text"))


def a03_captions(spark: SparkSession, sf: str) -> DataFrame:
    i = blocks.items(_table(spark, sf, "items"))
    target = i.where(F.col("label").isin("table", "picture", "chart")).select("doc_id", F.col("self_ref").alias("parent"), F.col("label").alias("target_label"))
    return i.where(F.col("label") == "caption").join(target, ["doc_id", "parent"]).select("doc_id", "self_ref", F.col("parent").alias("target_ref"), "target_label")


def a10_furniture(spark: SparkSession, sf: str) -> DataFrame:
    i = blocks.items(_table(spark, sf, "items")).where(F.col("label").isin("page_header", "page_footer") & F.col("text").isNotNull())
    return i.select("doc_id", "self_ref", F.when(F.col("text").rlike(r"\d"), "page_footer").otherwise("page_header").alias("by_text"))


def h08_hash_state(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "hchunks").where(F.col("text").isNotNull())
    state = F.when(F.col("content_hash").isNull(), "missing").when(F.col("content_hash") == T.content_hash(F.col("text")), "right").otherwise("other")
    return c.groupBy("kind", state.alias("state")).agg(F.count("*").alias("n"))


def a_sectioned_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return word.sectioned(_table(spark, sf, "docling_records"))


def k05_markdown(spark: SparkSession, sf: str) -> DataFrame:
    r = _table(spark, sf, "docling_records")
    return word.as_markdown(r.select(F.col("rec_id").cast("string").alias("path"), "payload")).where(F.col("markdown").isNotNull())


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_hierarchy, p1_descendants, p5_found, p5_cells, p5_images, p5_metadata,
        t_tokens, t_norm_hash, t_sentences, s17_binary_hash, x_paragraphs, x10_plain_text, para_dedup, h09_identical, greedy_pack, c03_contents_runs, stable_ids, t11_prefix, h11_prev_next, h12_ranges, common_prefix, quantiles,
        forward_fill, h04_sections, a01_heading_parent, c07_repeated_lines, c12_body_size, c14_shape, c18_levels, a13_roles, a14_extent, k04_dense_grid, k07_markdown_cells, x19_header_rows, c10_nearest, referenced_items, a11_dangling,
        usable_pages, page_sections, asof_title, c_page_chunks, c_page_parents, b_document_chunks, b_document_parents, diagnostic, i03_image_uses, a_sectioned_chunks, k05_markdown, table_rows, t09_fixed_windows, a03_captions, a10_furniture, h08_hash_state,
    )
} | word_queries.QUERIES

_TREE = """
WITH RECURSIVE node AS (
  SELECT doc_id, self_ref, arg_max(struct_pack(p := parent), struct_pack(r := received_at, n := item_no)).p AS parent
  FROM items WHERE doc_id IS NOT NULL AND self_ref IS NOT NULL GROUP BY doc_id, self_ref),
top AS (
  SELECT n.doc_id, n.self_ref FROM node n LEFT JOIN node p ON p.doc_id = n.doc_id AND p.self_ref = n.parent
  WHERE p.self_ref IS NULL OR n.parent IN ('#/body', '#/furniture')),
down AS (
  SELECT doc_id, self_ref, self_ref AS root_ref, CAST(0 AS BIGINT) AS depth, self_ref AS path FROM top
  UNION ALL
  SELECT n.doc_id, n.self_ref, d.root_ref, d.depth + 1, d.path || '|' || n.self_ref
  FROM down d JOIN node n ON n.doc_id = d.doc_id AND n.parent = d.self_ref
  WHERE n.parent NOT IN ('#/body', '#/furniture'))
"""

_W = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = f"^{_W}+|{_W}+$"


def _norm(text: str) -> str:
    return f"lower(trim(regexp_replace({text}, '{_W}+', ' ', 'g')))"


def _word_tokens(text: str) -> str:
    return f"CAST(trunc(len(list_filter(string_split_regex({text}, '{_W}+'), lambda w: w <> '')) * 1.3::DOUBLE) AS INTEGER)"


_LINES = f"""lines AS (
  SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '{_STRIP}', '', 'g')), lambda p: p <> '')) AS para,
         generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '{_STRIP}', '', 'g')), lambda p: p <> ''), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL)"""

_PARAS = "p AS (SELECT * FROM para_blocks QUALIFY row_number() OVER (PARTITION BY doc_id, blk_order ORDER BY received_at DESC NULLS LAST, para_no DESC) = 1)"
_ITEMS = """i AS (SELECT doc_id, self_ref, parent, label, text, TRY_CAST(meta['order'] AS INTEGER) AS pos FROM items
  QUALIFY row_number() OVER (PARTITION BY doc_id, self_ref ORDER BY received_at DESC NULLS LAST, item_no DESC) = 1)"""
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(replace(translate(text, chr(160), ' '), chr(8203), ''), '[ \\x{2002}\\x{2003}]+', ' ', 'g'), '\\n{2,}', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_USABLE = """u AS (SELECT page_no, coalesce(doc_id, 'unknown') AS doc_id, coalesce(page, 0) AS page, coalesce(source, 'native') AS source, coalesce(text, '') AS text, headings
  FROM page_records WHERE coalesce(etat, '') <> 'error')"""

_PARTS = r"""
WITH RECURSIVE node AS MATERIALIZED (
  SELECT rec_id, j.id, j.parent AS up, j.key, j.type, CASE WHEN j.type = 'OBJECT' THEN json_extract_string(j.value, '$.self_ref') END AS ref, CASE WHEN j.type = 'OBJECT' THEN json_extract_string(j.value, '$.sha256') END AS sha,
         j.type = 'OBJECT' AND coalesce(json_type(j.value, '$.self_ref') = 'VARCHAR' AND json_extract_string(j.value, '$.self_ref') <> '', false) AS item
  FROM (SELECT rec_id, CASE WHEN json_valid(payload) THEN payload ELSE 'null' END AS payload FROM docling_records) d, json_tree(d.payload) j),
full_ AS (
  SELECT rec_id, up AS id FROM node WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL')
  UNION SELECT n.rec_id, n.up FROM full_ f JOIN node n ON n.rec_id = f.rec_id AND n.id = f.id),
obj AS (SELECT n.* FROM node n JOIN full_ f ON f.rec_id = n.rec_id AND f.id = n.id WHERE n.type = 'OBJECT'),
item AS (SELECT rec_id, id, ref FROM node WHERE item AND ref <> '#/body'),
holder AS (
  SELECT rec_id, id, ref FROM item
  UNION ALL SELECT o.rec_id, o.id, i.ref FROM obj o JOIN item i ON i.rec_id = o.rec_id AND o.up = i.id WHERE NOT o.item AND o.key <> 'meta'),
cell AS (
  SELECT h.rec_id, h.ref, CAST(o.key AS INTEGER) AS pos FROM obj o JOIN node a ON a.rec_id = o.rec_id AND a.id = o.up AND a.type = 'ARRAY' AND a.key IN ('cells', 'table_cells')
  JOIN holder h ON h.rec_id = a.rec_id AND h.id = a.up WHERE NOT o.item),
side AS (
  SELECT e.rec_id, e.id, e.key AS ref FROM obj e JOIN node m ON m.rec_id = e.rec_id AND m.id = e.up AND m.key = 'items' JOIN node x ON x.rec_id = m.rec_id AND x.id = m.up AND x.key = 'x_docx'
  JOIN node t ON t.rec_id = x.rec_id AND t.id = x.up AND t.up IS NULL WHERE (e.rec_id, e.key) IN (SELECT (rec_id, ref) FROM item)),
meta AS (
  SELECT o.rec_id, o.id, i.ref FROM obj o JOIN item i ON i.rec_id = o.rec_id AND o.up = i.id WHERE o.key = 'meta' AND NOT o.item
  UNION ALL SELECT * FROM side),
below AS (
  SELECT rec_id, id, ref FROM meta
  UNION SELECT n.rec_id, n.id, b.ref FROM below b JOIN node n ON n.rec_id = b.rec_id AND n.up = b.id WHERE n.type IN ('OBJECT', 'ARRAY') AND NOT n.item),
image AS (
  SELECT o.rec_id, h.ref, o.sha FROM obj o JOIN (SELECT * FROM item UNION ALL SELECT * FROM below) h ON h.rec_id = o.rec_id AND h.id = o.up WHERE o.key = 'image' AND NOT o.item)
"""

SQL = {
    "p1_found": _TREE + "SELECT n.doc_id, n.self_ref FROM node n LEFT JOIN down d USING (doc_id, self_ref) WHERE d.self_ref IS NULL",
    "p1_hierarchy": _TREE + "SELECT n.doc_id, n.self_ref, d.root_ref, d.depth, d.path, d.self_ref IS NULL AS endless FROM node n LEFT JOIN down d USING (doc_id, self_ref)",
    "p1_descendants": _TREE
    + """, pair AS (
  SELECT doc_id, parent AS ancestor, self_ref AS descendant, CAST(1 AS BIGINT) AS distance FROM node
  WHERE parent NOT IN ('#/body', '#/furniture') AND (doc_id, self_ref) IN (SELECT (doc_id, self_ref) FROM down) AND (doc_id, parent) IN (SELECT (doc_id, self_ref) FROM node)
  UNION ALL
  SELECT p.doc_id, n.parent, p.descendant, p.distance + 1 FROM pair p JOIN node n ON n.doc_id = p.doc_id AND n.self_ref = p.ancestor
  WHERE n.parent NOT IN ('#/body', '#/furniture') AND (n.doc_id, n.parent) IN (SELECT (doc_id, self_ref) FROM node))
SELECT doc_id, ancestor, descendant, distance FROM pair""",
    "p5_found": _PARTS
    + """SELECT rec_id, ref AS self_ref, 'cell' AS part_kind, pos FROM cell
UNION SELECT rec_id, ref, 'image', 0 FROM image
UNION SELECT rec_id, ref, 'meta', 0 FROM meta""",
    "i03_image_uses": _PARTS + "SELECT sha AS sha256, count(*) AS n, min(rec_id) AS first_rec FROM image WHERE sha IS NOT NULL GROUP BY sha",
    "t_tokens": f"SELECT doc_id, {_word_tokens('text')} AS by_words, CAST(greatest(1, (length(text) + 3) // 4) AS INTEGER) AS by_chars FROM documents WHERE text IS NOT NULL",
    "t_norm_hash": f"SELECT doc_id, sha256({_norm('text')}) AS h FROM documents WHERE text IS NOT NULL",
    "t_sentences": rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:]){_W}+([A-ZÀ-ÖØ-Þ0-9«"“(])', '\1' || chr(2) || '\2', 'g'), chr(2)),
  lambda x: regexp_replace(x, '{_STRIP}', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS sentence FROM s""",
    "s17_binary_hash": "SELECT doc_id, sha256(text) AS sha256, CAST(CAST('0x' || left(sha256(text), 16) AS UBIGINT) AS VARCHAR) AS binary_hash FROM documents WHERE text IS NOT NULL",
    "x_paragraphs": f"WITH {_LINES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, para, CAST(length(para) AS INTEGER) AS n FROM lines",
    "x10_plain_text": f"SELECT para_no, {_PLAIN} AS plain FROM para_blocks WHERE text IS NOT NULL",
    "para_dedup": f"WITH {_LINES} SELECT doc_id, sha256({_norm('para')}) AS h, CAST(min(pos) AS INTEGER) AS first_pos, count(*) AS copies FROM lines WHERE {_word_tokens('para')} >= 25 GROUP BY ALL",
    "h09_identical": f"SELECT doc_id, sha256({_norm('text')}) AS h, min(chunk_no) AS first_no, count(*) AS copies FROM hchunks WHERE text IS NOT NULL GROUP BY ALL",
    "greedy_pack": f"""
WITH RECURSIVE {_LINES}, sized AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_word_tokens('para')} AS n FROM lines),
fold AS (
  SELECT doc_id, pos, n, 0 AS grp, n AS used FROM sized WHERE pos = 0
  UNION ALL
  SELECT s.doc_id, s.pos, s.n, CASE WHEN f.used > 0 AND f.used + s.n > 64 THEN f.grp + 1 ELSE f.grp END, CASE WHEN f.used > 0 AND f.used + s.n > 64 THEN s.n ELSE f.used + s.n END
  FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1)
SELECT doc_id, pos, n, grp FROM fold""",
    "c03_contents_runs": rf"""
WITH {_LINES}, hit AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, length(para) < 250 AND regexp_matches(para, '^.*\S\s*(\t+|\.{{3,}}|…+|[._·]{{3,}}|\s{{3,}})[\s._·…]*(\d{{1,4}}|[ivxlcdm]{{1,7}})\s*$', 'i') AS hit FROM lines),
island AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM hit)
SELECT doc_id, min(pos) AS first_pos, count(*) AS lines FROM island WHERE hit GROUP BY doc_id, island HAVING count(*) >= 3""",
    "stable_ids": f"""
WITH {_USABLE}, r AS (SELECT page_no AS place, doc_id, coalesce(headings[1].text, '') AS section, text FROM u WHERE text <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section, text ORDER BY place) - 1 AS nth FROM r)
SELECT place, doc_id, left(sha256(doc_id || ':p:' || section || ':' || sha256(text) || ':' || nth || ':1'), 16) AS chunk_id FROM n""",
    "t11_prefix": f"""
WITH r AS (SELECT page_no, doc_id, page, coalesce(est_figure, false) AS approx, regexp_replace(coalesce(headings[1].text, ''), '{_STRIP}', '', 'g') AS s FROM page_records WHERE doc_id IS NOT NULL)
SELECT page_no, concat_ws(' — ', upper(doc_id), CASE WHEN s = '' THEN NULL WHEN length(s) <= 80 THEN s ELSE '…' || right(s, 79) END,
  CASE WHEN page IS NOT NULL THEN CASE WHEN approx THEN 'page ~' ELSE 'page ' END || (page + 1) END) AS prefix FROM r""",
    "h11_prev_next": "SELECT chunk_no, lag(chunk_no) OVER w AS prev_no, lead(chunk_no) OVER w AS next_no FROM hchunks WINDOW w AS (PARTITION BY doc_id ORDER BY order_start NULLS FIRST, chunk_no)",
    "h12_ranges": "SELECT doc_id, min(order_start) AS order_start, max(order_end) AS order_end, min(page_start) AS page_start, max(page_end) AS page_end, count(DISTINCT kind) AS kinds FROM hchunks GROUP BY doc_id",
    "common_prefix": """
WITH n AS (SELECT chunk_no, heading_path AS a, lead(heading_path) OVER (PARTITION BY doc_id ORDER BY order_start NULLS FIRST, chunk_no) AS b FROM hchunks)
SELECT chunk_no, array_to_string(a[1 : len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i]))], ' > ') AS shared FROM n WHERE a IS NOT NULL AND b IS NOT NULL""",
    "quantiles": """
WITH l AS (SELECT kind, list_sort(list(token_count)) AS v FROM hchunks WHERE token_count IS NOT NULL GROUP BY kind)
SELECT kind, CAST(len(v) AS BIGINT) AS n, v[least(len(v) - 1, CAST(floor(len(v) * 0.5) AS BIGINT)) + 1] AS median, v[least(len(v) - 1, CAST(floor(len(v) * 0.75) AS BIGINT)) + 1] AS p75,
  v[least(len(v) - 1, CAST(floor(len(v) * 0.95) AS BIGINT)) + 1] AS p95, v[least(len(v) - 1, CAST(floor(len(v) * 0.99) AS BIGINT)) + 1] AS p99, v[len(v)] AS most FROM l""",
    "forward_fill": f"WITH {_PARAS} SELECT doc_id, blk_order, last_value(page_hint IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY blk_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page, page_hint IS NULL AS carried FROM p",
    "h04_sections": f"WITH {_PARAS} SELECT doc_id, blk_order, CAST(sum(CASE WHEN outline_lvl IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY blk_order) AS BIGINT) AS section_no FROM p",
    "a01_heading_parent": f"""
WITH {_PARAS} SELECT x.doc_id, x.blk_order, max(y.blk_order) AS parent_order FROM p x LEFT JOIN p y
  ON y.doc_id = x.doc_id AND y.blk_order < x.blk_order AND y.outline_lvl BETWEEN 0 AND 8 AND y.outline_lvl < coalesce(x.outline_lvl, 99) GROUP BY x.doc_id, x.blk_order""",
    "c07_repeated_lines": f"""
WITH {_PARAS}, m AS (SELECT *, CASE WHEN page_hint <> lag(page_hint) OVER (PARTITION BY doc_id ORDER BY blk_order) THEN 1 ELSE 0 END AS changed FROM p),
f AS (SELECT *, max(changed) OVER (PARTITION BY doc_id ORDER BY blk_order ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM m),
g AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS line, count(*) AS n, CAST(sum(near) AS BIGINT) AS near FROM f WHERE text IS NOT NULL AND length(text) <= 100 GROUP BY ALL)
SELECT doc_id, line, n, near FROM g WHERE line <> '' AND n >= 3 AND near * 2 >= n""",
    "c12_body_size": f"""
WITH {_PARAS}, s AS (SELECT doc_id, font_size, CAST(sum(length(text)) AS BIGINT) AS chars, min(blk_order) AS first FROM p WHERE font_size IS NOT NULL AND length(text) >= 40 AND NOT coalesce(in_table, false) GROUP BY ALL)
SELECT doc_id, font_size AS body_size, chars FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, first) = 1""",
    "c14_shape": rf"""
WITH t AS (SELECT para_no, {_PLAIN} AS t FROM para_blocks WHERE text IS NOT NULL)
SELECT para_no, length(t) > 1 AND length(t) <= 200 AND len(string_split_regex(t, '\s+')) <= 25 AND NOT regexp_matches(t, '[.;,!?:]$') AND regexp_matches(t, '\p{{L}}') AND NOT contains(t, chr(10)) AS heading_shape,
  regexp_matches(t, '^(page\s*\d+(\s*(/|sur|of|de|von)\s*\d+)?|\d+\s*(/|sur|of)\s*\d+|[-–—]\s*\d+\s*[-–—])$', 'i') AS page_line,
  regexp_matches(t, '^(figure|fig\.?|tableau|table|tab\.|illustration|image|graphique|graphe|sch[ée]ma|photo|diagramme|carte|abbildung|abb\.|tabelle|chart|exhibit|planche)\s*(n[°o]\.?\s*)?([\dIVXivx]+([.\-–]\d+)*)\s*([:.\-–—]|$|\s)', 'i') AS caption_line
FROM t""",
    "c18_levels": f"""
WITH {_PARAS}, r AS (SELECT *, round_even(coalesce(font_size, 0) * 2, 0) / 2 * 10 + CASE WHEN bold_ratio >= 0.9 THEN 4.0::DOUBLE ELSE 0 END AS prom FROM p WHERE text IS NOT NULL),
k AS (SELECT doc_id, outline_lvl + 1 AS level, avg(prom) AS mean FROM r WHERE outline_lvl IS NOT NULL GROUP BY ALL),
l AS (SELECT DISTINCT doc_id, prom FROM r WHERE outline_lvl IS NULL AND bold_ratio >= 0.9)
SELECT l.doc_id, l.prom, CAST(coalesce(min(CASE WHEN k.mean <= l.prom + 0.25 THEN k.level END), max(k.level) + 1, 1) AS INTEGER) AS level FROM l LEFT JOIN k ON k.doc_id = l.doc_id GROUP BY l.doc_id, l.prom""",
    "a13_roles": f"WITH {_PARAS} SELECT doc_id, coalesce(para_role, '') AS role, count(*) AS n FROM p GROUP BY ALL",
    "a14_extent": f"WITH {_PARAS} SELECT doc_id, coalesce(max(page_hint), 1) AS pages, count(*) AS blocks FROM p GROUP BY ALL",
    "k04_dense_grid": """
WITH s AS (SELECT doc_id, table_ref, cell_no, text, unnest(range(start_row, start_row + greatest(coalesce(row_span, 1), 1))) AS r, start_col, col_span FROM cell_data WHERE start_row IS NOT NULL AND start_col IS NOT NULL),
x AS (SELECT doc_id, table_ref, cell_no, text, CAST(r AS INTEGER) AS r, unnest(range(start_col, start_col + greatest(coalesce(col_span, 1), 1))) AS c FROM s)
SELECT doc_id, table_ref, r, CAST(c AS INTEGER) AS c, text FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, table_ref, r, c ORDER BY cell_no DESC) = 1""",
    "k07_markdown_cells": "SELECT cell_no, replace(replace(replace(coalesce(text, ''), '|', '\\|'), chr(13), ''), chr(10), '<br>') AS md FROM cell_data",
    "x19_header_rows": """
WITH p AS (SELECT doc_id, table_ref, start_row, bool_and(coalesce(column_header, false)) AS head FROM cell_data WHERE coalesce(trim(text), '') <> '' AND start_row IS NOT NULL GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_ref ORDER BY start_row) - 1 AS rank FROM p),
b AS (SELECT *, sum(CASE WHEN head AND rank = start_row THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, table_ref ORDER BY start_row) AS broken FROM q)
SELECT doc_id, table_ref, count(*) FILTER (broken = 0) AS header_rows FROM b GROUP BY ALL""",
    "c10_nearest": f"""
WITH {_ITEMS}, t AS (SELECT doc_id, self_ref, label,
  last_value(CASE WHEN label IN ('table', 'picture', 'chart') THEN self_ref END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, self_ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ref,
  first_value(CASE WHEN label IN ('table', 'picture', 'chart') THEN self_ref END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos, self_ref ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_ref FROM i WHERE pos IS NOT NULL)
SELECT doc_id, self_ref, before_ref, after_ref FROM t WHERE label = 'caption'""",
    "referenced_items": f"WITH {_ITEMS} SELECT doc_id, self_ref, label FROM i WHERE EXISTS (SELECT 1 FROM i j WHERE j.doc_id = i.doc_id AND j.parent = i.self_ref)",
    "a11_dangling": f"WITH {_ITEMS} SELECT doc_id, self_ref, parent FROM i WHERE parent IS NOT NULL AND parent NOT IN ('#/body', '#/furniture') AND NOT EXISTS (SELECT 1 FROM i j WHERE j.doc_id = i.doc_id AND j.self_ref = i.parent)",
    "usable_pages": f"WITH {_USABLE} SELECT page_no, doc_id, page, source, CAST(length(text) AS INTEGER) AS chars FROM u",
    "asof_title": """
WITH t AS (SELECT page_no, headings, unnest(tables) AS tbl, generate_subscripts(tables, 1) - 1 AS table_no FROM page_records WHERE tables IS NOT NULL),
h AS (SELECT page_no, table_no, tbl.bbox[2] AS y, unnest(headings) AS h, generate_subscripts(headings, 1) AS pos FROM t WHERE headings IS NOT NULL),
b AS (SELECT page_no, table_no, trim(h.text) AS title FROM h WHERE h.bbox[2] < y QUALIFY row_number() OVER (PARTITION BY page_no, table_no ORDER BY h.bbox[2] DESC, pos) = 1)
SELECT t.page_no, CAST(t.table_no AS INTEGER) AS table_no, coalesce(b.title, '') AS title FROM t LEFT JOIN b ON b.page_no = t.page_no AND b.table_no = t.table_no""",
    "table_rows": rf"""
WITH t AS (SELECT page_no, unnest(tables) AS t, generate_subscripts(tables, 1) - 1 AS table_no FROM page_records WHERE tables IS NOT NULL),
w AS (SELECT page_no, table_no, coalesce(t.header, []) AS header, coalesce(t.types, []) AS types, t.rows AS rs FROM t
  WHERE greatest(len(coalesce(t.header, [])), list_max(list_transform(t.rows, lambda r: len(coalesce(r, []))))) >= 2),
r AS (SELECT page_no, table_no, header, types, unnest(rs) AS cells, generate_subscripts(rs, 1) AS k FROM w),
h AS (SELECT page_no, table_no, k - 1 AS row_no, CASE WHEN len(types) = 0 THEN 'donnee' ELSE types[k] END AS kind, header,
  list_filter(list_transform(range(1, len(coalesce(cells, [])) + 1), lambda j: struct_pack(j := j, c := cells[j])), lambda x: x.c IS NOT NULL AND NOT regexp_full_match(x.c, '([\-—|]|{_W})*')) AS held
  FROM r WHERE len(types) = 0 OR k <= len(types)),
s AS (SELECT page_no, table_no, row_no, kind, '[' || regexp_replace(held[1].c, '{_STRIP}', '', 'g') || '] ' AS first,
  array_to_string(list_transform(held, lambda x: coalesce(nullif(header[x.j], ''), 'col' || (x.j - 1)) || ' : ' || regexp_replace(x.c, '{_STRIP}', '', 'g')), ' ; ') AS said FROM h WHERE len(held) > 0),
c AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'intercalaire' THEN first END IGNORE NULLS) OVER (PARTITION BY page_no, table_no ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS context FROM s)
SELECT page_no, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, context || said AS text FROM c WHERE kind IS NULL OR kind <> 'intercalaire'""",
    "t09_fixed_windows": f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{_W}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, w, unnest(range(0, len(w), 64)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(i // 64 AS INTEGER) AS window_no, array_to_string(w[i + 1 : i + 64], ' ') AS text FROM i""",
    "a03_captions": f"WITH {_ITEMS} SELECT c.doc_id, c.self_ref, c.parent AS target_ref, t.label AS target_label FROM i c JOIN i t ON t.doc_id = c.doc_id AND t.self_ref = c.parent WHERE c.label = 'caption' AND t.label IN ('table', 'picture', 'chart')",
    "a10_furniture": f"WITH {_ITEMS} SELECT doc_id, self_ref, CASE WHEN regexp_matches(text, '[0-9]') THEN 'page_footer' ELSE 'page_header' END AS by_text FROM i WHERE label IN ('page_header', 'page_footer') AND text IS NOT NULL",
    "h08_hash_state": f"""
SELECT kind, CASE WHEN content_hash IS NULL THEN 'missing' WHEN content_hash = sha256({_norm('text')}) THEN 'right' ELSE 'other' END AS state, count(*) AS n
FROM hchunks WHERE text IS NOT NULL GROUP BY ALL""",
} | word_expected.SQL
