"""Registered queries on outlines, footnotes, recognised pages, annotations, cards, jobs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import annotations as an
from quire.operators import footnotes as fo
from quire.operators import jobs as jo
from quire.operators import pages as pa
from quire.operators import research as re_
from quire.operators import search as se
from quire.operators import structure as st
from quire.plans import adapters as ad
from quire.shared import written
from quire.plans.queries import BLOCKS, DOCS, NODES, SQUEEZE, query
from quire.sources import reports, workspace


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _text(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# outlines


def _legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of which four of six begin as headings do."""
    k, t = F.col("reading_order") % 6, F.col("text")
    return ad.blocks(spark, sf_dir).withColumn("text", F.when(k == 0, F.concat(F.lit("第一章 "), t)).when(k == 1, F.concat(F.lit("一、"), t)).when(k == 2, F.concat(F.lit("（二）"), t)).when(k == 3, F.concat(F.lit("1.2 "), t)).otherwise(F.col("text")))


LEGAL = f"{BLOCKS}, legal AS (SELECT doc_id, block_id, page, reading_order, block_type, CASE reading_order % 6 WHEN 0 THEN '第一章 ' || text WHEN 1 THEN '一、' || text WHEN 2 THEN '（二）' || text WHEN 3 THEN '1.2 ' || text ELSE text END AS text FROM blocks)"
LEVEL = r"CASE WHEN t LIKE '第一章%' OR t LIKE '一、%' THEN 1 WHEN t LIKE '（二）%' THEN 2 WHEN regexp_matches(t, '^\d+\.\d+\.\d+') THEN 3 WHEN regexp_matches(t, '^\d+\.\d+') THEN 2 ELSE 1 END"
SEMANTIC = rf"""{LEGAL}, hd AS (SELECT *, {SQUEEZE} AS t FROM legal), sem AS (SELECT doc_id, block_id, page, text AS title, {LEVEL} AS level, row_number() OVER (PARTITION BY doc_id ORDER BY page, reading_order) AS ord FROM hd
  WHERE length(t) BETWEEN 2 AND 80 AND NOT regexp_matches(t, '[;；]$') AND (t LIKE '第一章%' OR t LIKE '一、%' OR t LIKE '（二）%' OR regexp_matches(t, '^\d+(\.\d+){{0,3}}[、.．\s]')))"""


@query(f"WITH {SEMANTIC} SELECT doc_id, 'outline-semantic-' || ord AS outline_id, title, level, page, block_id, CAST(0.9 AS DOUBLE) AS confidence FROM sem WHERE ord <= 160")
def semantic_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.semantic_outline(_legal(spark, sf_dir)).select("doc_id", "outline_id", "title", "level", "page", "block_id", "confidence")


@query(f"""WITH {SEMANTIC}, own AS (SELECT doc_id, 'outline-semantic-' || ord AS outline_id, title, level, page FROM sem WHERE ord <= 160 AND doc_id % 3 = 0), nat AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) AS ord FROM blocks WHERE block_type = 'heading' AND doc_id NOT IN (SELECT doc_id FROM own))
FROM own UNION ALL SELECT doc_id, 'outline-native-' || ord, text, greatest(1, least(4, reading_order % 7)), page FROM nat WHERE ord <= 300""")
def choose_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    native = ad.blocks(spark, sf_dir).where("block_type = 'heading'").select("doc_id", F.col("text").alias("title"), (F.col("reading_order") % 7).alias("level"), "page", F.col("reading_order").alias("ord"))
    return st.choose_outline(st.semantic_outline(_legal(spark, sf_dir)).where("doc_id % 3 = 0"), native).select("doc_id", "outline_id", "title", "level", "page")


@query(f"WITH {SEMANTIC} SELECT l.doc_id, l.block_id, CASE WHEN s.block_id IS NOT NULL THEN 'heading' ELSE l.block_type END AS block_type FROM legal l LEFT JOIN (SELECT DISTINCT doc_id, block_id FROM sem WHERE ord <= 160) s USING (doc_id, block_id)")
def mark_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _legal(spark, sf_dir)
    return st.mark_headings(b, st.semantic_outline(b)).select("doc_id", "block_id", "block_type")


@query(f"""WITH {BLOCKS}, r AS (SELECT *, reading_order % 9 <> 3 AS known FROM blocks), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, reading_order) AS n FROM r WHERE known)
SELECT doc_id, 'outline-ai-' || n AS outline_id, left(CASE WHEN reading_order % 2 = 0 THEN {SQUEEZE} ELSE 'M' || reading_order END, 180) AS title, CAST(CASE WHEN reading_order % 6 = 0 THEN 1 ELSE least(4, reading_order % 6) END AS INTEGER) AS level, block_id, CAST(CASE WHEN reading_order % 10 = 0 THEN 0.72 ELSE least(0.98, greatest(0.45, (reading_order % 10) / 10.0)) END AS DOUBLE) AS confidence FROM p WHERE n <= 160""")
def merge_model_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = ad.blocks(spark, sf_dir), F.col("reading_order")
    r = b.select("doc_id", (-k).alias("ord"), F.when(k % 9 == 3, "nowhere").otherwise(F.col("block_id")).alias("block_id"), F.when(k % 2 == 1, F.concat(F.lit("M"), _text(k))).alias("title"), (k % 6).alias("level"), ((k % 10) / 10).alias("confidence"))
    again = r.withColumn("ord", F.lit(1 << 30)).withColumn("title", F.lit("again"))
    return st.merge_model_outline(r.unionByName(again), b).select("doc_id", "outline_id", "title", "level", "block_id", "confidence")


IDX = "ix AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, reading_order, block_id) - 1 AS idx FROM blocks)"


@query(f"WITH {BLOCKS}, {IDX} SELECT doc_id, block_id, CASE WHEN idx % 4 = 2 THEN ['heading', 'paragraph', 'paragraph'][idx % 3 + 1] ELSE block_type END AS block_type, CASE WHEN idx % 4 = 2 THEN left('X ' || regexp_replace(text, '\\s+$', ''), 6000) ELSE text END AS text, idx % 4 = 2 AS format_corrected FROM ix WHERE idx % 4 <> 0")
def apply_format_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ad.blocks(spark, sf_dir)
    i = F.col("idx")
    r = st.indexed_blocks(b).where(i % 2 == 0).select("doc_id", i.alias("block_index"), _pick(["heading", "paragraph", "weird"], i).alias("block_type"), F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("X "), "text")).alias("text"))
    return st.apply_format_corrections(b, r).select("doc_id", "block_id", "block_type", "text", "format_corrected")


@query(f"""WITH {BLOCKS}, r AS (SELECT doc_id, reading_order AS ord, CASE WHEN doc_id % 2 = 0 THEN left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 200) ELSE '' END AS title, greatest(1, least(4, reading_order % 8)) AS level, page FROM blocks), d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title, page ORDER BY ord) AS rn FROM r WHERE title <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM d WHERE rn = 1)
SELECT doc_id, 'fmt-h' || n AS outline_id, title, CAST(level AS INTEGER) AS level, page FROM n WHERE n <= 160 UNION ALL SELECT doc_id, 'o' || block_id, text, 1, page FROM blocks WHERE length(text) <= 60 AND doc_id NOT IN (SELECT doc_id FROM n)""")
def format_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of odd ids have blank titles only."""
    r = ad.blocks(spark, sf_dir).select("doc_id", F.col("reading_order").alias("ord"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "text")).otherwise("  ").alias("title"), (F.col("reading_order") % 8).alias("level"), "page")
    return st.format_outline(r, ad.outline(spark, sf_dir)).select("doc_id", "outline_id", "title", "level", "page")


@query(f"""WITH {BLOCKS}, r AS (SELECT doc_id, reading_order, page, block_id, CASE WHEN reading_order % 5 = 4 THEN '未命名目录' ELSE ' T' || reading_order END AS title FROM blocks), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order DESC) AS n FROM r)
SELECT doc_id, CASE WHEN reading_order % 4 = 0 THEN 'mine' ELSE 'outline-user-' || n END AS outline_id, title, CAST(CASE WHEN reading_order % 7 = 0 THEN 1 ELSE least(4, reading_order % 7) END AS INTEGER) AS level, page, block_id FROM n WHERE n <= 300""")
def sanitize_user_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("reading_order")
    r = ad.blocks(spark, sf_dir).select("doc_id", (-k).alias("ord"), F.when(k % 10 == 9, "").when(k % 10 != 4, F.concat(F.lit(" T"), _text(k))).alias("title"), (k % 7).alias("level"), "page", "block_id", F.when(k % 4 == 0, "mine").when(k % 4 == 1, "").alias("outline_id"))
    return st.sanitize_user_outline(r).select("doc_id", "outline_id", "title", "level", "page", "block_id")


@query("WITH e AS (SELECT user_id AS doc_id, event_type AS type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS n FROM events) SELECT doc_id, type, ts AS edited_at FROM e WHERE n <= 20")
def log_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("type"), F.col("ts").alias("edited_at"), "event_id")
    return st.log_edits(e.where("event_id % 3 = 0").drop("event_id"), e.where("event_id % 3 > 0").drop("event_id"), 20)


@query(rf"""WITH {LEGAL}, s AS (SELECT *, {SQUEEZE} AS t FROM legal), x AS (SELECT doc_id, block_id, CASE WHEN block_type = 'heading' OR (t LIKE '一、%' AND length(t) <= 64) THEN t ELSE nullif(regexp_extract(t, '^(一、[^。！？；\s]{{2,40}})\s', 1), '') END AS title, CASE WHEN t LIKE '一、%' THEN 2 ELSE {LEVEL} END AS level FROM s) SELECT * FROM x WHERE title IS NOT NULL""")
def reader_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.reader_outline(_legal(spark, sf_dir)).select("doc_id", "block_id", "title", "level")


@query(f"WITH {BLOCKS}, {IDX} SELECT doc_id, block_id, CASE WHEN idx // 8 % 5 <> 4 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE '' END AS part FROM ix")
def attach_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ad.blocks(spark, sf_dir)
    answers = st.pair_batches(b).where("batch % 5 <> 4").select("doc_id", "batch", F.col("prompt").alias("raw"))
    return st.attach_batches(b, answers).select("doc_id", "block_id", "part")


# footnotes


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other block as a footnote of one of twenty markers; four on a page."""
    b = ad.blocks(spark, sf_dir).where("reading_order % 2 = 1")
    return b.withColumn("text", F.concat(_text(F.expr("page % 5 * 4 + reading_order % 8 div 2 + 1")), F.lit(" 《"), "text", F.lit("》，法律出版社"))).withColumn("footnote_marker", F.lit(None).cast("string"))


NOTES = f"{BLOCKS}, notes AS (SELECT doc_id, block_id, page, reading_order, CAST(page % 5 * 4 + reading_order % 8 // 2 + 1 AS VARCHAR) AS marker, (page % 5 * 4 + reading_order % 8 // 2 + 1) || ' 《' || text || '》，法律出版社' AS text FROM blocks WHERE reading_order % 2 = 1)"


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda m: F.struct(m.alias("marker"), F.substring("text", 1, 10).alias("quote"), F.lit(0).alias("start_offset"), F.lit(1).alias("end_offset"))
    return ad.blocks(spark, sf_dir).where("reading_order % 2 = 0").withColumn("footnote_refs", F.array(ref(_text(F.col("page") % 7 + 1)), ref(F.lit("2"))))


LINKED = f"""{NOTES}, refs AS (SELECT doc_id, block_id, page, unnest([0, 1]) AS pos, unnest([CAST(page % 7 + 1 AS VARCHAR), '2']) AS marker FROM blocks WHERE reading_order % 2 = 0),
linked AS (SELECT r.doc_id, r.block_id, r.page, r.pos, r.marker, arg_min(n.block_id, abs(n.page - r.page) * 1000000 + n.page) AS target FROM refs r LEFT JOIN notes n ON n.doc_id = r.doc_id AND n.marker = r.marker GROUP BY ALL)"""


@query(f"WITH {LINKED} SELECT doc_id, block_id, CAST(pos AS INTEGER) AS pos, marker, target AS target_footnote_id FROM linked")
def link_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.link_footnotes(_body(spark, sf_dir), _notes(spark, sf_dir)).select("doc_id", "block_id", "pos", "marker", "target_footnote_id")


@query(f"WITH {LINKED} SELECT n.doc_id, n.block_id, count(l.pos) AS n_references, coalesce(min(l.page), -1) AS first_page FROM notes n LEFT JOIN linked l ON l.doc_id = n.doc_id AND l.target = n.block_id GROUP BY ALL")
def reverse_footnote_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _notes(spark, sf_dir)
    r = fo.reverse_footnote_refs(fo.link_footnotes(_body(spark, sf_dir), n), n)
    size = F.coalesce(F.size("footnote_references"), F.lit(0))
    return r.select("doc_id", "block_id", F.greatest(size, F.lit(0)).cast("long").alias("n_references"), F.coalesce(F.get("footnote_references", F.lit(0))["page"], F.lit(-1)).alias("first_page"))


def _with_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, some of which are page furniture or read as footnotes."""
    k = F.col("reading_order")
    b = ad.blocks(spark, sf_dir).withColumn("block_type", F.when(k % 13 == 4, "header").otherwise(F.col("block_type")))
    return b.withColumn("text", F.when(k % 11 == 5, F.concat(F.lit("see CNKI.net "), "text")).when(k % 8 == 7, F.concat(F.lit("3 《"), "text", F.lit("》，法律出版社"))).otherwise(F.col("text")))


READABLE = f"""{BLOCKS}, art AS (SELECT doc_id, block_id, page, reading_order, CASE WHEN reading_order % 13 = 4 THEN 'header' ELSE block_type END AS block_type, reading_order % 11 = 5 AS printed, reading_order % 11 <> 5 AND reading_order % 8 = 7 AS note,
  CASE WHEN reading_order % 11 = 5 THEN 'see CNKI.net ' || text WHEN reading_order % 8 = 7 THEN '3 《' || text || '》，法律出版社' ELSE text END AS text FROM blocks), readable AS (SELECT * FROM art WHERE block_type <> 'header' AND NOT printed)"""


@query(f"WITH {READABLE} SELECT doc_id, block_id, CASE WHEN note THEN 'note' ELSE 'body' END AS part FROM readable")
def split_body_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, notes = fo.split_body_notes(_with_artifacts(spark, sf_dir))
    return body.select("doc_id", "block_id", F.lit("body").alias("part")).unionByName(notes.select("doc_id", "block_id", F.lit("note").alias("part")))


@query(f"WITH {READABLE} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS character_count FROM readable GROUP BY doc_id")
def reading_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.reading_text_stats(*fo.split_body_notes(_with_artifacts(spark, sf_dir)))


@query(f"""WITH {NOTES}, cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY reading_order) AS rn FROM notes), kept AS (SELECT * FROM cand WHERE reading_order % 4 = 1)
SELECT c.doc_id, 'recovered-footnote-' || c.block_id AS block_id, c.page, trim(regexp_replace(c.text, '\\s+', ' ', 'g')) AS text, c.marker AS footnote_marker FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = c.doc_id AND contains(regexp_replace(k.text, '\\s', '', 'g'), regexp_replace(c.text, '\\s', '', 'g')))
AND NOT EXISTS (SELECT 1 FROM cand e WHERE e.doc_id = c.doc_id AND e.reading_order < c.reading_order AND contains(regexp_replace(e.text, '\\s', '', 'g'), regexp_replace(c.text, '\\s', '', 'g')))""")
def recover_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _notes(spark, sf_dir)
    outline = n.select("doc_id", F.lit(None).cast("string").alias("outline_id"), F.col("text").alias("title"), "page", "block_id", F.col("reading_order").alias("ord"))
    return fo.recover_footnotes(outline, n.where("reading_order % 4 = 1")).select("doc_id", "block_id", "page", "text", "footnote_marker")


# recognised pages


def _ocr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What a recognition service returns for each page, and the pages."""
    b = ad.blocks(spark, sf_dir)
    k = F.row_number().over(_page_order()) - 1
    ref = F.struct(F.lit("(3)").alias("marker"), F.substring("text", 2, 4).alias("quote"), F.lit(-1).alias("start_offset"), F.lit(0).alias("end_offset"))
    box = F.when(F.col("k") % 3 == 0, F.array(F.lit(100.0), F.col("k") * 10.0, F.lit(500.0), F.lit(20.0))).when(F.col("k") % 3 == 1, F.array(*map(F.lit, [0.1, 0.2, 0.5, 0.6])))
    item = F.struct(_pick(["heading", "weird", "footnote", "paragraph"], F.col("k")).alias("type"), F.when(F.col("k") % 7 == 6, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"), box.alias("bbox"), F.when(F.col("k") % 5 != 4, F.col("k") * 20.0).alias("confidence"), F.when(F.col("k") % 4 == 2, "[12)").alias("footnote_marker"), F.array(ref).alias("footnote_refs"))
    raw = b.withColumn("k", k).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("i")))), lambda x: x["i"]).alias("items"))
    return raw, raw.select("doc_id", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.when(F.col("page") % 2 == 0, "blank").otherwise("text").alias("page_type"), F.lit(0.0001).alias("ink_coverage"))


def _page_order():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "page").orderBy("reading_order")


OCR = f"""{BLOCKS}, pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY reading_order) - 1 AS k FROM blocks),
ocr AS (SELECT doc_id, page, k, 'ocr-' || page || '-' || (k + 1) AS block_id, ['heading', 'paragraph', 'footnote', 'paragraph'][k % 4 + 1] AS block_type, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 6000) AS text,
  CASE k % 3 WHEN 0 THEN [60.0, round((1000 - k * 10 - 20) / 1000.0 * 800, 2), 300.0, 16.0] WHEN 1 THEN [60.0, 320.0, 240.0, 320.0] ELSE [0.0, 0.0, 600.0, 800.0] END AS bbox,
  greatest(0.2, least(0.98, CASE WHEN k % 5 <> 4 THEN k * 20.0 ELSE 75 END / 100)) AS confidence FROM pl WHERE k % 7 <> 6)"""


@query(f"WITH {OCR} SELECT doc_id, page, block_id, block_type, text, array_to_string(list_transform(bbox, lambda x: CAST(CAST(x * 100 AS BIGINT) AS VARCHAR)), ' ') AS bbox, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN k % 4 = 2 THEN '12' END AS footnote_marker FROM ocr")
def normalize_ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = pa.normalize_ocr_blocks(*_ocr(spark, sf_dir))
    box = F.array_join(F.transform("bbox", lambda x: F.round(x * 100).cast("long").cast("string")), " ")
    return o.select("doc_id", "page", "block_id", "block_type", "text", box.alias("bbox"), "confidence", "footnote_marker")


OCR_QUALITY = f"""{OCR}, w AS (SELECT doc_id, page, count(*) AS block_count, sum(length(text)) + count(*) - 1 AS text_length, sum(confidence * length(text)) / sum(length(text)) AS weighted FROM ocr GROUP BY doc_id, page),
oq AS (SELECT doc_id, page, CAST(text_length AS BIGINT) AS text_length, block_count, CAST(CASE WHEN text_length < 25 THEN least(0.9, weighted) ELSE least(1.0, weighted) END AS DOUBLE) AS confidence, CASE WHEN text_length < 25 THEN 'sparse_text_page' END AS quality_issue FROM w)"""


@query(f"WITH {OCR_QUALITY} SELECT doc_id, page, text_length, block_count, round(confidence, 6) AS confidence, quality_issue FROM oq")
def ocr_page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, pages = _ocr(spark, sf_dir)
    q = pa.ocr_page_quality(pa.normalize_ocr_blocks(raw, pages), pages)
    return q.select("doc_id", "page", "text_length", "block_count", F.round("confidence", 6).alias("confidence"), "quality_issue")


@query(f"WITH {OCR_QUALITY}, ok AS (SELECT doc_id, page FROM oq WHERE confidence >= 0.65) SELECT b.doc_id, b.page, b.block_id FROM blocks b LEFT JOIN ok USING (doc_id, page) WHERE ok.doc_id IS NULL UNION ALL SELECT doc_id, page, block_id FROM ocr JOIN ok USING (doc_id, page)")
def replace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, pages = _ocr(spark, sf_dir)
    new = written(pa.normalize_ocr_blocks(raw, pages), "ocr-blocks")
    accepted = written(pa.accept_ocr_pages(pa.ocr_page_quality(new, pages)).select("doc_id", "page"), "accepted")
    return pa.replace_pages(ad.blocks(spark, sf_dir).drop("block_type", "reading_order", "text"), new.select("doc_id", "page", "block_id"), accepted).select("doc_id", "page", "block_id")


@query(f"""WITH {BLOCKS}, pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY reading_order) - 1 AS k FROM blocks), r AS (SELECT doc_id, page, k, ['text', 'table', 'image', 'formula'][k % 4 + 1] AS label, regexp_replace(left(CASE WHEN k % 8 = 0 THEN '# ' ELSE '' END || CASE WHEN k % 8 = 0 THEN ltrim(replace(text, '*', ''), ' ') ELSE replace(text, '*', '') END, 6000), '^# |^\\s+|\\s+$', '', 'g') AS t, regexp_replace(replace(text, '*', ''), '^\\s+|\\s+$', '', 'g') AS title FROM pl WHERE k % 4 <> 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS n FROM r)
SELECT doc_id, page, 'ocr-' || page || '-' || n AS block_id, CASE WHEN label = 'table' THEN 'table' WHEN (doc_id, page, t) IN (SELECT doc_id, page, title FROM r WHERE k % 8 = 0) OR (length(t) <= 80 AND regexp_matches(t, '^[^。，；：、,.;:\\n]+$')) THEN 'heading' ELSE 'paragraph' END AS block_type, t AS text FROM n""")
def normalize_layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts only: marked-up ones are in the tests."""
    b = ad.blocks(spark, sf_dir).withColumn("text", F.translate("text", "*", "")).withColumn("k", F.row_number().over(_page_order()) - 1)
    raw = b.select("doc_id", "page", F.col("k").alias("item_no"), _pick(["text", "table", "image", "formula"], F.col("k")).alias("label"), F.when(F.col("k") % 8 == 0, F.concat(F.lit("# "), F.ltrim("text"))).otherwise(F.col("text")).alias("content"), F.array(*map(F.lit, [0.1, 0.2, 0.5, 0.6])).alias("bbox"))
    markdown = b.where("k % 8 = 0").select("doc_id", "page", F.concat(F.lit("# "), F.ltrim("text")).alias("markdown"))
    return pa.normalize_layout_blocks(raw, markdown, _ocr(spark, sf_dir)[1]).select("doc_id", "page", "block_id", "block_type", "text")


def _boxed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = ad.blocks(spark, sf_dir)
    k = (F.col("reading_order") % 9).cast("double")
    box = F.when(F.col("reading_order") % 4 != 3, F.array(k, F.lit(790.0), F.lit(5.0) - k / 2, F.lit(3.0)))
    return b.withColumn("bbox", box).withColumn("extraction_method", F.when(F.col("reading_order") % 2 == 0, "vision_ocr").otherwise("pdf_text_layer")).withColumn("font_size", F.lit(None).cast("double")), b.select("doc_id", "page").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(800.0))


@query(f"WITH {BLOCKS} SELECT doc_id, block_id, CASE WHEN reading_order % 4 <> 3 THEN [round(reading_order % 9 / 600.0, 6), round(7 / 800.0, 6), round((5 - reading_order % 9 / 2.0) / 600.0, 6), round(3 / 800.0, 6)][2] END AS y, CASE WHEN reading_order % 4 <> 3 THEN round(greatest(0, 5 - reading_order % 9 / 2.0) / 600.0, 6) END AS w FROM blocks")
def page_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pa.page_rects(*_boxed(spark, sf_dir))
    return r.select("doc_id", "block_id", F.get("page_rect", F.lit(1)).alias("y"), F.get("page_rect", F.lit(2)).alias("w"))


@query(f"""WITH {BLOCKS}, b AS (SELECT *, reading_order % 9 AS k, 5 - reading_order % 9 / 2.0 AS r, reading_order % 2 = 0 AS o FROM blocks), f AS (SELECT *, o AND k <= 6 AND r <= 6 AS legacy, least(600, k * 1000.0) AS x0 FROM b WHERE reading_order % 4 <> 3)
SELECT doc_id, block_id, CAST(CASE WHEN legacy THEN x0 ELSE k END AS DOUBLE) AS x, CAST(CASE WHEN legacy THEN greatest(1, greatest(x0, least(600, r * 1000)) - x0) ELSE r END AS DOUBLE) AS w FROM f UNION ALL SELECT doc_id, block_id, NULL, NULL FROM b WHERE reading_order % 4 = 3""")
def repair_legacy_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pa.repair_legacy_boxes(*_boxed(spark, sf_dir))
    return r.select("doc_id", "block_id", F.get("bbox", F.lit(0)).alias("x"), F.get("bbox", F.lit(2)).alias("w"))


# annotations


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation of each block, with fields that break the rules."""
    b, k = ad.blocks(spark, sf_dir), F.col("reading_order")
    return b.select(
        F.concat(F.lit("a-"), _text("doc_id"), F.lit("-"), _text(k)).alias("annotation_id"), F.lit("other").alias("project_id"), "doc_id", _pick(["highlight", "note", "scribble"], k).alias("kind"), _pick(["yellow", "red"], k).alias("color"), _pick(["观点卡", "案例卡", "规范卡", "问题卡", "?"], k).alias("card_type"),
        F.when(k % 12 == 9, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"), F.lit(" n ").alias("note"), (k - 3).cast("int").alias("page"), "block_id", (k % 5 - 2).cast("int").alias("start_offset"), F.lit(0).alias("end_offset"), F.col("text").alias("quote_prefix"), F.col("text").alias("quote_suffix"),
        F.array(*map(F.lit, [-1.0, 0.5, 2.0, 0.25])).alias("page_rect"), F.lit(None).cast("array<array<double>>").alias("page_rects"), F.array().cast("array<struct<block_id:string,start_offset:int,end_offset:int,text:string>>").alias("segments"), F.lit("lost").alias("anchor_status"),
        F.array(F.lit(" t1 "), _pick(["x", "y", "t1"], k), F.lit("")).alias("tags"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )


ANN = f"""{BLOCKS}, an AS (SELECT 'a-' || doc_id || '-' || reading_order AS annotation_id, doc_id, block_id, reading_order AS k, ['highlight', 'note', 'highlight'][reading_order % 3 + 1] AS kind, ['yellow', 'yellow'][reading_order % 2 + 1] AS color, ['观点卡', '案例卡', '规范卡', '问题卡', '引用卡'][reading_order % 5 + 1] AS card_type,
  left(regexp_replace(blocks.text, '^\\s+|\\s+$', '', 'g'), 5000) AS text, blocks.text AS whole, CASE WHEN reading_order % 3 = 2 THEN ['t1'] ELSE ['t1', ['x', 'y'][reading_order % 3 + 1]] END AS tags, greatest(0, reading_order % 5 - 2) AS start_offset, greatest(1, least(1 + n_chars // 1000, CASE WHEN reading_order = 3 THEN 1 ELSE reading_order - 3 END)) AS page
  FROM blocks JOIN documents USING (doc_id) WHERE reading_order % 12 <> 9)"""


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.sanitize_annotations(_quotes(spark, sf_dir), ad.documents(spark, sf_dir))


@query(f"WITH {ANN} SELECT annotation_id, source AS project_id, an.doc_id, kind, color, card_type, an.text, 'n' AS note, CAST(page AS INTEGER) AS page, CAST(start_offset AS INTEGER) AS start_offset, CAST(start_offset + length(an.text) AS INTEGER) AS end_offset, right(whole, 80) AS quote_prefix, left(whole, 80) AS quote_suffix, '0.0 0.5 1.0 0.25' AS rect, 'exact' AS anchor_status, array_to_string(tags, '|') AS tags FROM an JOIN documents d USING (doc_id)")
def sanitize_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _clean(spark, sf_dir)
    return a.select("annotation_id", "project_id", "doc_id", "kind", "color", "card_type", "text", "note", "page", "start_offset", "end_offset", "quote_prefix", "quote_suffix", F.array_join(F.col("page_rect").cast("array<string>"), " ").alias("rect"), "anchor_status", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {ANN} SELECT 'card-' || annotation_id AS card_id, an.doc_id, card_type AS type, CASE WHEN length(an.text) > 34 THEN left(an.text, 34) || '…' ELSE an.text END AS title, an.text AS excerpt, 'Document ' || doc_id AS source, CASE WHEN card_type IN ('案例卡', '规范卡') THEN '背景' WHEN card_type = '问题卡' THEN '条件性' ELSE '支持' END AS relation, '已核验' AS verify_status FROM an")
def annotations_to_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.annotations_to_cards(_clean(spark, sf_dir), ad.documents(spark, sf_dir)).select("card_id", "doc_id", "type", "title", "excerpt", "source", "relation", "verify_status")


@query(f"WITH {ANN}, t AS (SELECT DISTINCT doc_id, annotation_id, page, start_offset, unnest(list_concat([card_type], tags)) AS tag FROM an) SELECT doc_id, tag, string_agg(annotation_id, '|' ORDER BY page, start_offset, annotation_id) AS ids FROM t GROUP BY doc_id, tag")
def annotations_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.annotations_by_tag(_clean(spark, sf_dir)).select("doc_id", "tag", F.array_join("annotation_ids", "|").alias("ids"))


@query(f"WITH {ANN}, t AS (SELECT DISTINCT doc_id, block_id, unnest(list_concat([CASE WHEN kind = 'note' THEN '批注' ELSE '高亮' END, card_type], tags)) AS tag FROM an) SELECT doc_id, block_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM t GROUP BY ALL")
def block_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _clean(spark, sf_dir)
    return an.block_tags(a.select("annotation_id", "doc_id", "block_id"), a).select("doc_id", "block_id", F.array_join("tags", "|").alias("tags"))


@query(f"WITH {ANN} SELECT annotation_id, CASE WHEN k % 2 = 0 THEN 'stored' ELSE 'new' END AS note FROM an WHERE k % 2 = 0 OR k % 4 = 3")
def insert_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of four are new; of those that are stored the stored row stays."""
    a, k = _clean(spark, sf_dir), F.substring_index("annotation_id", "-", -1).cast("int")
    stored, new = a.where(k % 2 == 0).withColumn("note", F.lit("stored")), a.where((k % 2 == 0) | (k % 4 == 3)).withColumn("note", F.lit("new"))
    return an.insert_annotations(stored, new.unionByName(new)).select("annotation_id", "note")


@query(f"WITH {ANN} SELECT annotation_id, CASE WHEN k % 2 = 1 THEN 'edited' ELSE 'n' END AS note, CASE WHEN k % 2 = 1 THEN 'blue' ELSE color END AS color FROM an")
def patch_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, k = _clean(spark, sf_dir), F.substring_index("annotation_id", "-", -1).cast("int")
    edits = a.where(k % 2 == 1).select("annotation_id", "doc_id", F.lit(" edited ").alias("note"), F.lit("blue").alias("color"))
    unknown = edits.withColumn("annotation_id", F.concat(F.lit("no-"), "annotation_id"))
    return an.patch_annotations(a, edits.unionByName(unknown), ad.documents(spark, sf_dir)).select("annotation_id", "note", "color")


@query(f"WITH {ANN} SELECT annotation_id FROM an WHERE k % 4 <> 3")
def delete_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _clean(spark, sf_dir)
    return an.delete_annotations(a, a.where(F.substring_index("annotation_id", "-", -1).cast("int") % 4 == 3)).select("annotation_id")


@query(f"WITH {BLOCKS} SELECT doc_id, block_id, substring(text, greatest(0, length(text) // 3 - 80) + 1, length(text) // 3 - greatest(0, length(text) // 3 - 80)) AS quote_prefix, substring(text, length(text) // 2 + 1, 80) AS quote_suffix FROM blocks")
def quote_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    c = an.quote_context(F.col("text"), F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"))
    return ad.blocks(spark, sf_dir).withColumn("c", c).select("doc_id", "block_id", "c.quote_prefix", "c.quote_suffix")


@query(f"WITH {ANN} SELECT annotation_id FROM an WHERE list_contains(tags, 'x') AND (contains(lower(text), 'thing') OR contains('n', 'thing') OR contains(array_to_string(tags, ' '), 'thing'))")
def filter_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.filter_annotations(_clean(spark, sf_dir), tag="x", query="Thing").select("annotation_id")


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of two neighbouring blocks of a page (the last of an odd page alone): some moved to another block, some no longer there."""
    b = ad.blocks(spark, sf_dir).withColumn("k", F.row_number().over(_page_order()) - 1).withColumn("b1", F.lead("block_id").over(_page_order())).withColumn("t1", F.lead("text").over(_page_order()))
    two = b.where("k % 2 = 0").select("doc_id", "page", F.expr("k div 2").alias("j"), F.col("block_id").alias("b0"), F.col("text").alias("t0"), "b1", "t1")
    seg = lambda where, t: F.struct(where.alias("block_id"), F.lit(0).alias("start_offset"), F.length(t).alias("end_offset"), t.alias("text"))
    turn = (F.col("page") + F.col("j")) % 3
    other = F.when(turn == 2, F.concat(F.lit("\u0001"), "t1")).otherwise(F.col("t1"))
    own = seg(F.col("b0"), F.col("t0"))
    segments = F.when(F.col("b1").isNull(), F.array(own)).otherwise(F.array(own, seg(F.when(turn == 1, F.lit("nowhere")).otherwise(F.col("b1")), other)))
    return two.select(F.concat_ws("-", _text("doc_id"), _text("page"), _text("j")).alias("annotation_id"), "doc_id", F.col("b0").alias("block_id"), "page", F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"), segments.alias("segments"), F.lit("exact").alias("anchor_status"))


@query(f"""WITH {BLOCKS}, pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY reading_order) - 1 AS k FROM blocks), two AS (SELECT a.doc_id, a.page, a.k // 2 AS j, b.block_id AS b1, b.text AS t, CASE WHEN b.block_id IS NULL THEN 3 ELSE (a.page + a.k // 2) % 3 END AS turn FROM pl a LEFT JOIN pl b ON a.doc_id = b.doc_id AND a.page = b.page AND b.k = a.k + 1 WHERE a.k % 2 = 0),
hit AS (SELECT t.doc_id, t.page, t.j, arg_min(b.block_id, b.page * 1000000 + b.reading_order) AS b FROM two t JOIN blocks b ON b.doc_id = t.doc_id AND contains(b.text, t.t) WHERE turn = 1 GROUP BY ALL)
SELECT t.doc_id || '-' || t.page || '-' || t.j AS annotation_id, CASE turn WHEN 2 THEN 'orphaned' WHEN 1 THEN 'recovered' ELSE 'exact' END AS anchor_status, CASE turn WHEN 1 THEN h.b WHEN 0 THEN b1 END AS second_block FROM two t LEFT JOIN hit h USING (doc_id, page, j)""")
def recover_segment_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = an.recover_segment_anchors(_segmented(spark, sf_dir), ad.blocks(spark, sf_dir))
    return r.select("annotation_id", "anchor_status", F.when(F.col("anchor_status") != "orphaned", F.get("segments", F.lit(1))["block_id"]).alias("second_block"))


# search and lists


@query(f"WITH {DOCS} SELECT doc_id, title FROM docs WHERE NOT archived AND kind = 'paper' AND (contains(lower(title), 'document 1') OR contains(lower(source), 'document 1'))")
def filter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.filter_documents(ad.documents(spark, sf_dir), "paper", "Document 1", "progress").select("doc_id", "title")


@query(f"WITH {NODES.split('matrix AS')[0].strip().rstrip(',')} SELECT card_id, title FROM cards WHERE type = '观点卡' AND verify_status <> '已核验' AND (contains(lower(title), 'a') OR contains(lower(excerpt), 'a') OR contains(lower(source), 'a'))")
def filter_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.filter_cards(ad.cards(spark, sf_dir), "观点卡", False, "A").select("card_id", "title")


@query(f"WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, kind, content_hash ORDER BY doc_id DESC) AS rn FROM docs) SELECT doc_id, CASE WHEN doc_id % 7 = 4 THEN 'running' WHEN has_analysis THEN 'completed' ELSE 'idle' END AS analysis_status FROM r WHERE rn = 1")
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.document_summaries(ad.documents(spark, sf_dir)).select("doc_id", "analysis_status")


@query(f"WITH {DOCS}, p AS (SELECT DISTINCT project_id, project_id IN (SELECT min(project_id) FROM docs) AS gone FROM docs) SELECT p.project_id, count(*) FILTER (gone OR NOT archived) AS documents, count(*) FILTER ((gone OR NOT archived) AND status = 'ready') AS ready, 50 AS progress FROM p JOIN docs USING (project_id) GROUP BY p.project_id")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.documents(spark, sf_dir)
    first = d.agg(F.min("project_id").alias("first"))
    p = d.select("project_id").distinct().join(F.broadcast(first)).select("project_id", F.when(F.col("project_id") == F.col("first"), F.lit("2024-01-01").cast("timestamp")).alias("archived_at"))  # one row
    return se.dashboard_counts(d, p, p.select("project_id", F.lit(50).alias("progress")))


# cards, nodes and issues


@query(f"WITH {NODES.strip().rstrip(',')} SELECT 'card-' || doc_id || '-' || node_id AS card_id, doc_id, '观点卡' AS type, title, '待核验' AS verify_status, '支持' AS relation FROM nodes JOIN (SELECT doc_id FROM documents) USING (doc_id) WHERE anchored UNION ALL SELECT 'card-' || doc_id || '-' || issue_id, doc_id, '案例卡', title, '待核验', '背景' FROM issues JOIN (SELECT doc_id FROM documents) USING (doc_id) WHERE anchored".replace("matrix AS (SELECT c.*", "docs AS (SELECT doc_id, doc_id % 11 = 0 AS archived FROM documents), matrix AS (SELECT c.*"))
def cards_from_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.documents(spark, sf_dir)
    names = ["card_id", "doc_id", "type", "title", "verify_status", "relation"]
    return re_.card_from_node(ad.nodes(spark, sf_dir), d).select(*names).unionByName(re_.card_from_issue(ad.issues(spark, sf_dir), d).select(*names))


@query(f"WITH {DOCS}, {NODES} SELECT 'node' AS what, node_id AS id, CASE WHEN user_status = 'understood' AND NOT anchored THEN 'doubt' ELSE user_status END AS status FROM nodes UNION ALL SELECT 'issue', issue_id, CASE WHEN status = '已完成' AND NOT anchored THEN '进行中' ELSE status END FROM issues UNION ALL SELECT 'card', card_id, CASE WHEN verify_status = '已核验' AND NOT anchored THEN '待核验' ELSE verify_status END FROM cards")
def integrity_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda df, what, i, s: df.select(F.lit(what).alias("what"), F.col(i).alias("id"), F.col(s).alias("status"))
    return row(re_.demote_nodes(ad.nodes(spark, sf_dir)), "node", "node_id", "user_status").unionByName(row(re_.demote_issues(ad.issues(spark, sf_dir)), "issue", "issue_id", "status")).unionByName(row(re_.demote_cards(ad.cards(spark, sf_dir)), "card", "card_id", "verify_status"))


@query(f"WITH {DOCS}, {NODES} SELECT card_id, anchored AS allowed FROM cards")
def verify_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, refused = re_.verify_gate(ad.cards(spark, sf_dir), F.col("source_anchor").isNotNull())
    return ok.select("card_id", F.lit(True).alias("allowed")).unionByName(refused.select("card_id", F.lit(False).alias("allowed")))


@query(f"WITH {DOCS}, {NODES}, u AS (SELECT card_id, doc_id, type, 1 AS page, excerpt FROM cards), n AS (SELECT DISTINCT ON (doc_id, type, excerpt) 'new-' || card_id AS card_id, doc_id, type, excerpt, doc_id % 3 = 0 AS other FROM cards ORDER BY doc_id, type, excerpt, card_id) SELECT card_id FROM u UNION ALL SELECT card_id FROM n WHERE other")
def insert_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New cards, twice each, of which a third is on another page than the stored one."""
    c = ad.cards(spark, sf_dir)
    new = c.withColumn("card_id", F.concat(F.lit("new-"), "card_id")).withColumn("page", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(F.col("page")))
    return re_.insert_cards_dedup(c, new.unionByName(new)).select("card_id")


@query(f"WITH {DOCS}, {NODES}, left_over AS (SELECT doc_id, project_id FROM docs WHERE doc_id % 4 <> 1 AND project_id <> (SELECT min(project_id) FROM docs)) SELECT 'documents' AS what, CAST(doc_id AS VARCHAR) AS id FROM left_over UNION ALL SELECT 'nodes', node_id FROM nodes WHERE doc_id IN (SELECT doc_id FROM left_over) UNION ALL SELECT 'cards', card_id FROM cards WHERE doc_id IN (SELECT doc_id FROM left_over)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.documents(spark, sf_dir)
    # what has no project of its own goes with the documents, so they go first
    out = re_.cascade_delete({"documents": d, "nodes": ad.nodes(spark, sf_dir).join(d.select("doc_id"), "doc_id", "left_semi"), "cards": ad.cards(spark, sf_dir)}, doc_ids=d.where("doc_id % 4 = 1"))
    out = re_.cascade_delete(out, project_ids=d.agg(F.min("project_id").alias("project_id")))
    ids = lambda k, key: out[k].select(F.lit(k).alias("what"), _text(key).alias("id"))
    return ids("documents", "doc_id").unionByName(ids("nodes", "node_id")).unionByName(ids("cards", "card_id"))


@query(f"WITH {BLOCKS}, t AS (SELECT doc_id, page, min(block_id) AS b FROM blocks GROUP BY ALL), c AS (SELECT l.doc_id, 1 + l.doc_id % 4 AS page FROM labels l JOIN documents USING (doc_id)), j AS (SELECT c.doc_id, arg_min(t.b, abs(t.page - c.page) * 1000000 + t.page) AS target_id FROM c LEFT JOIN t USING (doc_id) GROUP BY c.doc_id) SELECT CAST(doc_id AS VARCHAR) AS card_id, target_id FROM j")
def nearest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ad.blocks(spark, sf_dir).select("doc_id", "page", F.col("block_id").alias("target_id"))
    c = ad.cards(spark, sf_dir).withColumn("page", (1 + F.col("doc_id") % 4).cast("int"))
    return re_.nearest_target(c, t).select("card_id", "target_id")


@query(f"WITH {DOCS}, {NODES} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM nodes) THEN 'summary' WHEN doc_id IN (SELECT doc_id FROM issues) THEN 'fact' ELSE '尚未形成结论' END AS conclusion FROM docs")
def document_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.document_conclusion(ad.documents(spark, sf_dir), ad.nodes(spark, sf_dir), ad.issues(spark, sf_dir))


@query(f"""WITH {BLOCKS}, n AS (SELECT doc_id, reading_order, ['问题提出', '理由', '核心结论'][reading_order % 3 + 1] AS role, text AS s, ['unread', 'understood', 'doubt', 'read'][reading_order % 4 + 1] AS st FROM blocks)
SELECT doc_id, count(*) FILTER (reading_order % 2 = 0) AS anchored_nodes, count(*) FILTER (st IN ('unread', 'doubt')) AS pending_nodes, coalesce(arg_min(s, reading_order) FILTER (role = '问题提出'), arg_min(s, reading_order)) AS question, coalesce(arg_max(s, reading_order) FILTER (role = '核心结论'), arg_max(s, reading_order)) AS conclusion FROM n GROUP BY doc_id""")
def paper_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("reading_order")
    n = ad.blocks(spark, sf_dir).select("doc_id", k.alias("ord"), _pick(["问题提出", "理由", "核心结论"], k).alias("role"), F.col("text").alias("summary"), _pick(["unread", "understood", "doubt", "read"], k).alias("user_status"), F.when(k % 2 == 0, F.array("block_id")).otherwise(F.array().cast("array<string>")).alias("source_anchors"))
    return re_.paper_overview(n)


@query(f"WITH {DOCS}, {NODES} SELECT card_id, '《Document ' || doc_id || '》，' || d.source || '，第1页。' AS footnote, '“' || excerpt || '”（第1页）' AS quote_text, excerpt || '（第1页）' AS paraphrase_text FROM cards JOIN (SELECT doc_id, source FROM docs) d USING (doc_id)")
def footnote_for_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.footnote_for_card(ad.cards(spark, sf_dir), ad.documents(spark, sf_dir)).select("card_id", "footnote", "quote_text", "paraphrase_text")


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draft a project and outline section with the citations of its cards."""
    c = ad.cards(spark, sf_dir)
    drafts = c.select("project_id").distinct().select("project_id", F.explode(F.array(*map(F.lit, ["o0", "o1", "o2"]))).alias("outline_id"), F.lit("Draft").alias("content"), F.array(F.lit("0")).alias("citation_card_ids"))
    cite = c.where("doc_id % 3 < 2").select("project_id", F.concat(F.lit("o"), _text(F.col("doc_id") % 3)).alias("outline_id"), "card_id", F.concat(F.lit("["), "card_id", F.lit("]")).alias("text"), F.col("doc_id").alias("ord"))
    return re_.insert_citation(drafts, cite)


DRAFTS = f"""{DOCS}, {NODES}, g AS (SELECT project_id, 'o' || (doc_id % 3) AS outline_id, string_agg('[' || card_id || ']', '' ORDER BY doc_id) AS t, list(card_id ORDER BY doc_id) AS ids FROM cards WHERE doc_id % 3 < 2 GROUP BY ALL),
dr AS (SELECT p.project_id, o.outline_id, 'Draft' || coalesce(t, '') AS content, CASE WHEN ids IS NULL THEN ['0'] ELSE list_concat(['0'], list_filter(ids, lambda x: x <> '0')) END AS ids FROM (SELECT DISTINCT project_id FROM cards) p CROSS JOIN (VALUES ('o0'), ('o1'), ('o2')) o(outline_id) LEFT JOIN g USING (project_id, outline_id))"""


@query(f"WITH {DRAFTS} SELECT project_id, outline_id, content, array_to_string(ids, '|') AS ids FROM dr")
def insert_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drafts(spark, sf_dir).select("project_id", "outline_id", "content", F.array_join("citation_card_ids", "|").alias("ids"))


@query(f"""WITH {DRAFTS}, n AS (SELECT project_id, outline_id, unnest(ids) AS card_id, unnest(range(len(ids))) AS pos FROM dr), l AS (SELECT n.project_id, outline_id, string_agg('[' || (pos + 1) || '] ' || c.source || '，第 1 页：' || c.excerpt, chr(10) ORDER BY pos) AS notes FROM n JOIN cards c USING (card_id) GROUP BY ALL)
SELECT project_id, outline_id, content || coalesce(chr(10) || chr(10) || notes, '') AS report FROM dr LEFT JOIN l USING (project_id, outline_id)""")
def draft_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.draft_report(_drafts(spark, sf_dir), ad.cards(spark, sf_dir))


@query(f"""WITH {DOCS}, {NODES}, a AS (SELECT * FROM docs WHERE NOT archived), l AS (SELECT project_id, 0 AS part, '' AS doc, '' AS item, '# P' || project_id || chr(10) || chr(10) || '研究问题：q' || chr(10) AS line FROM (SELECT DISTINCT project_id FROM docs)
UNION ALL SELECT project_id, 1, CAST(doc_id AS VARCHAR), '', '## ' || title || chr(10) || chr(10) || 'c' || doc_id FROM a UNION ALL SELECT project_id, 1, CAST(doc_id AS VARCHAR), card_id, '- ' || title || '：' || excerpt || '（第 1 页）' FROM cards WHERE verify_status = '已核验' AND doc_id IN (SELECT doc_id FROM a))
SELECT project_id, sha256(string_agg(line, chr(10) ORDER BY part, doc, item)) AS report FROM l GROUP BY project_id""")
def project_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.documents(spark, sf_dir)
    p = d.select("project_id").distinct().select("project_id", F.concat(F.lit("P"), "project_id").alias("title"), F.lit("q").alias("question"))
    r = reports.project_report(p, d, d.select("doc_id", F.concat(F.lit("c"), _text("doc_id")).alias("conclusion")), ad.cards(spark, sf_dir))
    return r.select("project_id", F.sha2("report", 256).alias("report"))


@query(f"""WITH {DOCS}, {NODES}, l AS (SELECT source AS project_id, 1 AS part, 'card:' || card_id AS item, '| ' || issue || ' | ' || stance || ' | ' || CASE WHEN type = '规范卡' THEN '规范依据' ELSE '用户摘录' END || ' | Document ' || doc_id || '，第 ' || m_page || ' 页：' || replace(title, '|', '\\|') || ' |' AS line FROM matrix WHERE stance = '反对'
UNION ALL SELECT DISTINCT project_id, 0, '', '# 写作引用清单' || chr(10) || '研究问题：q' || chr(10) || chr(10) || '| 写作章节 | 使用方式 | 材料类型 | 原文定位 |' || chr(10) || '| --- | --- | --- | --- |' FROM docs) SELECT project_id, string_agg(line, chr(10) ORDER BY part, item) AS report FROM l GROUP BY project_id""")
def matrix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = re_.matrix_rows(*(f(spark, sf_dir) for f in (ad.cards, ad.documents, ad.entries)))
    return reports.matrix_report(re_.matrix_filter(rows, stance="反对"), ad.documents(spark, sf_dir).select("project_id", F.lit("q").alias("question")).distinct())


# jobs


@query("""WITH r AS (SELECT user_id AS doc_id, ['ocr_page', 'ocr_all', 'analyze', 'export'][event_id % 4 + 1] AS type, event_id FROM events), f AS (SELECT *, CASE WHEN type LIKE 'ocr%' THEN 'ocr' WHEN type LIKE 'analy%' THEN 'analysis' ELSE type END AS family FROM r)
SELECT doc_id, family, arg_min(type, event_id) AS type FROM f WHERE NOT (family = 'ocr' AND doc_id % 5 = 0) AND NOT (family = 'analysis' AND doc_id % 3 = 0 AND event_id % 16 <> 2) GROUP BY doc_id, family""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    requests = e.select(F.col("user_id").alias("doc_id"), _pick(["ocr_page", "ocr_all", "analyze", "export"], F.col("event_id")).alias("type"), (F.col("event_id") % 16 == 2).alias("forced"), F.col("event_id").alias("requested_at"))
    users = e.select(F.col("user_id").alias("doc_id")).distinct()
    jobs = users.select("doc_id", F.lit("ocr_all").alias("type"), F.when(F.col("doc_id") % 5 == 0, "running").otherwise("completed").alias("status"))
    docs = users.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "completed").otherwise("idle").alias("analysis_status"))
    return jo.pending_work(requests, jobs, docs).select("doc_id", "family", "type")


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN status IN ('analyzing', 'ocr') THEN 'review' ELSE status END AS status, CASE WHEN status IN ('analyzing', 'ocr') THEN status || ' interrupted' END AS error, status IN ('uploaded', 'parsing') OR doc_id % 4 = 0 AS retry FROM docs")
def reclassify_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.documents(spark, sf_dir).withColumn("parsing_version", F.when(F.col("doc_id") % 8 == 0, None).when(F.col("doc_id") % 4 == 0, "0").otherwise("1"))
    out, retry = jo.reclassify_stale(d, "1")
    return out.select("doc_id", "status", "error").join(retry.withColumn("retry", F.lit(True)), "doc_id", "left").withColumn("retry", F.coalesce("retry", F.lit(False)))


@query("WITH r AS (SELECT user_id AS doc_id, count(*) FILTER (event_id % 5 = 0) AS failed FROM events GROUP BY 1) SELECT doc_id, CASE WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS ocr_status, CASE WHEN doc_id % 5 = 0 THEN 'ready' ELSE 'review' END AS status FROM documents JOIN r USING (doc_id)")
def ocr_doc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = jo.job_rollup(pa_results(spark, sf_dir)).withColumnRenamed("job_id", "doc_id")
    return jo.ocr_doc_status(r, ad.documents(spark, sf_dir))


def pa_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.page_results(ad.table(spark, sf_dir, "events"))


@query("""WITH s AS (SELECT event_id, ['uploaded', 'kimi_ocr', 'analyzing_sections', 'synthesizing_judgment', 'finalizing_anchors', 'analysis_ready', 'unheard_of'][event_id % 7 + 1] AS stage, event_id % 11 AS done, event_id % 11 + event_id % 3 AS total FROM events), v AS (SELECT *, CASE WHEN total > 0 THEN done / total ELSE 0 END AS share FROM s)
SELECT event_id, CASE stage WHEN 'uploaded' THEN '已上传，等待解析' WHEN 'kimi_ocr' THEN 'AI 正在识别页面' WHEN 'analyzing_sections' THEN 'AI 正在逐段分析' WHEN 'synthesizing_judgment' THEN 'AI 正在综合裁判结构' WHEN 'finalizing_anchors' THEN 'AI 正在关联原文依据' WHEN 'analysis_ready' THEN 'AI 阅读辅助已就绪' ELSE stage END AS stage_label,
CAST(CASE stage WHEN 'uploaded' THEN 2 WHEN 'kimi_ocr' THEN floor(100 * share + 0.5) WHEN 'analyzing_sections' THEN 10 + floor(65 * share + 0.5) WHEN 'synthesizing_judgment' THEN 82 WHEN 'finalizing_anchors' THEN 94 WHEN 'analysis_ready' THEN 100 ELSE 0 END AS INTEGER) AS value FROM v""")
def progress_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    jobs = ad.table(spark, sf_dir, "events").select("event_id", _pick(["uploaded", "kimi_ocr", "analyzing_sections", "synthesizing_judgment", "finalizing_anchors", "analysis_ready", "unheard_of"], i).alias("stage"), (i % 11).alias("done"), (i % 11 + i % 3).alias("total"))
    return jo.progress_stage(jobs).select("event_id", "stage_label", "value")


@query("SELECT user_id AS job_id, event_id AS page, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN event_id % 3 = 0 THEN 'interrupted' END AS error FROM events")
def fail_stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("page"), _pick(["running", "completed", "completed"], F.col("event_id")).alias("status"), F.lit(None).cast("string").alias("error"))
    return jo.fail_stale_jobs(j)


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'é' || doc_id || '.pdf' ELSE 'plain ' || doc_id || '.pdf' END AS original_filename, CASE WHEN doc_id % 2 = 0 THEN 'é' || doc_id ELSE 'plain ' || doc_id END AS title FROM documents")
def repair_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the names were read as Latin-1 once too often."""
    i = _text("doc_id")
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("é".encode().decode("latin-1")), i)).otherwise(F.concat(F.lit("plain "), i))
    return workspace.repair_filenames(ad.table(spark, sf_dir, "documents").select(F.concat(name, F.lit(".pdf")).alias("original_filename"), name.alias("title")))
