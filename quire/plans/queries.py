"""Registered queries and their SQL. Each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import annotations as an
from quire.operators import citations as ci
from quire.operators import footnotes as fo
from quire.operators import jobs as jo
from quire.operators import pages as pa
from quire.operators import research as re_
from quire.operators import responses as rs
from quire.operators import search as se
from quire.operators import structure as st
from quire.plans import adapters as ad
from quire.shared import written
from quire.sources import reports, workspace
from quire.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}

BLOCKS = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
blocks AS (SELECT doc_id, 'b' || lpad(CAST(pos AS VARCHAR), 7, '0') AS block_id, CAST(1 + pos // 8 AS INTEGER) AS page, pos AS reading_order, text,
                  CASE WHEN length(text) <= 24 THEN 'heading' ELSE 'paragraph' END AS block_type FROM lines WHERE regexp_matches(text, '\S'))"""
SQUEEZE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
DOCS = """
docs AS (SELECT doc_id, source AS project_id, CASE WHEN lang = 'en' THEN 'paper' ELSE 'judgment' END AS kind, 'Document ' || doc_id AS title, source, sha256(text) AS content_hash,
                ['uploaded', 'parsing', 'ocr', 'review', 'analyzing', 'ready', 'failed'][doc_id % 7 + 1] AS status, 1 + n_chars // 1000 AS page_count, 1 + n_chars // 2500 AS current_page,
                doc_id % 5 = 0 AS has_analysis, doc_id % 11 = 0 AS archived FROM documents)"""
NODES = """
nodes AS (SELECT doc_id, 'n' || doc_id AS node_id, 'Node ' || doc_id AS title, doc_id % 4 = 0 AS anchored, CASE WHEN toxic = 1 THEN '结论' ELSE '问题' END AS role,
                 CASE WHEN doc_id % 6 = 0 THEN 'doubt' WHEN quality = 1 THEN 'understood' ELSE 'unread' END AS user_status FROM labels WHERE doc_id % 2 = 0),
issues AS (SELECT doc_id, 'i' || doc_id AS issue_id, 'Issue ' || doc_id AS title, doc_id % 3 <> 1 AS anchored,
                  CASE WHEN quality = 1 THEN '已完成' WHEN doc_id % 3 = 0 THEN '进行中' ELSE '待读取' END AS status FROM labels WHERE doc_id % 2 = 1),
cards AS (SELECT CAST(l.doc_id AS VARCHAR) AS card_id, d.source AS project_id, l.doc_id, CASE WHEN l.doc_id % 4 = 0 THEN '规范卡' ELSE '观点卡' END AS type,
                 CASE WHEN toxic = 1 THEN '责任与赔偿' ELSE 'Card ' || l.doc_id END AS title, left(d.text, 60) AS excerpt, d.source, CASE WHEN quality = 1 THEN '已核验' ELSE '待核验' END AS verify_status,
                 ['支持', '反对', '条件性', '背景', '其他'][l.doc_id % 5 + 1] AS relation, CASE WHEN l.doc_id % 10 = 0 THEN '第一章' ELSE '' END AS outline_node, l.doc_id % 2 = 0 AS anchored FROM labels l JOIN documents d USING (doc_id)),
matrix AS (SELECT c.*, CASE WHEN c.doc_id % 9 = 0 THEN '保存的争点' WHEN outline_node <> '' THEN outline_node WHEN toxic_title THEN '裁判结论与责任分配' ELSE '待归类争点' END AS issue,
                  CASE WHEN c.doc_id % 9 = 0 THEN '反对' WHEN relation = '其他' THEN '待判断' ELSE relation END AS stance, CASE WHEN anchored THEN 2 ELSE 1 END AS m_page
           FROM (SELECT *, title = '责任与赔偿' AS toxic_title FROM cards) c JOIN docs d USING (doc_id) WHERE NOT d.archived)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


QUALITY = f"""WITH {BLOCKS},
q AS (SELECT doc_id, page, sum(length(text)) + count(*) - 1 AS text_length, count(*) AS block_count, sum(CASE WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END) AS no_word,
             sum(CASE WHEN length(text) <= 3 THEN 1 ELSE 0 END) AS tiny FROM blocks GROUP BY doc_id, page),
pages_q AS (SELECT doc_id, page, CAST(text_length AS BIGINT) AS text_length, block_count,
  CASE WHEN text_length < 25 THEN 0.2 WHEN block_count >= 20 AND (no_word / block_count >= 0.3 OR tiny / block_count >= 0.55) THEN 0.3 ELSE 1.0 END AS confidence,
  CASE WHEN text_length < 25 THEN 'too_little_text' WHEN block_count >= 20 AND (no_word / block_count >= 0.3 OR tiny / block_count >= 0.55) THEN 'broken_reading_order_or_font_map' END AS quality_issue FROM q)"""


@query(f"{QUALITY} SELECT doc_id, page, text_length, block_count, CAST(confidence AS DOUBLE) AS confidence, quality_issue FROM pages_q")
def page_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pa.page_text_quality(ad.blocks(spark, sf_dir))


@query(f"{QUALITY} SELECT doc_id, count(*) AS page_count, count(*) FILTER (confidence < 0.65) AS n_low, CAST(sum(text_length) AS BIGINT) AS character_count, round(avg(CAST(confidence AS DOUBLE)), 6) AS average_confidence FROM pages_q GROUP BY doc_id")
def document_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pa.document_rollup(pa.page_summary(ad.blocks(spark, sf_dir)))
    return r.select("doc_id", "page_count", F.size("low_confidence_pages").cast("long").alias("n_low"), "character_count", F.round("average_confidence", 6).alias("average_confidence"))


@query(f"WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, kind, content_hash ORDER BY doc_id DESC) AS rn FROM docs) SELECT doc_id, project_id, kind, content_hash FROM r WHERE rn = 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.dedupe_documents(ad.documents(spark, sf_dir)).select("doc_id", "project_id", "kind", "content_hash")


@query("SELECT doc_id || '.pdf' AS original_filename, CAST(doc_id AS VARCHAR) AS title, CAST(strlen(text) AS INTEGER) AS file_size, sha256(text) AS content_hash FROM documents")
def describe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.table(spark, sf_dir, "documents").select(F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.col("text").cast("binary").alias("content"))
    return workspace.describe_files(d).drop("path")


@query(f"""WITH {BLOCKS}, m AS (SELECT *, {SQUEEZE} AS t FROM blocks), h AS (SELECT *, instr(lower(t), 'thing') - 1 AS k FROM m WHERE contains(lower(t), 'thing')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, reading_order, block_id) AS rank, count(*) OVER (PARTITION BY doc_id) AS total FROM h)
SELECT doc_id, block_id, page, block_type, (CASE WHEN k > 36 THEN '…' ELSE '' END) || substring(t, greatest(0, k - 36) + 1, least(length(t), k + 61) - greatest(0, k - 36)) || (CASE WHEN k + 61 < length(t) THEN '…' ELSE '' END) AS snippet, CAST(rank AS INTEGER) AS rank, total FROM r WHERE rank <= 80""")
def search_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search_blocks(ad.blocks(spark, sf_dir), "thing")


IDX = "ix AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, reading_order, block_id) - 1 AS idx FROM blocks)"
SECTIONS = f"""{IDX}, marks AS (SELECT doc_id, idx, 'o' || block_id AS section_id FROM ix WHERE length(text) <= 60),
opening AS (SELECT doc_id, 0 AS idx, 'document-opening' AS section_id FROM ix GROUP BY doc_id HAVING doc_id NOT IN (SELECT doc_id FROM marks WHERE idx = 0)), bounds AS (FROM marks UNION ALL FROM opening),
placed AS (SELECT ix.*, b.section_id, b.idx AS section_start FROM ix ASOF JOIN bounds b ON ix.doc_id = b.doc_id AND ix.idx >= b.idx)"""


@query(f"WITH {BLOCKS}, {SECTIONS} SELECT doc_id, CAST(idx AS INTEGER) AS idx, block_id, section_id, CAST(section_start AS INTEGER) AS section_start FROM placed")
def assign_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ad.blocks(spark, sf_dir)
    return st.assign_sections(b, st.section_boundaries(ad.outline(spark, sf_dir), b)).select("doc_id", "idx", "block_id", "section_id", "section_start")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
f AS (SELECT o_custkey, o_orderkey, size, n, size AS total, 1 AS pack FROM o WHERE n = 1 UNION ALL
      SELECT o.o_custkey, o.o_orderkey, o.size, o.n, CASE WHEN f.total + o.size > 400000 THEN o.size ELSE f.total + o.size END, CASE WHEN f.total + o.size > 400000 THEN f.pack + 1 ELSE f.pack END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1)
SELECT o_custkey, o_orderkey, size, CAST(pack AS INTEGER) AS pack FROM f""")
def pack_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ad.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.floor("o_totalprice").cast("long").alias("size"))
    return st.pack_sequential(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "size", 400_000).drop("o_orderdate")


CHUNKS = f"""{SECTIONS}, sized AS (SELECT *, length('[P' || page || '#' || block_id || '] ' || text) + 1 AS size, row_number() OVER (PARTITION BY doc_id, section_start ORDER BY idx) AS n FROM placed),
f AS (SELECT doc_id, section_start, section_id, idx, page, size, n, size AS total, 1 AS pack FROM sized WHERE n = 1 UNION ALL
      SELECT s.doc_id, s.section_start, s.section_id, s.idx, s.page, s.size, s.n, CASE WHEN f.total + s.size > 10000 THEN s.size ELSE f.total + s.size END, CASE WHEN f.total + s.size > 10000 THEN f.pack + 1 ELSE f.pack END
      FROM f JOIN sized s ON s.doc_id = f.doc_id AND s.section_start = f.section_start AND s.n = f.n + 1),
chunks AS (SELECT doc_id, section_id, section_start, pack AS part, min(page) AS start_page, max(page) AS end_page, sum(size) AS character_count, count(*) AS n_blocks FROM f GROUP BY ALL)"""


@query(f"WITH RECURSIVE {BLOCKS}, {CHUNKS} SELECT doc_id, section_id, CAST(part AS INTEGER) AS part, start_page, end_page, CAST(character_count AS BIGINT) AS character_count, n_blocks FROM chunks")
def analysis_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = st.analysis_chunks(ad.blocks(spark, sf_dir), ad.outline(spark, sf_dir))
    return c.select("doc_id", "section_id", "part", "start_page", "end_page", "character_count", F.size("block_ids").cast("long").alias("n_blocks"))


@query(f"WITH RECURSIVE {BLOCKS}, {CHUNKS}, t AS (SELECT doc_id, sum(character_count - 1) AS total_chars, count(*) AS n_chunks FROM chunks GROUP BY doc_id) SELECT doc_id, CAST(total_chars AS BIGINT) AS total_chars, n_chunks, CASE WHEN total_chars <= 8000 THEN 'full_text' ELSE 'map_reduce' END AS route FROM t")
def route_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.route_by_size(st.analysis_chunks(ad.blocks(spark, sf_dir), ad.outline(spark, sf_dir)), 8_000)


@query(f"""WITH {BLOCKS}, s AS (SELECT *, {SQUEEZE} AS t FROM blocks), x AS (SELECT *, block_type = 'paragraph' AS p, length(t) <= 80 AND regexp_matches(t, '大学|学院|研究院|研究所|法院|作者|教授|博士|硕士') AS a,
  block_type = 'heading' AS h, regexp_matches(t, '[。！？!?；;：:.…][”’"』」）)]?$') AS c FROM s),
y AS (SELECT *, CASE WHEN p AND lag(p) OVER w AND NOT lag(a) OVER w AND NOT lag(h) OVER w AND NOT h AND NOT lag(c) OVER w THEN 0 ELSE 1 END AS brk FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY page, reading_order)),
z AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY page, reading_order) AS g FROM y)
SELECT doc_id, CAST(g AS BIGINT) AS "group", arg_min(block_id, reading_order) AS block_id, min(page) AS start_page, max(page) AS end_page, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM z GROUP BY doc_id, g""")
def merge_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.merged_paragraphs(ad.blocks(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long")).drop("text")


@query(f"WITH {BLOCKS}, {IDX} SELECT doc_id, CAST(idx // 8 AS INTEGER) AS batch, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS prompt, count(*) AS n_blocks FROM ix GROUP BY doc_id, idx // 8")
def pair_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.pair_batches(ad.blocks(spark, sf_dir))


@query(f"WITH {BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY reading_order) AS rn FROM blocks WHERE length(text) <= 60) SELECT doc_id, page, string_agg(text, '|' ORDER BY rn) AS hints FROM r WHERE rn <= 12 GROUP BY doc_id, page")
def outline_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.outline_hints(ad.outline(spark, sf_dir)).withColumn("hints", F.array_join("hints", "|"))


@query("""WITH u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn AS match FROM conversations WHERE role = 'assistant'),
j AS (SELECT u.conv_id, u.turn, arg_min(match, abs(match - u.turn) * 1000000 + match) AS match FROM u LEFT JOIN a USING (conv_id) GROUP BY ALL) SELECT conv_id, turn, match FROM j""")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ad.table(spark, sf_dir, "conversations")
    right = c.where("role = 'assistant'").select("conv_id", "turn", F.col("turn").alias("match"))
    return fo.nearest_match(c.where("role = 'user'").select("conv_id", "turn").distinct(), right, ["conv_id"], "turn", "match")


CITED = f"""{BLOCKS}, w AS (SELECT *, regexp_extract(text, '([A-Za-z]{{3,}})', 1) AS w, reading_order AS k FROM blocks),
cn AS (SELECT doc_id, block_id, page, k, w, CASE k % 6 WHEN 0 THEN w || '：《' || w || 'x》，载《' || w || '刊》' || (1990 + k % 30) || '年第' || (k % 12 + 1) || '期' || CASE WHEN k % 4 = 0 THEN '，第3-5页' ELSE '' END || '。' WHEN 1 THEN w || '：《T' || k || '》，' || w || '出版社' || (1990 + k % 30) || '年版' || CASE WHEN k % 4 = 1 THEN '，第7页' ELSE '' END
  WHEN 2 THEN w || '市人民法院（2020）京01民终' || k || '号民事判决书' WHEN 3 THEN '《' || w || '法》' || CASE WHEN k % 4 = 3 THEN '' ELSE '第' || k || '条' END WHEN 4 THEN '《' || w || '》, http://e.org/' || w || CASE WHEN k % 8 = 4 THEN '，访问日期：2020-01-02' ELSE '' END ELSE trim(w || ' plain') END AS n FROM w),
ty AS (SELECT *, CASE WHEN regexp_matches(n, 'https?://') THEN '网络资料' WHEN regexp_matches(n, '法院.*号') THEN '裁判文书' WHEN regexp_matches(n, '第[0-9]+条|法》') AND NOT contains(n, '载《') THEN '法律法规' WHEN contains(n, '载《') THEN '期刊论文' WHEN contains(n, '出版社') THEN '专著' ELSE '其他文献' END AS citation_type FROM cn),
need AS (SELECT * FROM (VALUES ('网络资料', '《[^》]+》', '未识别到网络资料标题'), ('网络资料', '访问日期：', '缺少访问日期'), ('法律法规', '第[0-9]+条', '缺少具体条文号'), ('期刊论文', '^[^：，]+：', '未识别到作者'), ('期刊论文', '页', '缺少引证页码'), ('专著', '^[^：，]+：', '未识别到作者'), ('专著', '页', '缺少引证页码'), ('其他文献', '^$', '无法可靠识别文献类型，已保留原文')) v(citation_type, pattern, issue)),
bad AS (SELECT t.doc_id, t.block_id, t.citation_type, need.issue FROM ty t JOIN need USING (citation_type) WHERE NOT regexp_matches(t.n, need.pattern))"""


@query(f"WITH {CITED} SELECT citation_type, NULL AS issue, count(*) AS n FROM ty GROUP BY citation_type UNION ALL SELECT citation_type, issue, count(*) FROM bad GROUP BY citation_type, issue")
def citation_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.citation_corpus_summary(ci.citations_by_document(ad.citation_notes(spark, sf_dir)))


@query(f"WITH {CITED} SELECT doc_id, count(*) AS total, count(DISTINCT b.block_id) AS needs_review FROM ty LEFT JOIN (SELECT DISTINCT doc_id, block_id FROM bad) b USING (doc_id, block_id) GROUP BY doc_id")
def citation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ci.citation_summary(ci.citations_by_document(ad.citation_notes(spark, sf_dir)))


@query(f"""WITH {CITED}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) AS i, CASE citation_type WHEN '网络资料' THEN regexp_replace(replace(n, ', http', '，http'), '，访问日期：', '，最后访问日期：') || '。' WHEN '裁判文书' THEN w || '市人民法院：（2020）京01民终' || k || '号。' WHEN '期刊论文' THEN CASE WHEN w = '' THEN substring(n, 2) ELSE n END WHEN '专著' THEN CASE WHEN w = '' THEN substring(n, 2) ELSE n END || '。' ELSE n || '。' END AS formatted FROM ty)
SELECT doc_id, string_agg(i || '. ' || formatted, chr(10) ORDER BY i) AS report FROM f GROUP BY doc_id""")
def citation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.citation_list_report(ci.citations_by_document(ad.citation_notes(spark, sf_dir)))


@query(f"""WITH {BLOCKS}, a AS (SELECT doc_id, reading_order AS k, page, substring(text, 3, 40) AS q, CASE WHEN doc_id % 3 = 1 THEN 'b0000000' ELSE block_id END AS block_id FROM blocks),
x AS (SELECT doc_id, k, page, CASE WHEN doc_id % 3 = 2 THEN chr(1) || q ELSE q END AS text, block_id FROM a),
own AS (SELECT x.*, b.text AS own_text FROM x LEFT JOIN blocks b USING (doc_id, block_id) WHERE x.text <> ''),
hit AS (SELECT o.doc_id, o.k, arg_min(b.block_id, CASE WHEN b.page <> o.page THEN 1000000000 ELSE 0 END + b.reading_order) AS hb FROM own o JOIN blocks b ON b.doc_id = o.doc_id AND contains(b.text, o.text) GROUP BY o.doc_id, o.k)
SELECT 'a' || doc_id || '-' || k AS annotation_id, CASE WHEN own_text IS NOT NULL AND contains(own_text, text) THEN 'exact' WHEN hb IS NOT NULL THEN 'recovered' ELSE 'orphaned' END AS anchor_status,
  CASE WHEN own_text IS NOT NULL AND contains(own_text, text) THEN block_id ELSE coalesce(hb, block_id) END AS block_id FROM own LEFT JOIN hit USING (doc_id, k)""")
def recover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.annotations(spark, sf_dir).where("text <> ''")
    return an.recover_anchors(a, ad.blocks(spark, sf_dir)).select("annotation_id", "anchor_status", "block_id")


@query("""WITH r AS (SELECT user_id, event_type, event_id, ts, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, (event_id % 2 = 0) DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_type, ts FROM r WHERE rn = 1""")
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return an.last_writer_wins(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "ts")


@query("SELECT user_id % 7 AS project_id, event_type AS tag, count(*) AS occurrences, count(DISTINCT user_id) AS documents, max(ts) AS last_updated FROM events GROUP BY ALL")
def project_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.project_tags(ad.tagged_events(spark, sf_dir))


@query("SELECT doc_id, tag, count(*) AS occurrences, count(DISTINCT page) AS pages FROM (SELECT user_id AS doc_id, 1 + event_id % 20 AS page, unnest(['引用卡', event_type]) AS tag FROM events) GROUP BY ALL")
def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.document_tags(ad.tagged_events(spark, sf_dir))


@query("SELECT CAST(event_id AS VARCHAR) AS annotation_id, CASE WHEN user_id % 7 = 3 AND event_type = 'click' THEN 'press' ELSE event_type END AS tag, user_id % 7 = 3 AND event_type = 'click' AS affected FROM events")
def edit_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.edit_tags(ad.tagged_events(spark, sf_dir), 3, "rename", "click", "press").select("annotation_id", F.array_join("tags", "|").alias("tag"), "affected")


@query("""WITH t AS (SELECT user_id % 7 AS project_id, event_type AS tag, min(struct_pack(ts := ts, i := CAST(event_id AS VARCHAR))) AS o FROM events GROUP BY ALL), c AS (SELECT l.doc_id % 7 AS project_id, t.tag, min(CAST(l.doc_id AS VARCHAR)) AS i FROM labels l JOIN documents d USING (doc_id), (VALUES (0, 't'), (1, 'click')) t(q, tag) WHERE t.q = 0 OR l.quality = 1 GROUP BY ALL),
u AS (SELECT project_id, tag, 1 AS s, o.ts AS ts, o.i AS i FROM t UNION ALL SELECT DISTINCT project_id, d.tag, 0, NULL, d.i FROM t, (VALUES ('重要', '0'), ('待查', '1')) d(tag, i) UNION ALL SELECT project_id, tag, 2, TIMESTAMP '2024-01-01', i FROM c),
f AS (SELECT project_id, tag, min(struct_pack(s := s, ts := coalesce(ts, TIMESTAMP '1900-01-01'), i := i)) AS o FROM u GROUP BY ALL), r AS (SELECT project_id, tag, row_number() OVER (PARTITION BY project_id ORDER BY o, tag) AS rank FROM f) SELECT project_id, tag, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def suggest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ad.tagged_events(spark, sf_dir)
    c = ad.cards(spark, sf_dir).select((F.col("doc_id") % 7).alias("project_id"), F.when(F.col("verify_status") == "已核验", F.concat("tags", F.array(F.lit("click")))).otherwise(F.col("tags")).alias("tags"), "updated_at", "card_id")
    return an.suggest_tags(["重要", "待查"], a, c, a.select("project_id").distinct())


@query(f"""WITH {BLOCKS}, b AS (SELECT doc_id, block_id, length(text) AS n FROM blocks), r AS (SELECT doc_id, block_id, 'x' AS annotation_id, 1 AS ord, 0 AS s, n // 2 AS e FROM b UNION ALL SELECT doc_id, block_id, 'y', 2, n // 4, n FROM b), m AS (SELECT doc_id, block_id, n // 3 AS s, least(n, n // 3 + 2) AS e FROM b),
c AS (SELECT DISTINCT doc_id, block_id, unnest([0, n // 4, n // 2, n, n // 3, least(n, n // 3 + 2)]) AS k FROM b), p AS (SELECT doc_id, block_id, k, lead(k) OVER (PARTITION BY doc_id, block_id ORDER BY k) AS k2 FROM c),
q AS (SELECT p.doc_id, p.block_id, p.k, p.k2, arg_min(r.annotation_id, r.ord) AS annotation_id FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.block_id = p.block_id AND r.s <= p.k AND r.e >= p.k2 WHERE p.k2 IS NOT NULL GROUP BY ALL)
SELECT q.doc_id, q.block_id, CAST(k AS INTEGER) AS start_offset, CAST(k2 AS INTEGER) AS end_offset, annotation_id, CASE WHEN m.s IS NOT NULL THEN 'm' END AS ref FROM q LEFT JOIN m ON m.doc_id = q.doc_id AND m.block_id = q.block_id AND m.s <= k AND m.e >= k2""")
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranges and a reference in every block."""
    b = ad.blocks(spark, sf_dir)
    n = F.length("text")
    one = lambda name, o, s, e: b.select("doc_id", "block_id", F.lit(name).alias("annotation_id"), F.lit(o).alias("ord"), s.cast("int").alias("start_offset"), e.cast("int").alias("end_offset"))
    r = one("x", 1, F.lit(0), F.floor(n / 2)).unionByName(one("y", 2, F.floor(n / 4), n))
    refs = one("m", 0, F.floor(n / 3), F.least(n, F.floor(n / 3) + 2)).withColumnRenamed("annotation_id", "marker").drop("ord")
    return an.split_ranges(r, refs, b)


@query(f"""WITH {DOCS}, {NODES}, w AS (SELECT *, [8, 20, 35, 48, 62, 72, 5][doc_id % 7 + 1] AS weight FROM docs WHERE NOT archived), b AS (SELECT project_id, avg(weight) + avg(current_page / page_count) * 12 AS base FROM w GROUP BY 1),
e AS (SELECT project_id, avg(CASE WHEN ok THEN 1 ELSE 0 END) * 12 AS ev FROM (SELECT doc_id, anchored AND user_status = 'understood' AS ok FROM nodes UNION ALL SELECT doc_id, anchored AND status = '已完成' FROM issues) JOIN w USING (doc_id) GROUP BY 1),
c AS (SELECT k.project_id, avg(CASE WHEN anchored AND verify_status = '已核验' THEN 1 ELSE 0 END) * 4 AS q FROM cards k JOIN w USING (doc_id, project_id) GROUP BY 1)
SELECT project_id, CAST(least(100, floor(base + coalesce(ev, 0) + coalesce(q, 0) + 0.5)) AS INTEGER) AS progress FROM b LEFT JOIN e USING (project_id) LEFT JOIN c USING (project_id)""")
def project_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.project_progress(*(f(spark, sf_dir) for f in (ad.documents, ad.nodes, ad.issues, ad.cards)))


@query(f"""WITH {DOCS}, {NODES}, a AS (SELECT doc_id FROM docs WHERE NOT archived)
SELECT 'paper-' || doc_id || '-' || node_id AS task_id, 'paper' AS kind, CASE WHEN NOT anchored THEN '缺少依据' WHEN user_status = 'doubt' THEN '存疑' ELSE '待读取' END AS label, CASE WHEN user_status = 'doubt' THEN 1 ELSE 4 END AS rank FROM nodes JOIN a USING (doc_id) WHERE NOT anchored OR user_status IN ('doubt', 'unread')
UNION ALL SELECT 'judgment-' || doc_id || '-' || issue_id, 'judgment', CASE WHEN NOT anchored THEN '缺少依据' ELSE status END, CASE WHEN status = '进行中' THEN 2 ELSE 5 END FROM issues JOIN a USING (doc_id) WHERE NOT anchored OR status <> '已完成'
UNION ALL SELECT 'card-' || card_id, 'card', verify_status, 3 FROM cards JOIN a USING (doc_id) WHERE verify_status <> '已核验'""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.review_queue(*(f(spark, sf_dir) for f in (ad.documents, ad.nodes, ad.issues, ad.cards))).select("task_id", "kind", "label", "rank")


@query(f"WITH {DOCS}, {NODES} SELECT 'card:' || card_id AS row_key, project_id, m_page AS page, issue, stance, CASE WHEN type = '规范卡' THEN '规范依据' ELSE '用户摘录' END AS evidence_type, verify_status = '已核验' AS verified FROM (SELECT * EXCLUDE (project_id), source AS project_id FROM matrix)")
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.matrix_rows(*(f(spark, sf_dir) for f in (ad.cards, ad.documents, ad.entries))).select("row_key", "project_id", "page", "issue", "stance", "evidence_type", "verified")


@query(f"WITH {DOCS}, {NODES} SELECT source AS project_id, count(*) AS rows, count(*) FILTER (verify_status = '已核验') AS verified, count(*) FILTER (stance IN ('反对', '条件性')) AS conflicts, count(DISTINCT issue) AS issues FROM matrix GROUP BY source")
def matrix_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.matrix_kpis(re_.matrix_rows(*(f(spark, sf_dir) for f in (ad.cards, ad.documents, ad.entries))))


@query(f"""WITH {DOCS}, {NODES}, d AS (SELECT project_id, count(*) FILTER (kind = 'paper') AS papers, count(*) FILTER (kind = 'judgment') AS judgments, count(*) AS readable FROM docs WHERE NOT archived GROUP BY 1),
c AS (SELECT project_id, count(*) AS cards, count(*) FILTER (verify_status <> '已核验') AS pending_cards FROM cards GROUP BY 1)
SELECT coalesce(d.project_id, c.project_id) AS project_id, coalesce(papers, 0) AS papers, coalesce(judgments, 0) AS judgments, coalesce(readable, 0) AS readable, 0 AS processing, coalesce(cards, 0) AS cards, coalesce(pending_cards, 0) AS pending_cards FROM d FULL JOIN c USING (project_id)""")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.library_counts(re_.derive_lifecycle(ad.documents(spark, sf_dir)), ad.cards(spark, sf_dir))


@query(f"""WITH {DOCS}, {NODES}, h AS (SELECT doc_id FROM nodes UNION SELECT doc_id FROM issues), d AS (SELECT project_id, count(*) AS analyzed_documents FROM docs WHERE status = 'ready' AND doc_id IN (SELECT doc_id FROM h) GROUP BY 1),
c AS (SELECT project_id, count(*) AS cards, count(*) FILTER (verify_status = '已核验') AS verified FROM cards GROUP BY 1)
SELECT coalesce(d.project_id, c.project_id) AS project_id, coalesce(analyzed_documents, 0) AS analyzed_documents, coalesce(cards, 0) AS cards, coalesce(verified, 0) AS verified, CAST(CASE WHEN cards > 0 THEN floor(100 * verified / cards + 0.5) ELSE 0 END AS INTEGER) AS verified_percent FROM d FULL JOIN c USING (project_id)""")
def results_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.results_kpis(*(f(spark, sf_dir) for f in (ad.documents, ad.nodes, ad.issues, ad.cards)))


@query(f"WITH {DOCS}, {NODES} SELECT doc_id, CASE WHEN anchored AND status = '已完成' THEN 1 ELSE 0 END AS done, 1 AS total, CAST(CASE WHEN anchored AND status = '已完成' THEN 1 ELSE 0 END AS DOUBLE) AS share FROM issues")
def judgment_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.judgment_progress(ad.issues(spark, sf_dir))


@query(f"WITH {DOCS} SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN 'running' ELSE 'completed' END AS ocr_status, 'readable' AS reading_status, CASE WHEN doc_id % 7 = 4 THEN 'running' WHEN has_analysis THEN 'completed' ELSE 'idle' END AS analysis_status FROM docs WHERE NOT archived")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.active_documents(re_.derive_lifecycle(ad.documents(spark, sf_dir))).select("doc_id", "ocr_status", "reading_status", "analysis_status")


@query(f"WITH {DOCS} SELECT project_id, max(doc_id) AS doc_id FROM docs WHERE kind = 'paper' GROUP BY 1")
def latest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.latest_document(ad.documents(spark, sf_dir), "paper")


JOBS = """SELECT user_id AS job_id, count(*) FILTER (event_id % 5 <> 0) AS completed, count(*) FILTER (event_id % 5 = 0) AS failed, CAST(coalesce(sum(CASE WHEN event_id % 5 <> 0 THEN floor(value) END), 0) AS BIGINT) AS generated_characters, count(*) AS processed"""


@query(f"SELECT *, processed AS total, 100 AS progress, CASE WHEN completed = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM ({JOBS} FROM events GROUP BY user_id)")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jo.job_rollup(ad.page_results(ad.table(spark, sf_dir, "events")))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = ad.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"{JOBS} FROM events GROUP BY user_id")
def stream_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stored table is one micro-batch, and only earlier batches make a row late
    s = streams.job_progress_stream(ad.page_results(_event_stream(spark, sf_dir)))
    return streams.run_available(s, "complete", streams.new_checkpoint(spark, "jobs"))


LATE = """e AS (SELECT *, event_id % 4 AS b FROM events), m AS (SELECT b, max(ts) AS t FROM e GROUP BY b), z AS (SELECT e.*, (SELECT date_trunc('milliseconds', max(t)) FROM m WHERE m.b <= e.b - 2) - INTERVAL 10 DAY AS w FROM e)"""


def _late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in four batches, each over the whole time: a file each, written one after the other."""
    e = ad.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = streams.new_checkpoint(spark, "batches")
    for k in range(4):
        e.where(F.col("event_id") % 4 == k).coalesce(1).write.parquet(f"{path}/p{k}")
    return ad.page_results(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*"))


@query(f"WITH {LATE} SELECT user_id AS job_id, event_id AS page, b AS batch FROM z WHERE ts <= w")
def late_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = streams.new_checkpoint(spark, "late")
    return streams.late_rows(_late_stream(spark, sf_dir), path, f"{path}-at", "10 days").select("job_id", "page", "batch")


@query(f"WITH {LATE} {JOBS} FROM z WHERE w IS NULL OR ts > w GROUP BY user_id")
def job_progress_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streams.job_progress_stream(_late_stream(spark, sf_dir), "10 days")
    return streams.run_available(s, "complete", streams.new_checkpoint(spark, "jobs"))


@query("SELECT user_id AS doc_id, arg_max(1 + event_id % 20, struct_pack(t := ts, p := 1 + event_id % 20)) AS page, max(ts) AS ts FROM events GROUP BY user_id")
def stream_reading_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _event_stream(spark, sf_dir).select(F.col("user_id").alias("doc_id"), (1 + F.col("event_id") % 20).alias("page"), "ts")
    return streams.run_available(streams.reading_position_stream(e), "complete", streams.new_checkpoint(spark, "positions"))


@query("WITH m AS (SELECT user_id AS doc_id, arg_max(1 + event_id % 20, struct_pack(t := ts, p := 1 + event_id % 20)) AS page FROM events GROUP BY user_id) SELECT doc_id, greatest(1, least(1 + n_chars // 1000, page)) AS current_page FROM documents JOIN m USING (doc_id)")
def reading_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (1 + F.col("event_id") % 20).alias("page"), "ts")
    return re_.reading_position(e, ad.documents(spark, sf_dir))


@query("WITH r AS (SELECT user_id AS doc_id, event_id AS page, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT doc_id, page, ts FROM r WHERE rn <= 10")
def ocr_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pa.ocr_history(ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page"), "ts"), 10)


@query(f"WITH {DOCS}, x AS (SELECT doc_id, page_count, unnest(CASE WHEN doc_id % 2 = 0 THEN range(1, page_count + 1) ELSE [3, 1, 1, 999] END) AS page, doc_id % 2 = 0 AS every FROM docs) SELECT DISTINCT doc_id, CAST(page AS INTEGER) AS page FROM x WHERE page <= page_count AND (NOT every OR page <= 120)")
def pages_to_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ad.documents(spark, sf_dir)
    req = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "all").otherwise("pages").alias("scope"), F.array(*map(F.lit, [3, 1, 1, 999])).alias("pages"))
    return pa.pages_to_ocr(d, req)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", F.col("o_orderdate").alias("updated_at"))
    c = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"), F.lit(None).cast("long").alias("o_custkey"), "updated_at")
    return re_.apply_changes(o, c, ["o_orderkey"], "overlay").drop("updated_at")


def _responses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A map response of each document: one node that names its first block and one that is not there; every fourth is fenced, every tenth cut off."""
    b = ad.blocks(spark, sf_dir)
    chunks = b.groupBy("doc_id").agg(F.sort_array(F.collect_list("block_id")).alias("block_ids")).withColumn("chunk_id", F.lit("c1")).withColumn("ord", F.lit(1))
    node = F.concat(F.lit('{"nodes": [{"title": "T'), F.col("doc_id").cast("string"), F.lit('", "summary": "s", "confidence": 120, "sourceBlockIds": ["'), F.get("block_ids", F.lit(0)), F.lit('", "nowhere"]}, {"title": "empty", "sourceBlockIds": ["nowhere"]}]}'))
    raw = F.when(F.col("doc_id") % 10 == 0, F.substring(node, 1, 40)).when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```json\n"), node, F.lit("\n```"))).otherwise(node)
    return rs.parse_json_lenient(chunks.select("doc_id", "chunk_id", F.lit("map").alias("stage"), raw.alias("raw")), rs.PAPER_RESPONSE), chunks


@query(f"WITH {BLOCKS}, f AS (SELECT doc_id, min(block_id) AS b FROM blocks GROUP BY doc_id) SELECT doc_id, 'c1-node-1' AS candidate_id, 'T' || doc_id AS title, '论证展开' AS role, 's' AS summary, b AS ids, CAST(100 AS DOUBLE) AS confidence_pct FROM f WHERE doc_id % 10 <> 0")
def validate_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, chunks = _responses(spark, sf_dir)
    return rs.normalize_map_nodes(parsed, chunks).select("doc_id", "candidate_id", "title", "role", "summary", F.array_join("block_ids", "|").alias("ids"), "confidence_pct")


@query(f"WITH {BLOCKS} SELECT DISTINCT doc_id, 'not valid JSON' AS parse_error FROM blocks WHERE doc_id % 10 = 0")
def response_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.dead_letters(_responses(spark, sf_dir)[0]).select("doc_id", "parse_error")


@query("SELECT user_id AS doc_id, count(*) AS requests, CAST(sum(event_id % 100) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 10) AS BIGINT) AS completion_tokens, CAST(sum(event_id % 100 + event_id % 10) AS BIGINT) AS total_tokens FROM events GROUP BY user_id")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return rs.token_usage(ad.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.struct((i % 100).alias("prompt_tokens"), (i % 10).alias("completion_tokens"), (i % 100 + i % 10).alias("total_tokens")).alias("usage")))


@query(f"""WITH RECURSIVE {BLOCKS}, {CHUNKS}, c AS (SELECT doc_id, character_count - n_blocks AS with_prefix, character_count, n_blocks, section_start, part, (section_start + part) % 4 <> 0 AS ok FROM chunks),
p AS (SELECT f.doc_id, f.section_start, f.pack AS part, sum(f.size - 1 - length('[P' || f.page || '#b0000000] ')) AS plain FROM f GROUP BY ALL)
SELECT doc_id, CAST(sum(plain) AS BIGINT) AS source_characters, CAST(sum(CASE WHEN ok THEN plain ELSE 0 END) AS BIGINT) AS analyzed_characters, count(*) AS total_sections, count(*) FILTER (ok) AS analyzed_sections, count(*) FILTER (NOT ok) AS failed_chunks,
  round(least(1.0, coalesce(sum(CASE WHEN ok THEN character_count - 1 END), 0) / greatest(1, sum(plain))), 6) AS text_coverage, round(coalesce(sum(CASE WHEN ok THEN plain END), 0) / greatest(1, sum(plain)), 6) AS true_coverage, CAST(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0) THEN length('Node ' || doc_id) + 7 ELSE 0 END AS BIGINT) AS generated_characters, CAST(sum(n_blocks) AS BIGINT) AS cited_blocks FROM c JOIN p USING (doc_id, section_start, part) GROUP BY doc_id""")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ad.blocks(spark, sf_dir)
    chunks = written(st.analysis_chunks(b, ad.outline(spark, sf_dir)), "chunks")
    idx = st.indexed_blocks(b).select("doc_id", F.col("block_id").alias("first_block"), "idx")
    starts = chunks.select("doc_id", "chunk_id", "section_id", "part", F.element_at("block_ids", 1).alias("first_block")).join(idx, ["doc_id", "first_block"])
    begin = starts.where("part = 1").select("doc_id", "section_id", F.col("idx").alias("section_start"))
    r = starts.join(begin, ["doc_id", "section_id"]).select("doc_id", "chunk_id", ((F.col("section_start") + F.col("part")) % 4 != 0).alias("ok"))
    cited = b.select("doc_id", "block_id")
    nodes = ad.nodes(spark, sf_dir).withColumn("reasons", F.lit(None).cast("array<string>"))
    none = spark.createDataFrame([], "doc_id long, title string, legal_question string, summary string, approach string, framework array<string>")
    said = rs.generated_characters(spark.createDataFrame([], f"doc_id long, stage string, parsed {rs.struct_of(rs.PAPER_RESPONSE)}"), nodes, none)
    m = rs.coverage_metrics(chunks, r, cited.unionByName(cited), said)
    return m.select("doc_id", "source_characters", "analyzed_characters", "total_sections", "analyzed_sections", "failed_chunks", F.round("text_coverage", 6).alias("text_coverage"), F.round("true_coverage", 6).alias("true_coverage"), "generated_characters", "cited_blocks")


@query("""WITH RECURSIVE i AS (SELECT l_orderkey AS doc_id, l_linenumber AS item_no, l_returnflag AS t, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice % 50 AS DOUBLE) AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_extendedprice % 50 AS DOUBLE) DESC, CAST(l_quantity AS DOUBLE), l_linenumber, l_returnflag) AS n FROM lineitem),
f AS (SELECT doc_id, n, [y] AS rows, [1] AS places FROM i WHERE n = 1 UNION ALL SELECT doc_id, n, CASE WHEN k > 0 THEN list_transform(rows, lambda q, j: CASE WHEN j = k THEN (q + y) / 2 ELSE q END) ELSE list_append(rows, y) END, list_append(places, CASE WHEN k > 0 THEN k ELSE len(rows) + 1 END)
  FROM (SELECT i.doc_id, i.n, i.y, f.rows, f.places, coalesce(list_position(list_transform(f.rows, lambda q: abs(q - i.y) <= 2.8), true), 0) AS k FROM f JOIN i ON i.doc_id = f.doc_id AND i.n = f.n + 1)),
z AS (SELECT f.* FROM f JOIN (SELECT doc_id, max(n) AS n FROM i GROUP BY 1) USING (doc_id, n)), p AS (SELECT i.*, z.places[i.n] AS line, z.rows[z.places[i.n]] AS row_y FROM i JOIN z USING (doc_id)),
l AS (SELECT doc_id, line, row_y, string_agg(t, ' ' ORDER BY x, item_no, t) AS text, min(x) AS x, max(x) + 10 - min(x) AS w FROM p GROUP BY doc_id, line, row_y)
SELECT doc_id, 'b-1-' || row_number() OVER (PARTITION BY doc_id ORDER BY row_y DESC, line) AS block_id, text, round(x, 2) AS x, round(w, 2) AS w FROM l""")
def group_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as positioned runs: an order is a page."""
    runs = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("item_no"), F.col("l_returnflag").alias("str"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") % 50).cast("double").alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"), F.lit(10.0).alias("font_size"))
    return pa.group_lines(runs).select("doc_id", "block_id", "text", F.get("bbox", F.lit(0)).alias("x"), F.get("bbox", F.lit(2)).alias("w"))


from quire.plans import queries_anchors, queries_evidence, queries_responses  # noqa: E402, F401  (each registers its queries)
