"""Registered queries on model responses: what models said of each document, built from its blocks.

A page is a chunk. Its map response names its blocks in turn, with fields left out, ids that are not there and
lists that are too long, by place; the reduce response names candidates. SQL computes what must come out of
them from the blocks themselves and parses no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import responses as rs
from quire.plans import adapters as ad
from quire.plans.queries import SQL, BLOCKS, query
from quire.shared import discard, stored, written


def _chunks(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """The pages of documents; without their texts, ids alone are shuffled."""
    b = ad.blocks(spark, sf_dir)
    g = b.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("reading_order", "block_id", *["text"] * texts))).alias("lines"))
    return g.select(
        "doc_id", F.concat(F.lit("section-part-"), F.col("page").cast("string")).alias("chunk_id"), F.concat(F.lit("s"), F.floor((F.col("page") - 1) / 2).cast("string")).alias("section_id"), F.concat(F.lit("Part "), F.col("page").cast("string")).alias("title"),
        F.col("page").alias("start_page"), F.col("page").alias("end_page"), F.col("page").alias("ord"), F.transform("lines", lambda x: x["block_id"]).alias("block_ids"), *[F.transform("lines", lambda x: x["text"]).alias("texts")] * texts,
    )


def _unless(test: Column, value) -> Column:
    return F.when(~test, value if isinstance(value, Column) else F.lit(value))


def _raw(rows: DataFrame, stage: str, **fields: Column) -> DataFrame:
    """One JSON text a row; every fifth is fenced, every seventh has words around it."""
    text = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    d = F.col("doc_id")
    raw = F.when(d % 5 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(d % 7 == 0, F.concat(F.lit("Here: "), text, F.lit(" end"))).otherwise(text)
    return rows.select("doc_id", F.lit(stage).alias("stage"), "chunk_id", raw.alias("raw"))


def _paper(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed responses, chunks and blocks. Chunks and responses are made once, as all that follows reads them several times."""
    chunks, chunks_at = stored(_chunks(spark, sf_dir), "chunks")
    p = F.col("ord")

    def node(text: Column, k: Column) -> Column:
        ids = F.when(k % 4 == 3, F.array(F.lit("nowhere"))).otherwise(F.array(F.get("block_ids", k), F.lit("nowhere")))
        return F.struct(
            _unless(k % 3 == 1, text).alias("title"), _unless(k % 2 == 0, F.concat(F.lit("role "), text)).alias("role"), _unless(k % 5 == 3, text).alias("summary"), F.split(text, " ").alias("reasons"), ids.alias("sourceBlockIds"), _unless(k % 3 == 0, F.length(text) - 20.0).alias("confidence")
        )

    reading = F.struct(F.concat(F.lit("q"), p.cast("string")).alias("legalQuestion"), _unless(p % 2 == 0, F.concat(F.lit("own "), p.cast("string"))).alias("summary"), F.array(F.concat(F.lit("f"), (p % 3).cast("string")), F.lit(" "), F.lit(" g ")).alias("framework"), F.when(p % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.element_at("block_ids", -1), F.lit("nowhere"))).alias("sourceBlockIds"))
    maps = _raw(chunks, "map", sectionSummary=F.concat(F.lit("sum "), p.cast("string")), sectionAnalysis=reading, nodes=F.transform("texts", node), warnings=F.array(F.concat(F.lit("w"), (p % 3).cast("string")), F.lit(" ")))
    docs = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("p"), F.get("block_ids", F.lit(0)).alias("b")))).alias("parts")).withColumn("chunk_id", F.lit("reduce"))

    def final(x: Column) -> Column:
        q = x["p"]
        name = lambda n: F.concat(F.lit("section-part-"), q.cast("string"), F.lit(f"-node-{n}"))
        return F.struct(F.array(name(1), name(2), F.lit("unknown")).alias("candidateIds"), _unless(q % 2 == 0, F.concat(F.lit("Final "), q.cast("string"))).alias("title"), _unless(q % 3 == 0, F.concat(F.lit("S "), q.cast("string"))).alias("summary"), F.when(q % 2 == 0, F.array(F.lit("r1"), F.lit("r2"))).alias("reasons"), F.array(F.lit("nowhere"), x["b"]).alias("sourceBlockIds"), F.when(q % 2 == 1, 55.0).alias("confidence"))

    odd = F.filter("parts", lambda x: x["p"] % 2 == 1)
    section = lambda x: F.struct(F.concat(F.lit("s"), F.floor((x["p"] - 1) / 2).cast("string")).alias("sectionId"), F.when(x["p"] % 4 == 3, F.concat(F.lit("Sec "), x["p"].cast("string"))).alias("title"), F.when(x["p"] % 4 == 3, F.concat(F.lit("Given "), x["p"].cast("string"))).alias("summary"))
    d = F.col("doc_id")
    whole = F.struct(_unless(d % 2 == 0, F.concat(F.lit("D"), d.cast("string"))).alias("summary"), F.when(d % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("nowhere"), F.element_at("parts", -1)["b"])).alias("sourceBlockIds"))
    nodes = F.transform(F.filter("parts", lambda x: d % 3 != 0), final)
    reduced = _raw(docs, "reduce", nodes=nodes, sectionAnalyses=F.transform(odd, section), documentAnalysis=whole, documentSummary=F.struct(F.concat(F.lit("C"), d.cast("string")).alias("coreConclusion"), F.lit("Q").alias("coreQuestion")), warnings=F.array(F.lit("w1"), F.lit("last")))
    b = ad.blocks(spark, sf_dir).withColumn("bbox", F.lit(None).cast("array<double>"))
    parsed = written(rs.parse_json_lenient(maps.unionByName(reduced), rs.PAPER_RESPONSE).drop("raw"), "responses")
    return parsed, _without_texts(chunks, chunks_at), b


def _without_texts(chunks: DataFrame, at: str) -> DataFrame:
    """The chunks' ids and places once responses are made; their texts go."""
    kept = written(chunks.drop("texts"), "chunk-ids")
    discard(chunks.sparkSession, at)
    return kept


def _ids_only(blocks: DataFrame) -> DataFrame:
    """Blocks for anchors of which only ids and pages are read."""
    return blocks.select("doc_id", "block_id", "page")


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    parsed, chunks, b = _paper(spark, sf_dir)
    return parsed, chunks, b, rs.normalize_map_nodes(parsed.where("stage = 'map'"), chunks)


def _ids(c: str = "source_anchors") -> Column:
    return F.array_join(F.transform(c, lambda x: x["block_id"]), "|")


PLACED = f"{BLOCKS}, pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY reading_order) - 1 AS k, count(*) OVER (PARTITION BY doc_id, page) AS n, first_value(block_id) OVER (PARTITION BY doc_id, page ORDER BY reading_order) AS first_id FROM blocks)"
CAND = f"""{PLACED}, cand AS (SELECT doc_id, page, k, CASE WHEN k % 3 = 1 THEN '章节节点 ' || (k + 1) ELSE left(text, 100) END AS title, CASE WHEN k % 2 = 0 THEN '论证展开' ELSE left('role ' || text, 40) END AS role,
  CASE WHEN k % 5 = 3 THEN '' ELSE left(text, 1600) END AS summary, string_split(text, ' ')[1:8] AS reasons, CASE WHEN k % 4 = 3 THEN '' ELSE block_id END AS ids,
  CAST(CASE WHEN k % 3 = 0 THEN 70 ELSE greatest(0, least(100, length(text) - 20)) END AS DOUBLE) AS confidence_pct FROM pl WHERE k < 7 AND (k % 5 <> 3 OR k % 4 <> 3))"""


@query(f"WITH {CAND} SELECT doc_id, 'section-part-' || page || '-node-' || (k + 1) AS candidate_id, title, role, '作者观点' AS attribution, summary, array_to_string(reasons, '|') AS reasons, ids, confidence_pct FROM cand")
def normalize_map_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)[3]
    return c.select("doc_id", "candidate_id", "title", "role", "attribution", "summary", F.array_join("reasons", "|").alias("reasons"), F.array_join("block_ids", "|").alias("ids"), "confidence_pct")


@query(f"""WITH {CAND}, pg AS (SELECT doc_id, page, first_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS ord FROM pl WHERE k = 0),
own AS (SELECT p.doc_id, p.ord, CASE WHEN p.page % 2 = 1 THEN 'Final ' || p.page ELSE left(a.title, 80) END AS title, left(a.role, 40) AS role, CASE WHEN p.page % 3 <> 0 THEN 'S ' || p.page ELSE left(a.summary || coalesce('；' || b.summary, ''), 1800) END AS summary,
  CASE WHEN p.page % 2 = 0 THEN 'r1|r2' ELSE array_to_string(list_concat(a.reasons, coalesce(b.reasons, []))[1:8], '|') END AS reasons, CASE WHEN p.page % 2 = 1 THEN 55.0 ELSE a.confidence_pct END AS confidence_pct, p.first_id || coalesce('|' || b.ids, '') AS ids
  FROM pg p JOIN cand a ON a.doc_id = p.doc_id AND a.page = p.page AND a.k = 0 LEFT JOIN cand b ON b.doc_id = p.doc_id AND b.page = p.page AND b.k = 1 WHERE p.doc_id % 3 <> 0 AND p.ord < 16),
spare AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS ord FROM cand WHERE doc_id % 3 = 0)
SELECT doc_id, 'ai-node-' || (ord + 1) AS node_id, title, role, summary, reasons, confidence_pct, ids, 'ai_summary' AS source_type FROM own
UNION ALL SELECT doc_id, 'ai-node-' || (ord + 1), left(title, 80), role, summary, array_to_string(reasons, '|'), confidence_pct, ids, CASE WHEN ids <> '' THEN 'ai_summary' ELSE 'ai_inference' END FROM spare WHERE ord < 12""")
def synthesize_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, _, b, c = _candidates(spark, sf_dir)
    return rs.synthesize_nodes(parsed, c, _ids_only(b)).select("doc_id", "node_id", "title", "role", "summary", F.array_join("reasons", "|").alias("reasons"), "confidence_pct", _ids().alias("ids"), "source_type")


READ = f"""{PLACED}, rd AS (SELECT doc_id, page, 's' || ((page - 1) // 2) AS section_id, 'q' || page AS question, CASE WHEN page % 2 = 0 THEN 'sum ' || page ELSE 'own ' || page END AS summary, ['f' || (page % 3), 'g'] AS framework,
  CASE WHEN page % 3 = 0 THEN list_slice(list(block_id ORDER BY reading_order) FILTER (block_type = 'paragraph'), 1, 20) ELSE [max(block_id)] END AS ids FROM pl GROUP BY doc_id, page)"""


@query(f"WITH {READ} SELECT doc_id, 'section-part-' || page AS chunk_id, section_id, question AS legal_question, summary, '' AS approach, array_to_string(framework, '|') AS framework, coalesce(array_to_string(ids, '|'), '') AS ids FROM rd")
def chunk_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, chunks, b = _paper(spark, sf_dir)
    r = rs.normalize_chunk_reading(parsed.where("stage = 'map'"), chunks, b)
    return r.select("doc_id", "chunk_id", "section_id", "legal_question", "summary", "approach", F.array_join("framework", "|").alias("framework"), F.array_join("block_ids", "|").alias("ids"))


SECTION_ROWS = f"""{READ}, sec AS (SELECT doc_id, section_id, min(page) AS page, string_agg(question, '；' ORDER BY page) AS question, string_agg(summary, '；' ORDER BY page) AS summary, list_distinct(flatten(list(framework))) AS framework, flatten(list(coalesce(ids, []) ORDER BY page)) AS ids, bool_or(page % 4 = 3) AS given, max(CASE WHEN page % 4 = 3 THEN page END) AS given_page FROM rd GROUP BY doc_id, section_id)"""


@query(f"""WITH {SECTION_ROWS} SELECT doc_id, section_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS INTEGER) AS ord, CASE WHEN given THEN 'Sec ' || given_page ELSE 'Part ' || page END AS title, question AS legal_question, CASE WHEN given THEN 'Given ' || given_page ELSE summary END AS summary,
  array_to_string(list_sort(framework), '|') AS framework, array_to_string(ids[1:80], '|') AS ids, CAST(76 AS DOUBLE) AS confidence_pct FROM sec""")
def synthesize_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, chunks, b = _paper(spark, sf_dir)
    s = rs.synthesize_sections(rs.normalize_chunk_reading(parsed.where("stage = 'map'"), chunks, b), parsed, b)
    return s.select("doc_id", "section_id", "ord", "title", "legal_question", "summary", F.array_join(F.sort_array("framework"), "|").alias("framework"), _ids().alias("ids"), "confidence_pct")


@query(f"""WITH {SECTION_ROWS}, two AS (SELECT doc_id, flatten(list(ids[1:2] ORDER BY page))[1:40] AS ids FROM sec GROUP BY doc_id), lastp AS (SELECT doc_id, max_by(first_id, page) AS last_first FROM pl WHERE k = 0 GROUP BY doc_id)
SELECT doc_id, 'Document ' || doc_id AS title, 'Q' AS legal_question, CASE WHEN doc_id % 2 = 0 THEN 'C' || doc_id ELSE 'D' || doc_id END AS summary, 'Q' AS core_question, 'C' || doc_id AS core_conclusion, '待确认' AS paradigm, CASE WHEN doc_id % 4 = 0 THEN array_to_string(ids, '|') ELSE last_first END AS ids, CAST(78 AS DOUBLE) AS confidence_pct FROM two JOIN lastp USING (doc_id)""")
def document_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, chunks, b = _paper(spark, sf_dir)
    s = rs.synthesize_sections(rs.normalize_chunk_reading(parsed.where("stage = 'map'"), chunks, b), parsed, b)
    r = rs.document_reading(parsed, s, b, ad.documents(spark, sf_dir))
    return r.select("doc_id", "title", "legal_question", "summary", "core_question", "core_conclusion", "paradigm", _ids().alias("ids"), "confidence_pct")


@query(f"""WITH {PLACED}, pg AS (SELECT DISTINCT doc_id, page FROM pl), x AS (SELECT doc_id, page * 10 AS o, 'w' || (page % 3) AS w FROM pg UNION ALL SELECT doc_id, page * 10 + 1, ' ' FROM pg UNION ALL SELECT DISTINCT doc_id, 1000000000, 'w1' FROM pg UNION ALL SELECT DISTINCT doc_id, 1000000001, 'last' FROM pg),
f AS (SELECT doc_id, w, min(o) AS o FROM x GROUP BY ALL) SELECT doc_id, string_agg(w, '|' ORDER BY o) AS warnings FROM f GROUP BY doc_id""")
def merge_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, chunks, _ = _paper(spark, sf_dir)
    return rs.merge_warnings(parsed, chunks).select("doc_id", F.array_join("warnings", "|").alias("warnings"))


_NODES_JOINED = SQL["synthesize_nodes"].replace("'|')", "'')").replace("'r1|r2'", "'r1r2'")
_SECTIONS_JOINED = SQL["synthesize_sections"].replace("'|')", "'')")


@query(f"""WITH a AS (SELECT doc_id, sum(length(title) + length(summary) + length(reasons)) AS n FROM ({_NODES_JOINED}) GROUP BY doc_id), b AS (SELECT doc_id, sum(length(title) + length(legal_question) + length(summary) + length(framework)) AS n FROM ({_SECTIONS_JOINED}) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a.n, 0) + b.n + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE length('D' || doc_id) END + length('C' || doc_id) + 1 AS BIGINT) AS generated_characters FROM b LEFT JOIN a USING (doc_id)""")
def generated_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, chunks, b, c = _candidates(spark, sf_dir)
    sections = rs.synthesize_sections(rs.normalize_chunk_reading(parsed.where("stage = 'map'"), chunks, b), parsed, b)
    return rs.generated_characters(parsed, rs.synthesize_nodes(parsed, c, _ids_only(b)), sections)


@query(f"WITH {CAND} SELECT doc_id, 'partial-section-part-' || page || '-node-' || (k + 1) AS node_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS INTEGER) AS ord, title, 'ai_inference' AS source_type FROM cand WHERE doc_id % 2 = 1")
def partial_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, _, b, c = _candidates(spark, sf_dir)
    done = rs.synthesize_nodes(parsed, c, _ids_only(b)).where("doc_id % 2 = 0")
    return rs.partial_sections(c, done).select("doc_id", "node_id", "ord", "title", "source_type")


@query(f"""WITH {CAND}, spare AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS ord FROM cand WHERE doc_id % 3 = 0), b AS (SELECT block_id, doc_id, text FROM blocks)
SELECT s.doc_id, 'ai-node-' || (ord + 1) AS node_id, CASE WHEN ids = '' THEN 1 ELSE s.page END AS page, coalesce(left(b.text, 90), '') AS materials, CAST(greatest(1, 1 + d.n_chars // 2500) AS INTEGER) AS current_page, 100 AS document_confidence FROM spare s JOIN documents d USING (doc_id) LEFT JOIN b ON b.doc_id = s.doc_id AND b.block_id = s.ids WHERE ord < 12""")
def library_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, _, b, c = _candidates(spark, sf_dir)
    n = rs.synthesize_nodes(parsed, c, b).where("doc_id % 3 = 0")
    out = rs.library_projection(n, ad.documents(spark, sf_dir).withColumn("average_confidence", F.lit(0.999)))
    return out.select("doc_id", "node_id", "page", F.array_join("materials", "|").alias("materials"), "current_page", "document_confidence")


STATUSES = ["unread", "passed", "read", "understood", "doubt", "disagree", "saved", "reading"]


@query("""WITH e AS (SELECT user_id AS doc_id, event_id, ts, ['unread', 'passed', 'read', 'understood', 'doubt', 'disagree', 'saved', 'reading'][event_id % 8 + 1] AS s FROM events), l AS (SELECT doc_id, arg_max(s, struct_pack(ts := ts, i := event_id)) AS s FROM e WHERE s <> 'reading' GROUP BY doc_id)
SELECT doc_id, coalesce(l.s, 'unread') AS user_status, (SELECT count(*) FROM e WHERE s = 'reading') AS refused FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT user_id FROM events)) d LEFT JOIN l USING (doc_id)""")
def apply_user_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.table(spark, sf_dir, "events")
    known = e.select(F.col("user_id").alias("doc_id")).distinct()
    rows = ad.table(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id").select("doc_id", F.lit("n").alias("node_id"), F.lit("unread").alias("user_status"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 8 + 1).cast("int"))
    edits = e.select(F.col("user_id").alias("doc_id"), F.lit("n").alias("node_id"), status.alias("status"), F.struct("ts", "event_id").alias("updated_at"))
    out, refused = rs.apply_user_status(rows, edits, "node_id", rs.NODE_STATUSES)
    n = refused.where("reason = 'unknown status'").agg(F.count("*").alias("refused"))
    return out.select("doc_id", "user_status").join(F.broadcast(n))  # one row


def _judgment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parsed responses, chunks, blocks and candidates of judgments."""
    chunks, chunks_at = stored(_chunks(spark, sf_dir), "chunks")

    def issue(text: Column, k: Column) -> Column:
        ids = F.when(k % 4 == 3, F.array(F.lit("nowhere"))).otherwise(F.array(F.get("block_ids", k), F.lit("nowhere")))
        return F.struct(
            _unless(k % 3 == 1, text).alias("title"), F.when(k == 0, "争议焦点").alias("stage"), F.when(k % 2 == 0, text).otherwise(" ").alias("claim"), F.when(k % 3 == 0, F.concat(F.lit("fact "), k.cast("string"))).alias("courtFact"),
            F.array(text, F.lit(" "), F.lit(" e ")).alias("evidence"), F.when(k % 4 == 2, text).alias("conclusion"), ids.alias("sourceBlockIds"), _unless(k % 3 == 0, F.length(text) - 20.0).alias("confidence"),
        )

    maps = _raw(chunks, "map", issues=F.transform("texts", issue), warnings=F.array(F.lit("w")))
    docs = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("ord"))).alias("parts")).withColumn("chunk_id", F.lit("reduce"))

    def final(q: Column) -> Column:
        name = lambda n: F.concat(F.lit("section-part-"), q.cast("string"), F.lit(f"-issue-{n}"))
        return F.struct(F.array(name(2), name(1), name(3)).alias("candidateIds"), F.when(q % 2 == 0, " ").otherwise(F.concat(F.lit("Issue "), q.cast("string"))).alias("title"), F.when(q % 3 == 0, F.array(F.lit("own"))).alias("evidence"))

    d = F.col("doc_id")
    issues = F.transform(F.filter("parts", lambda x: d % 3 != 0), final)
    case = F.struct(_unless(d % 2 == 0, F.concat(F.lit("cause "), d.cast("string"))).alias("cause"), _unless(d % 5 < 2, "won").alias("result"), F.lit("court").alias("court"))
    reduced = _raw(docs, "reduce", caseSummary=case, issues=issues)
    parsed = written(rs.parse_json_lenient(maps.unionByName(reduced), rs.JUDGMENT_RESPONSE).drop("raw"), "responses")
    chunks = _without_texts(chunks, chunks_at)
    return parsed, chunks, _ids_only(ad.blocks(spark, sf_dir)), rs.normalize_map_issues(parsed.where("stage = 'map'"), chunks)


ISSUE_CAND = f"""{PLACED}, ic AS (SELECT doc_id, page, k, block_id, CASE WHEN k % 3 = 1 THEN '裁判节点 ' || (k + 1) ELSE left(text, 100) END AS title, CASE WHEN k = 0 THEN '争议焦点' ELSE '法院说理' END AS stage, CASE WHEN k % 2 = 0 THEN left(text, 1600) ELSE ' ' END AS claim,
  CASE WHEN k % 3 = 0 THEN 'fact ' || k ELSE '' END AS court_fact, CASE WHEN trim(text, ' ' || chr(9) || chr(13)) = 'e' THEN ['e', 'e'] ELSE [regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 'e'] END AS evidence, CASE WHEN k % 4 = 2 THEN left(text, 1600) ELSE '' END AS conclusion, CASE WHEN k % 4 = 3 THEN '' ELSE block_id END AS ids,
  CAST(CASE WHEN k % 3 = 0 THEN 70 ELSE greatest(0, least(100, length(text) - 20)) END AS DOUBLE) AS confidence_pct FROM pl WHERE k < 10)"""


@query(f"WITH {ISSUE_CAND} SELECT doc_id, 'section-part-' || page || '-issue-' || (k + 1) AS candidate_id, title, stage, claim, court_fact, array_to_string(evidence, '|') AS evidence, '' AS reasoning, conclusion, ids, confidence_pct FROM ic")
def normalize_map_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _judgment(spark, sf_dir)[3]
    return c.select("doc_id", "candidate_id", "title", "stage", "claim", "court_fact", F.array_join("evidence", "|").alias("evidence"), "reasoning", "conclusion", F.array_join("block_ids", "|").alias("ids"), "confidence_pct")


STRIPPED = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
FINAL_ISSUES = f"""{ISSUE_CAND}, pg AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS ord FROM pl WHERE k = 0),
inh AS (SELECT p.doc_id, p.page, p.ord, i.k, i.title, i.claim, i.court_fact, i.evidence, i.conclusion, i.ids, i.stage, i.confidence_pct, CASE i.k WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS pos FROM pg p JOIN ic i ON i.doc_id = p.doc_id AND i.page = p.page AND i.k < 3 WHERE p.doc_id % 3 <> 0 AND p.ord < 18),
fi AS (SELECT doc_id, ord, page, CASE WHEN page % 2 = 1 THEN 'Issue ' || page ELSE arg_min({STRIPPED('title')}, pos) FILTER ({STRIPPED('title')} <> '') END AS title, arg_min(stage, pos) AS stage, coalesce(arg_min({STRIPPED('claim')}, pos) FILTER ({STRIPPED('claim')} <> ''), '') AS claim, coalesce(arg_min(court_fact, pos) FILTER (court_fact <> ''), '') AS court_fact,
  CASE WHEN page % 3 = 0 THEN ['own'] ELSE list_sort(list_distinct(flatten(list(evidence)))) END AS evidence, coalesce(arg_min({STRIPPED('conclusion')}, pos) FILTER ({STRIPPED('conclusion')} <> ''), '') AS conclusion, string_agg(ids, '|' ORDER BY pos) AS ids, arg_min(confidence_pct, pos) AS confidence_pct FROM inh GROUP BY doc_id, ord, page),
sp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) - 1 AS ord FROM ic WHERE doc_id % 3 = 0),
fin AS (SELECT doc_id, ord, title, stage, claim, court_fact, evidence, conclusion, ids, confidence_pct, page FROM fi UNION ALL SELECT doc_id, ord, CASE WHEN {STRIPPED('title')} = '' THEN '裁判节点 ' || (ord + 1) ELSE {STRIPPED('title')} END, stage, {STRIPPED('claim')}, court_fact, list_sort(list_distinct(evidence)), {STRIPPED('conclusion')}, ids, confidence_pct, CASE WHEN ids = '' THEN 1 ELSE page END FROM sp WHERE ord < 14)"""


@query(f"WITH {FINAL_ISSUES} SELECT doc_id, 'ai-issue-' || (ord + 1) AS issue_id, title, stage, claim, court_fact, array_to_string(evidence, '|') AS evidence, conclusion, ids, confidence_pct, CAST(page AS INTEGER) AS page, '待读取' AS status FROM fin")
def synthesize_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, _, b, c = _judgment(spark, sf_dir)
    i = rs.synthesize_issues(parsed, c, b)
    return i.select("doc_id", "issue_id", "title", "stage", "claim", "court_fact", F.array_join(F.sort_array(F.array_distinct("evidence")), "|").alias("evidence"), "conclusion", _ids().alias("ids"), "confidence_pct", "page", "status")


@query(f"""WITH {FINAL_ISSUES}, e AS (SELECT doc_id, ord, array_to_string(evidence, '') AS e FROM fi UNION ALL SELECT doc_id, ord, array_to_string(evidence, '') FROM sp WHERE ord < 14),
g AS (SELECT doc_id, sum(length(title) + length(claim) + length(court_fact) + length(e) + length(conclusion)) AS n FROM fin JOIN e USING (doc_id, ord) GROUP BY doc_id)
SELECT doc_id, CAST(n + 5 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE length('cause ' || doc_id) END + CASE WHEN doc_id % 5 < 2 THEN 0 ELSE 3 END AS BIGINT) AS generated_characters FROM g""")
def generated_judgment_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, _, b, c = _judgment(spark, sf_dir)
    return rs.generated_judgment_characters(parsed, rs.synthesize_issues(parsed, c, b))


@query(f"""WITH {FINAL_ISSUES}, g AS (SELECT doc_id, arg_max(conclusion, ord) FILTER (conclusion <> '') AS last, arg_min(claim, ord) FILTER (contains(stage, '争议') OR contains(title, '争议')) AS core FROM fin GROUP BY doc_id)
SELECT doc_id, 'court' AS court, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'cause ' || doc_id END AS cause, '裁判文书' AS document_type, '待确认' AS procedure, CASE WHEN doc_id % 5 < 2 THEN coalesce(last, '') ELSE 'won' END AS result, CASE WHEN doc_id % 2 = 0 THEN 'Document ' || doc_id ELSE 'cause ' || doc_id END AS surface_topic, coalesce(core, '') AS core_question, '裁判推理' AS paradigm, '裁判结论仅适用于本案事实与证据结构' AS boundary FROM g""")
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, _, b, c = _judgment(spark, sf_dir)
    s = rs.case_summary(parsed, rs.synthesize_issues(parsed, c, b), ad.documents(spark, sf_dir))
    return s.select("doc_id", "court", "cause", "document_type", "procedure", "result", "surface_topic", "core_question", "paradigm", "boundary")


def _full_text(spark: SparkSession, sf_dir: str, judgment: bool = False) -> tuple[DataFrame, DataFrame]:
    """One response for each document: a section, a node and an issue a page, none where the id is a multiple of four or five."""
    chunks = _chunks(spark, sf_dir, texts=False)
    d = F.col("doc_id")
    docs = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("p"), "block_ids"))).alias("parts")).withColumn("chunk_id", F.lit("full_text"))
    ids = lambda x: F.concat(F.array(F.lit("nowhere")), x["block_ids"])
    named = lambda label, x: F.concat(F.lit(label), x["p"].cast("string"))
    none = F.filter("parts", lambda x: F.lit(False))
    if judgment:
        issue = lambda x: F.struct(F.when(x["p"] % 2 == 0, "").otherwise(named("I ", x)).alias("title"), named("claim ", x).alias("claim"), ids(x).alias("sourceBlockIds"))
        raw = _raw(docs, "full_text", issues=F.transform("parts", issue))
    else:
        section = lambda x: F.struct(F.when(x["p"] % 3 == 0, "").otherwise(named("sec", x)).alias("sectionId"), F.when(x["p"] % 2 == 0, "").otherwise(named("T ", x)).alias("title"), named("sum ", x).alias("summary"), F.array(named("f", x), F.lit(" ")).alias("framework"), ids(x).alias("sourceBlockIds"))
        node = lambda x: F.struct(F.when(x["p"] % 2 == 0, "").otherwise(named("N ", x)).alias("title"), named("s ", x).alias("summary"), ids(x).alias("sourceBlockIds"), F.when(x["p"] % 3 == 0, 12.0).alias("confidence"))
        raw = _raw(docs, "full_text", sectionAnalyses=F.transform(F.when(d % 4 == 0, none).otherwise(F.col("parts")), section), nodes=F.transform(F.when(d % 5 == 0, none).otherwise(F.col("parts")), node), documentAnalysis=F.struct(F.lit("whole").alias("summary"), F.lit(60.0).alias("confidence")))
    b = ad.blocks(spark, sf_dir)
    return written(rs.parse_json_lenient(raw, rs.JUDGMENT_RESPONSE if judgment else rs.PAPER_RESPONSE).drop("raw"), "responses"), b


WHOLE = f"""{PLACED}, pp AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS ord, list(block_id ORDER BY reading_order) AS ids FROM pl GROUP BY doc_id, page),
fs AS (SELECT doc_id, ord, CASE WHEN page % 3 = 0 THEN 'section-' || (ord + 1) ELSE 'sec' || page END AS section_id, CASE WHEN page % 2 = 0 THEN '一级标题 ' || (ord + 1) ELSE 'T ' || page END AS title, 'sum ' || page AS summary, 'f' || page AS framework, 76.0 AS confidence_pct, ids[1:29] AS ids FROM pp WHERE ord < 24 AND doc_id % 4 <> 0
  UNION ALL SELECT doc_id, 0, 'section-1', '正文', 'whole', '', 60.0, list(block_id ORDER BY page, reading_order)[1:20] FROM blocks WHERE doc_id % 4 = 0 GROUP BY doc_id)"""


@query(f"WITH {WHOLE} SELECT doc_id, section_id, title, summary, framework, CAST(confidence_pct AS DOUBLE) AS confidence_pct, array_to_string(ids, '|') AS ids FROM fs")
def full_text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rs.full_text_sections(*_full_text(spark, sf_dir))
    return s.select("doc_id", "section_id", "title", "summary", F.array_join("framework", "|").alias("framework"), "confidence_pct", _ids().alias("ids"))


@query(f"""WITH {WHOLE} SELECT doc_id, 'ai-node-' || (ord + 1) AS node_id, CASE WHEN page % 2 = 0 THEN '分析节点 ' || (ord + 1) ELSE 'N ' || page END AS title, 's ' || page AS summary, CAST(CASE WHEN page % 3 = 0 THEN 12 ELSE 78 END AS DOUBLE) AS confidence_pct, array_to_string(ids[1:19], '|') AS ids FROM pp WHERE ord < 16 AND doc_id % 5 <> 0
UNION ALL SELECT doc_id, 'ai-node-' || (ord + 1), title, summary, CAST(confidence_pct AS DOUBLE), array_to_string(ids[1:20], '|') FROM fs WHERE ord < 12 AND doc_id % 5 = 0""")
def full_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, b = _full_text(spark, sf_dir)
    n = rs.full_text_nodes(parsed, rs.full_text_sections(parsed, b), b)
    return n.select("doc_id", "node_id", "title", "summary", "confidence_pct", _ids().alias("ids"))


@query(f"WITH {WHOLE} SELECT doc_id, 'ai-issue-' || (ord + 1) AS issue_id, CASE WHEN page % 2 = 0 THEN '裁判节点 ' || (ord + 1) ELSE 'I ' || page END AS title, '法院说理' AS stage, 'claim ' || page AS claim, CAST(page AS INTEGER) AS page, CAST(78 AS DOUBLE) AS confidence_pct, array_to_string(ids[1:23], '|') AS ids FROM pp WHERE ord < 18")
def full_text_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed, b = _full_text(spark, sf_dir, judgment=True)
    i = rs.full_text_issues(parsed, _ids_only(b))
    return i.select("doc_id", "issue_id", "title", "stage", "claim", "page", "confidence_pct", _ids().alias("ids"))
