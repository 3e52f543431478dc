"""Registered queries on what a reader marks in blocks, requests to models, and text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import normalize_text
from quire.operators import annotations as an
from quire.operators import pages as pa
from quire.operators import research as re_
from quire.operators import search as se
from quire.operators import structure as st
from quire.plans import adapters as ad
from quire.plans.queries import BLOCKS, query
from quire.shared import discard
from quire.sources import workspace
from quire.streaming import streams

# Five kinds of marks, by the block's place: at its offsets; found elsewhere in the block; the block inside the quote; the
# longest common run; a segment. The third kind has blocks of less than four characters, which only a run could find.
MARKS = rf"""{BLOCKS}, b AS (SELECT doc_id, block_id, reading_order AS k, text AS t, regexp_replace(text, '\s+', '', 'g') AS u FROM blocks),
m AS (SELECT *, CASE k % 5 WHEN 2 THEN 'xx' || t || 'yy' WHEN 3 THEN 'QQ' || substring(t, 5, 12) || 'ZZ' || substring(t, 2, 6) ELSE substring(t, 3, 20) END AS quote, CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END AS s FROM b),
a AS (SELECT *, regexp_replace(quote, '\s+', '', 'g') AS q, CASE WHEN k % 5 = 0 THEN 2 + length(quote) ELSE 3 END AS e FROM m),
w AS (SELECT *, CASE WHEN q <> '' AND regexp_replace(substring(t, s + 1, e - s), '\s+', '', 'g') = q THEN 'own' WHEN q <> '' AND contains(u, q) THEN 'found' WHEN length(u) >= 4 AND contains(q, u) THEN 'block' ELSE 'run' END AS tier FROM a WHERE k % 5 <> 4),
c AS (SELECT doc_id, block_id, i, n FROM (SELECT *, unnest(range(4, length(u) - i + 2)) AS n FROM (SELECT *, unnest(range(1, length(u) - 2)) AS i FROM w WHERE tier = 'run' AND length(u) >= 4)) WHERE contains(q, substring(u, i, n))),
r AS (SELECT doc_id, block_id, arg_max(i, n * 1000000 - i) AS i, max(n) AS n FROM c GROUP BY doc_id, block_id),
o AS (SELECT w.*, CASE tier WHEN 'found' THEN strpos(u, q) - 1 WHEN 'block' THEN 0 ELSE r.i - 1 END AS a, CASE tier WHEN 'found' THEN length(q) WHEN 'block' THEN length(u) ELSE r.n END AS n, list_filter(range(length(t)), lambda i: NOT regexp_matches(substring(t, i + 1, 1), '\s')) AS p FROM w LEFT JOIN r USING (doc_id, block_id) WHERE tier <> 'run' OR r.n IS NOT NULL)"""


@query(f"""WITH {MARKS} SELECT doc_id || '-' || block_id AS annotation_id, doc_id, block_id, CAST(CASE WHEN tier = 'own' THEN s ELSE p[a + 1] END AS INTEGER) AS start_offset, CAST(CASE WHEN tier = 'own' THEN e ELSE p[a + n] + 1 END AS INTEGER) AS end_offset, tier FROM o
UNION ALL SELECT doc_id || '-' || block_id, doc_id, block_id, 1, 4, 'segment' FROM b WHERE k % 5 = 4""")
def resolve_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("reading_order") % 5, F.col("text")
    quote = F.when(k == 2, F.concat(F.lit("xx"), t, F.lit("yy"))).when(k == 3, F.concat(F.lit("QQ"), F.substring(t, 5, 12), F.lit("ZZ"), F.substring(t, 2, 6))).otherwise(F.substring(t, 3, 20))
    segments = F.when(k == 4, F.array(F.struct("block_id", F.lit(1).alias("start_offset"), F.lit(4).alias("end_offset"), F.substring(t, 2, 3).alias("text"))))
    b = ad.blocks(spark, sf_dir)
    a = b.select(F.concat_ws("-", F.col("doc_id").cast("string"), "block_id").alias("annotation_id"), "doc_id", "block_id", F.when(k == 0, 2).otherwise(0).alias("start_offset"), F.when(k == 0, 2 + F.length(quote)).otherwise(3).alias("end_offset"), quote.alias("text"), segments.alias("segments"))
    return an.resolve_ranges(a, b)


@query(f"WITH {BLOCKS}, a AS (SELECT doc_id, 'a' || doc_id || '-' || reading_order AS annotation_id, page, CASE WHEN doc_id % 3 = 2 THEN chr(1) || substring(text, 3, 40) ELSE substring(text, 3, 40) END AS text FROM blocks) SELECT annotation_id FROM a WHERE doc_id = 7 AND contains(lower(text), 'th') ORDER BY page, annotation_id LIMIT 30")
def search_annotations_in_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.search_annotations_in_doc(ad.annotations(spark, sf_dir), 7, " TH ").select("annotation_id")


@query("""WITH d AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id || '' ELSE lpad(doc_id || '', 8, '0') || '-0000-4000-8000-000000000000' END AS doc_id, source AS project_id, n_chars FROM documents)
SELECT doc_id, project_id, n_chars, 'local' AS origin FROM d WHERE project_id <> 'src1' OR NOT contains(doc_id, '-') UNION ALL SELECT 's' || doc_id, project_id, n_chars, 'server' FROM d WHERE project_id = 'src1'""")
def replace_project_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one project come anew from the server; those that never were there stay."""
    i = F.col("doc_id").cast("string")
    d = ad.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, i).otherwise(F.concat(F.lpad(i, 8, "0"), F.lit("-0000-4000-8000-000000000000"))).alias("doc_id"), F.col("source").alias("project_id"), "n_chars")
    server = d.withColumn("doc_id", F.concat(F.lit("s"), "doc_id")).withColumn("origin", F.lit("server"))
    return re_.replace_project_docs(d.withColumn("origin", F.lit("local")), server, "src1")


@query("""WITH c AS (SELECT doc_id, unnest(range(1, 4)) AS ord, text FROM documents), r AS (SELECT doc_id, sum(length(substring(text, 1 + (ord - 1) * 30000, 30000 * ord))) > 20000 AS many FROM c GROUP BY doc_id), z AS (SELECT c.*, substring(text, 1 + (ord - 1) * 30000, 30000 * ord) AS part FROM c)
SELECT doc_id, 'map' AS stage, 'c' || ord AS chunk_id, CAST((ord - 1) // 2 AS INTEGER) AS wave, 'Why?' || chr(10) || part AS prompt FROM z JOIN r USING (doc_id) WHERE many
UNION ALL SELECT doc_id, 'reduce', 'reduce', 2, 'Why?' FROM r WHERE many UNION ALL SELECT doc_id, 'full_text', 'full_text', 0, 'Why?' || chr(10) || string_agg(part, chr(10) ORDER BY ord) FROM z JOIN r USING (doc_id) WHERE NOT many GROUP BY doc_id""")
def build_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three growing parts of each document: one request for all, or waves of two parts and one to reduce."""
    d = ad.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("ord"), "text")
    chunks = d.select("doc_id", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("chunk_id"), "ord", F.substring("text", 1 + (F.col("ord") - 1) * 30_000, 30_000 * F.col("ord")).alias("source_text"))
    return st.build_requests(chunks, "Why?", wave=2, limit=20_000).select("doc_id", "stage", "chunk_id", "wave", "prompt")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('法 院 ' || replace(text, ' ', chr(12288) || ' ') || ' 判 决 书', '法 院', '法院'), '判 决 书', '判决书'), '[\s' || chr(12288) || ']+', ' ', 'g')) AS text FROM documents""")
def normalize_text_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space between CJK characters goes, other runs become one space, a NUL is dropped."""
    odd = F.concat(F.lit("法 院 "), F.replace("text", F.lit(" "), F.lit("　 ")), F.lit(" 判\x00 决 书"))
    return ad.table(spark, sf_dir, "documents").select("doc_id", normalize_text(odd).alias("text"))


@query(f"""WITH {BLOCKS}, r AS (SELECT doc_id, block_id, reading_order AS k, length(text) AS n, text, substring(text, 5, 2) AS m, substring(text, 3, 8) AS q FROM blocks)
SELECT doc_id, block_id, m AS marker, CAST(CASE WHEN k % 3 = 0 THEN 4 ELSE strpos(text, q) - 1 + strpos(q, m) - 1 END AS INTEGER) AS start_offset, CAST(CASE WHEN k % 3 = 0 THEN 6 ELSE strpos(text, q) - 1 + strpos(q, m) - 1 + 2 END AS INTEGER) AS end_offset
FROM r WHERE n >= 12 AND regexp_matches(m, '^[a-z][a-z]$') AND regexp_matches(q, '^\\S.*\\S$') AND k % 3 <> 2""")
def repair_ref_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with right offsets, with wrong ones and a quote, and with neither: the last go."""
    k, t = F.col("reading_order") % 3, F.col("text")
    start = F.when(k == 0, 4).otherwise(F.lit(-1))
    ref = F.struct(F.substring(t, 5, 2).alias("marker"), F.when(k == 2, F.lit(None)).otherwise(F.substring(t, 3, 8)).alias("quote"), start.alias("start_offset"), F.when(k == 0, 6).otherwise(F.lit(-2)).alias("end_offset"))
    fine = (F.length(t) >= 12) & F.substring(t, 5, 2).rlike("^[a-z][a-z]$") & F.substring(t, 3, 8).rlike(r"^\S.*\S$")
    b = ad.blocks(spark, sf_dir).where(fine).withColumn("refs", pa.repair_ref_offsets(F.array(ref), t))
    return b.select("doc_id", "block_id", F.explode("refs").alias("r")).select("doc_id", "block_id", "r.marker", "r.start_offset", "r.end_offset")


@query("""WITH RECURSIVE i AS (SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '","n_chars":' || n_chars || '}' AS j, row_number() OVER (ORDER BY doc_id, lang, source, n_chars) AS n FROM documents),
f AS (SELECT n, strlen(j) + 1 AS total, 0 AS part FROM i WHERE n = 1 UNION ALL SELECT i.n, CASE WHEN f.total + strlen(j) + 1 > 1499 THEN strlen(j) + 1 ELSE f.total + strlen(j) + 1 END, CASE WHEN f.total + strlen(j) + 1 > 1499 THEN f.part + 1 ELSE f.part END FROM f JOIN i ON i.n = f.n + 1),
p AS (SELECT part, '[' || string_agg(j, ',' ORDER BY n) || ']' AS v, count(*) AS rows FROM f JOIN i USING (n) GROUP BY part) SELECT CAST(part AS INTEGER) AS part, rows, strlen(v) AS bytes, sha256(v) AS hash, strlen(v) > 2000 AS too_large FROM p""")
def byte_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their texts in parts of at most 1 500 bytes."""
    d = ad.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return workspace.byte_parts(d, "documents", ["doc_id", "lang", "source", "n_chars"], 1500, 2000).select("part", "rows", "bytes", "hash", "too_large")


@query("SELECT 'documents' AS name, doc_id AS id, lang AS label, n_chars AS n FROM documents UNION ALL SELECT 'labels', doc_id, CAST(toxic AS VARCHAR), quality FROM labels")
def snapshot_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables published in parts, once changed and published again, and read back."""
    d = ad.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    n = ad.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    path = streams.new_checkpoint(spark, "parts")
    workspace.publish_parts(spark, {"documents": (d.where("doc_id % 50 <> 7"), ["doc_id"]), "labels": (n, ["doc_id"])}, path)
    workspace.publish_parts(spark, {"documents": (d, ["doc_id"]), "labels": (n, ["doc_id"])}, path)
    t = workspace.read_parts(spark, path, {"documents": d.schema, "labels": n.schema})
    a = t["documents"].select(F.lit("documents").alias("name"), F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.col("n_chars").cast("long").alias("n"))
    return a.unionByName(t["labels"].select(F.lit("labels").alias("name"), F.col("doc_id").alias("id"), F.col("toxic").cast("string").alias("label"), F.col("quality").cast("long").alias("n")))


@query(f"WITH {BLOCKS} SELECT 'block' AS kind, CAST(b.doc_id AS VARCHAR) AS doc_id, block_id AS id, page AS n, b.text, d.source AS label FROM blocks b JOIN documents d USING (doc_id) UNION ALL SELECT 'job', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), CAST(event_id % 100 AS INTEGER), NULL, event_type FROM events")
def read_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their blocks, and events as jobs, written as workspace files and read back in splits."""
    b = ad.blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "page", "text"))).alias("b"))
    items = F.transform("b", lambda x: F.struct(x["block_id"].alias("id"), x["page"].alias("page"), x["reading_order"].alias("readingOrder"), x["text"].alias("text")))
    d = ad.table(spark, sf_dir, "documents").select("doc_id", "source").join(b, "doc_id", "left")
    docs = d.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("projectId"), items.alias("blocks"))).alias("json"))
    e = ad.table(spark, sf_dir, "events")
    jobs = e.select("event_id", F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("documentId"), F.col("event_type").alias("stage"), (F.col("event_id") % 100).alias("progress"))).alias("json"))
    path = streams.new_checkpoint(spark, "workspaces")
    workspace.write_workspaces({"documents": (docs, "doc_id"), "jobs": (jobs, "event_id")}, path, 8 + docs.count() // 100_000)
    t = workspace.read_workspace(spark, f"{path}/*")
    discard(spark, path)  # tables are read from what read_workspace wrote
    blocks = t["blocks"].join(t["documents"].select("doc_id", "project_id"), "doc_id").select(F.lit("block").alias("kind"), "doc_id", F.col("block_id").alias("id"), F.col("page").alias("n"), "text", F.col("project_id").alias("label"))
    return blocks.unionByName(t["jobs"].select(F.lit("job").alias("kind"), "doc_id", F.col("job_id").alias("id"), F.col("progress").alias("n"), F.lit(None).cast("string").alias("text"), F.col("stage").alias("label")))
