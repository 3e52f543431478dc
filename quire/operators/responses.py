"""Model responses as tables: lenient parsing, validation against the source, synthesis.

Candidates and final rows name blocks; only names that exist in the chunk (or document) become
anchors. Lists keep the order of the response. ``ord`` is the place in the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import SPACE, clamp, head, strip

NODE_SCHEMA = "title string, role string, attribution string, summary string, reasons array<string>, sourceBlockIds array<string>, candidateIds array<string>, confidence double"
ISSUE_SCHEMA = "title string, stage string, claim string, courtFact string, evidence array<string>, laws array<string>, reasoning string, conclusion string, sourceBlockIds array<string>, candidateIds array<string>, confidence double"
READING_SCHEMA = "legalQuestion string, summary string, analysisApproach string, framework array<string>, sourceBlockIds array<string>"
SECTION_SCHEMA = f"sectionId string, title string, confidence double, {READING_SCHEMA}"
SUMMARY_SCHEMA = "surfaceTopic string, coreQuestion string, coreConclusion string, paradigm string, boundary string"
CASE_SCHEMA = "caseNumber string, court string, cause string, documentType string, procedure string, decisionDate string, result string"


def struct_of(fields: str) -> str:
    """The fields of a flat schema, "name type, ...", as a struct type."""
    return "struct<" + ",".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"


#: What a model may answer about a paper and about a judgment, in any stage.
PAPER_RESPONSE = f"sectionSummary string, sectionAnalysis {struct_of(READING_SCHEMA)}, nodes array<{struct_of(NODE_SCHEMA)}>, sectionAnalyses array<{struct_of(SECTION_SCHEMA)}>, documentAnalysis {struct_of(READING_SCHEMA + ', confidence double')}, documentSummary {struct_of(SUMMARY_SCHEMA)}, warnings array<string>"
JUDGMENT_RESPONSE = f"caseSummary {struct_of(CASE_SCHEMA)}, issues array<{struct_of(ISSUE_SCHEMA)}>, warnings array<string>"
#: What stands in for a missing name, the mark of an issue in dispute, and an issue's first state.
NODE, CHUNK_NODE, ISSUE, SECTION = "分析节点 ", "章节节点 ", "裁判节点 ", "一级标题 "
ROLE, ATTRIBUTION, STAGE = "论证展开", "作者观点", "法院说理"
DOCUMENT_TYPE, PROCEDURE, PARADIGM, WHOLE = "裁判文书", "待确认", "待确认", "全文"
DISPUTE, PENDING = "争议", "待读取"
#: The paradigm and the boundary of every judgment.
JUDGMENT_PARADIGM, JUDGMENT_BOUNDARY = "裁判推理", "裁判结论仅适用于本案事实与证据结构"


def strings(c: Column, most: int) -> Column:
    """A list of texts: trimmed but whole, without empty ones, at most ``most``."""
    return F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != ""), 1, most)


def said(c: Column, most: int, *defaults) -> Column:
    """The text as it is, or the first default that is there if it is missing (not if it is empty), cut to ``most``."""
    return head(F.coalesce(c, *[d if isinstance(d, Column) else F.lit(d) for d in defaults], F.lit("")), most)


def filled(c: Column, *defaults) -> Column:
    """The text without white space at its ends, or the first default that is not blank."""
    return F.coalesce(*[F.nullif(strip(d if isinstance(d, Column) else F.lit(d)), F.lit("")) for d in (c, *defaults)], F.lit(""))


def numbered(label: str, ord_: str = "ord") -> Column:
    return F.concat(F.lit(label), (F.col(ord_) + 1).cast("string"))


def listed(c) -> Column:
    """A list of texts, empty where there is none."""
    return F.coalesce(c, F.array().cast("array<string>"))


def parse_json_lenient(df: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """Adds ``parsed`` and ``parse_error``: code fences go; then the whole text; then first brace to last.

    Broken JSON still gives a struct of nulls, so the corrupt record decides, never the struct.
    """
    full = T.StructType.fromDDL(f"{schema}, _corrupt string")
    options = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    fine = lambda c: F.col(c).isNotNull() & F.col(f"{c}._corrupt").isNull()
    # most responses have neither fences nor white space at their ends; these are looked for without patterns over whole texts
    unfenced = F.when(F.contains(F.col(raw), F.lit("```")), F.regexp_replace(raw, r"(?m)^\s*```[A-Za-z]*\s*$|^```[A-Za-z]*|```$", "")).otherwise(F.coalesce(raw, F.lit("")))
    d = _once(df, "_text", unfenced)
    ends = F.concat(F.left("_text", F.lit(1)), F.right("_text", F.lit(1)))
    d = _once(d, "_plain", F.when(ends.rlike(f"(?U){SPACE}"), strip(F.col("_text"))).otherwise(F.col("_text")))
    d = _once(d, "_a", F.when(F.col("_plain").rlike(r"^\s*\{"), F.from_json("_plain", full, options)))
    # what the first reading took is not read again
    d = _once(d, "_inner", F.when(~fine("_a"), F.regexp_extract("_plain", r"(?s)(\{.*\})", 1)))
    d = _once(d, "_b", F.when(F.length("_inner") > 0, F.from_json("_inner", full, options)))
    names = [f.name for f in full.fields if f.name != "_corrupt"]
    keep = lambda c: F.struct(*[F.col(f"{c}.{n}").alias(n) for n in names])
    return d.withColumn("parsed", F.when(fine("_a"), keep("_a")).when(fine("_b"), keep("_b"))).withColumn("parse_error", F.when(F.col("parsed").isNull(), "not valid JSON")).drop("_text", "_plain", "_inner", "_a", "_b")


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Adds a column that is computed once a row: a generator of one row keeps the optimiser from putting the expression in
    place of its name, in each field taken of it and again in the filters it infers."""
    return df.select("*", F.explode(F.array(F.struct(c.alias(name)))).alias("_one")).select(*df.columns, f"_one.{name}")


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.where("parse_error is not null")


def valid_ids(rows: DataFrame, ids: str, allowed: DataFrame, keys: list[str], most: int, allowed_ids: str = "block_ids") -> DataFrame:
    """``ids`` cut to those in the allowed list of the same keys, in order, at most ``most``."""
    j = rows.join(allowed.select(*keys, F.col(allowed_ids).alias("_allowed")), keys, "left")
    inside = F.filter(listed(ids), lambda x: F.array_contains(listed("_allowed"), x))
    return j.withColumn(ids, F.slice(inside, 1, most)).drop("_allowed")


def _in_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows with _allowed (their chunk's block ids) and chunk_ord, dealt by document, so that what groups or joins by it next
    needs no other shuffle. Rows without a chunk have neither."""
    known = chunks.where("doc_id is not null and chunk_id is not null").select("doc_id", "chunk_id", F.lit(0).alias("_kind"), F.struct("block_ids", F.col("ord").alias("ord")).alias("_chunk"))
    both = rows.withColumn("_kind", F.lit(1)).unionByName(known, allowMissingColumns=True).repartition("doc_id")
    upto = Window.partitionBy("doc_id", "chunk_id").orderBy("_kind").rowsBetween(Window.unboundedPreceding, 0)
    j = both.withColumn("_chunk", F.first("_chunk", ignorenulls=True).over(upto)).where("_kind = 1")
    return j.select(*rows.columns, F.col("_chunk.block_ids").alias("_allowed"), F.col("_chunk.ord").alias("chunk_ord"))


def _inside(ids: str, most: int) -> Column:
    """The ids that the chunk has, in order, at most ``most``."""
    return F.slice(F.filter(listed(ids), lambda x: F.array_contains(listed("_allowed"), x)), 1, most)


def _confidence(c: Column, default) -> Column:
    return clamp(F.coalesce(c, default if isinstance(default, Column) else F.lit(float(default))), 0.0, 100.0)


def normalize_map_nodes(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates from map responses (parsed.nodes): at most 7 a chunk, named ``{chunk}-node-{n}``; one with neither summary nor id goes."""
    n = parsed.select("doc_id", "chunk_id", F.posexplode("parsed.nodes").alias("ord", "n")).where("ord < 7")
    r = n.select(
        "doc_id", "chunk_id", "ord", F.concat_ws("-node-", "chunk_id", (F.col("ord") + 1).cast("string")).alias("candidate_id"),
        said(F.col("n.title"), 100, numbered(CHUNK_NODE)).alias("title"), said(F.col("n.role"), 40, ROLE).alias("role"), said(F.col("n.attribution"), 40, ATTRIBUTION).alias("attribution"),
        said(F.col("n.summary"), 1600).alias("summary"), F.slice(listed("n.reasons"), 1, 8).alias("reasons"), F.col("n.sourceBlockIds").alias("block_ids"), _confidence(F.col("n.confidence"), 70).alias("confidence_pct"),
    )
    r = _in_chunks(r, chunks).withColumn("block_ids", _inside("block_ids", 16)).drop("_allowed")
    return r.where((F.col("summary") != "") | (F.size("block_ids") > 0))


def normalize_chunk_reading(parsed: DataFrame, chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """One reading row per map response (parsed.sectionAnalysis); without valid ids the chunk's first 20 paragraphs count."""
    a = "parsed.sectionAnalysis"
    r = parsed.select(
        "doc_id", "chunk_id", said(F.col(f"{a}.legalQuestion"), 1600).alias("legal_question"), said(F.col(f"{a}.summary"), 2200, F.col("parsed.sectionSummary")).alias("summary"),
        said(F.col(f"{a}.analysisApproach"), 1800).alias("approach"), strings(F.col(f"{a}.framework"), 14).alias("framework"), strings(F.col(f"{a}.sourceBlockIds"), 30).alias("block_ids"),
    )
    r = valid_ids(r, "block_ids", chunks, ["doc_id", "chunk_id"], 30)
    c = chunks.select("doc_id", "chunk_id", "section_id", "title", "start_page", "end_page", F.col("ord").alias("chunk_ord"), "block_ids")
    e = c.select("doc_id", "chunk_id", F.posexplode("block_ids").alias("p", "block_id")).join(blocks.where("block_type = 'paragraph'").select("doc_id", "block_id"), ["doc_id", "block_id"])
    first = e.groupBy("doc_id", "chunk_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("p", "block_id"))), lambda x: x["block_id"]), 1, 20).alias("paragraphs"))
    j = r.join(c.drop("block_ids"), ["doc_id", "chunk_id"]).join(first, ["doc_id", "chunk_id"], "left")
    return j.withColumn("block_ids", F.when(F.size("block_ids") == 0, listed("paragraphs")).otherwise(F.col("block_ids"))).drop("paragraphs")


def _anchor(blocks: DataFrame) -> Column:
    return F.struct("block_id", *[c for c in ("page", "text", "bbox") if c in blocks.columns])


def anchors(rows: DataFrame, ids: str, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds source_anchors: the named blocks of the document with page, text and box (what of these the blocks have), in the order named.

    Both joins are by sorting: tables of ids take so little room on disk that Spark would think them small enough to broadcast.
    """
    b = blocks.select("doc_id", F.col("block_id").alias("_id"), _anchor(blocks).alias("_anchor"))
    e = rows.select(*keys, F.posexplode(ids).alias("_p", "_id")).hint("merge").join(b, ["doc_id", "_id"])
    g = e.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_anchor"))), lambda x: x["_anchor"]).alias("source_anchors"))
    kind = T.ArrayType(b.schema["_anchor"].dataType)
    return rows.hint("merge").join(g, keys, "left").withColumn("source_anchors", F.coalesce("source_anchors", F.array().cast(kind)))


def _with_candidates(final: DataFrame, candidates: DataFrame, blocks: DataFrame, fields: list[str], spare: int, most: int) -> DataFrame:
    """Final rows with ``inherited``, the candidates that they name, in that order (names without a candidate drop out); with the anchors of
    inherited and own ids, each once, at most ``most`` that exist; whether there are any; and the confidence.

    A document without final rows has its first ``spare`` candidates, as rows that name themselves. What there is of a document
    meets in one row, so that texts are shuffled once.
    """
    c = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_ord", "ord", "candidate_id", F.struct(*fields, "block_ids", "confidence_pct").alias("c"))).alias("_c"))
    f = final.groupBy("doc_id").agg(F.collect_list(F.struct(*[x for x in final.columns if x != "doc_id"])).alias("_f"))
    b = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(_anchor(blocks))).alias("_b"))
    j = c.join(f, "doc_id", "full").join(b, "doc_id", "left")
    empty = lambda name, df: F.coalesce(name, F.array().cast(df.schema[name].dataType))
    itself = lambda x, i: {"ord": i, "confidence": x["c"]["confidence_pct"], "candidate_ids": F.array(x["candidate_id"]), "own_ids": x["c"]["block_ids"]} | {n: x["c"][n] for n in fields}
    spares = F.transform(F.slice(F.array_sort(empty("_c", c)), 1, spare), lambda x, i: F.struct(*[itself(x, i)[n].alias(n) for n in final.columns if n != "doc_id"]))
    named = lambda r: F.flatten(F.transform(listed(r["candidate_ids"]), lambda n: F.transform(F.filter(empty("_c", c), lambda x: x["candidate_id"] == n), lambda x: x["c"])))
    rows = F.transform(F.coalesce("_f", spares), lambda r: F.struct(r.alias("r"), named(r).alias("inherited")))
    # explodes of one row: what is looked up is not looked up again for each column
    e = j.select("doc_id", "_b", F.explode(rows).alias("z")).select("doc_id", "_b", "z.r.*", "z.inherited")
    ids = F.array_distinct(F.concat(F.flatten(F.transform("inherited", lambda x: x["block_ids"])), listed("own_ids")))
    e = e.select("*", F.explode(F.array(ids)).alias("ids"))
    found = F.flatten(F.transform(listed("ids"), lambda n: F.filter(empty("_b", b), lambda x: x["block_id"] == n)))
    e = e.select("*", F.explode(F.array(F.slice(found, 1, most))).alias("source_anchors")).drop("_b", "ids")
    return _judged(e, F.get("inherited", F.lit(0))["confidence_pct"])


def _judged(rows: DataFrame, inherited: Column) -> DataFrame:
    anchored = F.size("source_anchors") > 0
    kind = F.when(anchored, "ai_summary").otherwise("ai_inference")
    return rows.withColumn("source_type", kind).withColumn("confidence_pct", _confidence(F.coalesce("confidence", inherited), F.when(anchored, 78.0).otherwise(45.0)))


NODE_COLUMNS = ["doc_id", "node_id", "ord", "title", "role", "attribution", "summary", "reasons", "confidence_pct", "source_type", "user_status", "source_anchors"]


def _own_nodes(parsed: DataFrame, stage: str) -> DataFrame:
    f = parsed.where(F.col("stage") == stage).select("doc_id", F.posexplode("parsed.nodes").alias("ord", "n")).where("ord < 16")
    return f.select("doc_id", "ord", *[F.col(f"n.{c}").alias(c) for c in ("title", "role", "attribution", "summary", "reasons", "confidence")], listed("n.candidateIds").alias("candidate_ids"), F.col("n.sourceBlockIds").alias("own_ids"))


def synthesize_nodes(parsed: DataFrame, candidates: DataFrame, blocks: DataFrame, stage: str = "reduce") -> DataFrame:
    """Final nodes of a document: at most 16 from the reduce response, else the first 12 candidates.

    What a node does not say it takes from its first candidate; its summary from all of them. Ids are those of the
    candidates named, then the row's own, that exist in the document, at most 20.
    """
    final = _own_nodes(parsed, stage)
    names = ["title", "role", "attribution", "summary", "reasons"]
    j = _with_candidates(final, candidates, blocks, names, 12, 20)
    first = F.get("inherited", F.lit(0))
    summaries = F.array_join(F.transform("inherited", lambda x: x["summary"]), "；")
    reasons = F.coalesce("reasons", F.flatten(F.transform("inherited", lambda x: x["reasons"])))
    return j.select(
        "doc_id", numbered("ai-node-").alias("node_id"), "ord", said(F.col("title"), 80, first["title"], numbered(NODE)).alias("title"), said(F.col("role"), 40, first["role"], ROLE).alias("role"), said(F.col("attribution"), 40, first["attribution"], ATTRIBUTION).alias("attribution"),
        said(F.col("summary"), 1800, summaries).alias("summary"), F.slice(reasons, 1, 8).alias("reasons"), "confidence_pct", "source_type", F.lit("unread").alias("user_status"), "source_anchors",
    )


def synthesize_sections(readings: DataFrame, parsed: DataFrame, blocks: DataFrame, stage: str = "reduce") -> DataFrame:
    """One row per section in order: what the reduce response says of it (parsed.sectionAnalyses by sectionId, the last of several), else its parts joined.

    Its ids are those of all its parts that exist in the document, each once, at most 80.
    """
    e = parsed.where(F.col("stage") == stage).select("doc_id", F.posexplode("parsed.sectionAnalyses").alias("p", "s")).where("s.sectionId is not null")
    done = e.groupBy("doc_id", F.col("s.sectionId").alias("section_id")).agg(F.max_by("s", "p").alias("s"))
    parts = lambda c: F.array_join(F.filter(F.transform("parts", lambda p: p[c]), lambda x: x != ""), "；")
    g = readings.groupBy("doc_id", "section_id").agg(F.min("chunk_ord").alias("chunk_ord"), F.min_by("title", "chunk_ord").alias("part_title"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.array_sort(F.collect_list(F.struct("chunk_ord", "legal_question", "summary", "approach", "framework", "block_ids"))).alias("parts"))
    g = g.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_ord")) - 1)
    every = lambda c: F.array_distinct(F.flatten(F.transform("parts", lambda p: p[c])))
    j = anchors(g.withColumn("ids", every("block_ids")), "ids", blocks, ["doc_id", "section_id"]).join(done, ["doc_id", "section_id"], "left")
    own = strings(F.col("s.framework"), 16)
    return j.select(
        "doc_id", "section_id", "ord", said(F.col("s.title"), 180, F.col("part_title"), numbered(SECTION)).alias("title"), "start_page", "end_page", said(F.col("s.legalQuestion"), 2000, parts("legal_question")).alias("legal_question"), said(F.col("s.summary"), 2600, parts("summary")).alias("summary"),
        said(F.col("s.analysisApproach"), 2200, parts("approach")).alias("approach"), F.when(F.size(own) > 0, own).otherwise(F.slice(every("framework"), 1, 16)).alias("framework"), _confidence(F.col("s.confidence"), 76).alias("confidence_pct"), F.slice("source_anchors", 1, 80).alias("source_anchors"),
    )


def document_reading(parsed: DataFrame, sections: DataFrame, blocks: DataFrame, docs: DataFrame | None = None, stage: str = "reduce") -> DataFrame:
    """The reading of each document with sections or an answer: parsed.documentAnalysis, then parsed.documentSummary.

    Its ids are those asked for that exist (at most 40), else the first two of each section, each once.
    """
    a, z = "parsed.documentAnalysis", "parsed.documentSummary"
    said_ = parsed.where(F.col("stage") == stage).select(
        "doc_id", said(F.col(f"{a}.legalQuestion"), 2400, F.col(f"{z}.coreQuestion")).alias("legal_question"), said(F.col(f"{a}.summary"), 3200, F.col(f"{z}.coreConclusion")).alias("summary"), said(F.col(f"{a}.analysisApproach"), 2600).alias("approach"), strings(F.col(f"{a}.framework"), 20).alias("framework"),
        _confidence(F.col(f"{a}.confidence"), 78).alias("confidence_pct"), *[said(F.col(f"{z}.{c}"), 1 << 30, d).alias(n) for c, n, d in (("surfaceTopic", "surface_topic", ""), ("coreQuestion", "core_question", ""), ("coreConclusion", "core_conclusion", ""), ("paradigm", "paradigm", PARADIGM), ("boundary", "boundary", ""))], strings(F.col(f"{a}.sourceBlockIds"), 40).alias("asked"),
    )
    asked = anchors(said_, "asked", blocks, ["doc_id"])
    two = F.transform(F.slice("source_anchors", 1, 2), lambda x: x["block_id"])
    s = sections.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", two.alias("two")))), lambda x: x["two"])).alias("section_ids"))
    j = asked.join(s, "doc_id", "full").withColumn("ids", F.when(F.size(F.coalesce("source_anchors", F.array().cast(asked.schema["source_anchors"].dataType))) > 0, F.transform("source_anchors", lambda x: x["block_id"])).otherwise(listed("section_ids")))
    j = anchors(j.drop("source_anchors").withColumn("ids", F.array_distinct("ids")), "ids", blocks, ["doc_id"])
    title = F.lit(WHOLE) if docs is None else F.coalesce(F.nullif("title", F.lit("")), F.lit(WHOLE))
    j = j if docs is None else j.join(docs.select("doc_id", "title"), "doc_id", "left")
    texts = ["legal_question", "summary", "approach", "surface_topic", "core_question", "core_conclusion", "boundary"]
    return j.select("doc_id", title.alias("title"), *[F.coalesce(c, F.lit("")).alias(c) for c in texts], F.coalesce("paradigm", F.lit(PARADIGM)).alias("paradigm"), listed("framework").alias("framework"), F.coalesce("confidence_pct", F.lit(78.0)).alias("confidence_pct"), F.slice("source_anchors", 1, 40).alias("source_anchors"))


def full_text_sections(parsed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections of a one-response analysis: at most 24, with up to 30 ids each; a document without any has one, of its first 20 blocks with text."""
    f = parsed.where("stage = 'full_text'")
    s = f.select("doc_id", F.posexplode("parsed.sectionAnalyses").alias("ord", "s")).where("ord < 24").select("doc_id", "ord", F.nullif("s.sectionId", F.lit("")).alias("section_id"), F.nullif("s.title", F.lit("")).alias("title"), *[F.col(f"s.{c}").alias(c) for c in ("legalQuestion", "summary", "analysisApproach", "framework", "confidence")], strings(F.col("s.sourceBlockIds"), 30).alias("ids"))
    none = f.hint("merge").join(s.select("doc_id").distinct(), "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy("page", "reading_order", "block_id")
    first = blocks.where(strip(F.col("text")) != "").withColumn("n", F.row_number().over(order)).where("n <= 20").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "block_id"))), lambda x: x["block_id"]).alias("ids"))
    a = "parsed.documentAnalysis"
    spare = none.hint("merge").join(first, "doc_id", "left").select("doc_id", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("section_id"), F.lit("正文").alias("title"), *[F.col(f"{a}.{c}").alias(c) for c in ("legalQuestion", "summary", "analysisApproach", "framework")], F.coalesce(f"{a}.confidence", F.lit(78.0)).alias("confidence"), listed("ids").alias("ids"))
    j = anchors(s.unionByName(spare), "ids", blocks, ["doc_id", "ord"])
    return j.select(
        "doc_id", F.coalesce("section_id", numbered("section-")).alias("section_id"), "ord", said(F.col("title"), 180, numbered(SECTION)).alias("title"), said(F.col("legalQuestion"), 2000).alias("legal_question"), said(F.col("summary"), 2600).alias("summary"), said(F.col("analysisApproach"), 2200).alias("approach"),
        strings(F.col("framework"), 16).alias("framework"), _confidence(F.col("confidence"), 76).alias("confidence_pct"), "source_anchors",
    )


def full_text_nodes(parsed: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Nodes of a one-response analysis: at most 16 of its own, with up to 20 ids each, else one for each of the first 12 sections."""
    own = _own_nodes(parsed, "full_text").withColumn("ids", strings(F.col("own_ids"), 20))
    own = _judged(anchors(own, "ids", blocks, ["doc_id", "ord"]), F.lit(None).cast("double"))
    or_else = lambda c, most, d: said(F.nullif(F.col(c), F.lit("")), most, d).alias(c)
    own = own.select("doc_id", numbered("ai-node-").alias("node_id"), "ord", or_else("title", 80, numbered(NODE)), or_else("role", 40, ROLE), or_else("attribution", 40, ATTRIBUTION), said(F.col("summary"), 1800).alias("summary"), F.slice(listed("reasons"), 1, 8).alias("reasons"), "confidence_pct", "source_type", F.lit("unread").alias("user_status"), "source_anchors")
    spare = sections.where("ord < 12").hint("merge").join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    spare = spare.select("doc_id", numbered("ai-node-").alias("node_id"), "ord", "title", F.lit(ROLE).alias("role"), F.lit(ATTRIBUTION).alias("attribution"), head(F.col("summary"), 1800).alias("summary"), F.slice("framework", 1, 8).alias("reasons"), "confidence_pct", F.when(F.size("source_anchors") > 0, "ai_summary").otherwise("ai_inference").alias("source_type"), F.lit("unread").alias("user_status"), F.slice("source_anchors", 1, 20).alias("source_anchors"))
    return own.unionByName(spare).select(*NODE_COLUMNS)


def _characters(*columns: Column, lists: tuple[Column, ...] = ()) -> Column:
    """The characters of texts and of the items of lists, where they are."""
    sizes = [F.length(F.coalesce(c, F.lit(""))) for c in columns] + [F.length(F.array_join(listed(c), "")) for c in lists]
    return sum(sizes[1:], sizes[0])


def _total(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc_id").agg(F.sum("n").cast("long").alias("generated_characters"))


def generated_characters(parsed: DataFrame, nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, generated_characters of an analysed paper: its nodes and sections as they are kept, and what the last response says of the whole."""
    a, z = "parsed.documentAnalysis", "parsed.documentSummary"
    of_nodes = nodes.select("doc_id", _characters(F.col("title"), F.col("summary"), lists=(F.col("reasons"),)).alias("n"))
    of_sections = sections.select("doc_id", _characters(*[F.col(c) for c in ("title", "legal_question", "summary", "approach")], lists=(F.col("framework"),)).alias("n"))
    texts = [F.col(f"{a}.{c}") for c in ("legalQuestion", "summary", "analysisApproach")] + [F.col(f"{z}.{c}") for c in ("surfaceTopic", "coreQuestion", "coreConclusion", "boundary")]
    whole = parsed.where("stage <> 'map'").select("doc_id", _characters(*texts, lists=(F.col(f"{a}.framework"),)).alias("n"))
    return _total(of_nodes, of_sections, whole)


def generated_judgment_characters(parsed: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, generated_characters of an analysed judgment: its issues as they are kept, and the case data that the last response gives."""
    of_issues = issues.select("doc_id", _characters(F.col("title"), *map(F.col, ISSUE_TEXTS), lists=(F.col("evidence"), F.col("laws"))).alias("n"))
    case = parsed.where("stage <> 'map'").select("doc_id", _characters(*[F.col(f"parsed.caseSummary.{c}") for c in ("caseNumber", "court", "cause", "result")]).alias("n"))
    return _total(of_issues, case)


def coverage_metrics(chunks: DataFrame, responses: DataFrame, cited: DataFrame, generated: DataFrame) -> DataFrame:
    """Per document: source and analysed characters, coverage with and without line prefixes, failed chunks, cited blocks.

    responses: doc_id, chunk_id, ok boolean; cited: doc_id, block_id; generated: as the functions above count it.
    """
    prefix = "size(block_ids) - 1 + aggregate(split(source_text, '\\n'), 0, (s, l) -> s + length(regexp_extract(l, '^(\\\\[P[^\\\\]]*\\\\] )', 1)))"
    c = chunks.withColumn("plain", F.length("source_text") - F.expr(prefix)).join(responses, ["doc_id", "chunk_id"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    g = c.groupBy("doc_id").agg(F.sum("plain").alias("source_characters"), F.sum(F.when(F.col("ok"), F.col("plain")).otherwise(0)).alias("analyzed_characters"), F.sum(F.when(F.col("ok"), F.length("source_text")).otherwise(0)).alias("prefixed"), F.count("*").alias("total_sections"), F.count_if("ok").alias("analyzed_sections"))
    n = cited.groupBy("doc_id").agg(F.count_distinct("block_id").alias("cited_blocks"))
    src = F.greatest(F.col("source_characters"), F.lit(1))
    j = g.join(n, "doc_id", "left").join(generated.select("doc_id", "generated_characters"), "doc_id", "left")
    return j.select("doc_id", "source_characters", "analyzed_characters", F.least(F.lit(1.0), F.col("prefixed") / src).alias("text_coverage"), (F.col("analyzed_characters") / src).alias("true_coverage"), F.coalesce("generated_characters", F.lit(0)).alias("generated_characters"), "total_sections", "analyzed_sections", (F.col("total_sections") - F.col("analyzed_sections")).alias("failed_chunks"), F.coalesce("cited_blocks", F.lit(0)).alias("cited_blocks"))


#: The texts of an issue: its name in a response and the most characters kept; lists keep 12.
ISSUE_TEXTS = {"claim": ("claim", 1600), "court_fact": ("courtFact", 2000), "reasoning": ("reasoning", 2400), "conclusion": ("conclusion", 1600)}
ISSUE_COLUMNS = ["doc_id", "issue_id", "ord", "title", "stage", *ISSUE_TEXTS, "evidence", "laws", "page", "status", "confidence_pct", "source_type", "source_anchors"]


def normalize_map_issues(parsed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Judgment candidates: at most 10 a chunk, named ``{chunk}-issue-{n}``; a row with neither a text besides its title nor an id goes."""
    n = parsed.select("doc_id", "chunk_id", F.posexplode("parsed.issues").alias("ord", "n")).where("ord < 10")
    r = n.select(
        "doc_id", "chunk_id", "ord", F.concat_ws("-issue-", "chunk_id", (F.col("ord") + 1).cast("string")).alias("candidate_id"), said(F.col("n.title"), 100, numbered(ISSUE)).alias("title"), said(F.col("n.stage"), 40, STAGE).alias("stage"), *[said(F.col(f"n.{f}"), most).alias(c) for c, (f, most) in ISSUE_TEXTS.items()],
        strings(F.col("n.evidence"), 12).alias("evidence"), strings(F.col("n.laws"), 12).alias("laws"), strings(F.col("n.sourceBlockIds"), 24).alias("block_ids"), _confidence(F.col("n.confidence"), 70).alias("confidence_pct"),
    )
    r = _in_chunks(r, chunks).withColumn("block_ids", _inside("block_ids", 24)).drop("_allowed")
    return r.where((F.concat(*ISSUE_TEXTS) != "") | (F.size("block_ids") > 0))


def _own_issues(parsed: DataFrame, stage: str) -> DataFrame:
    f = parsed.where(F.col("stage") == stage).select("doc_id", F.posexplode("parsed.issues").alias("ord", "n")).where("ord < 18")
    texts = [F.col(f"n.{f}").alias(c) for c, (f, _) in ISSUE_TEXTS.items()]
    return f.select("doc_id", "ord", "n.title", "n.stage", *texts, "n.evidence", "n.laws", "n.confidence", strings(F.col("n.candidateIds"), 12).alias("candidate_ids"), strings(F.col("n.sourceBlockIds"), 24).alias("own_ids"))


def _with_page(issues: DataFrame) -> DataFrame:
    first = F.get("source_anchors", F.lit(0))["page"]
    return issues.withColumn("issue_id", numbered("ai-issue-")).withColumn("page", F.coalesce(first, F.lit(1))).withColumn("status", F.lit(PENDING)).select(*ISSUE_COLUMNS)


def synthesize_issues(parsed: DataFrame, candidates: DataFrame, blocks: DataFrame, stage: str = "reduce") -> DataFrame:
    """Final issues: at most 18, else the first 14 candidates; what is blank is taken from the first candidate named that has it."""
    final = _own_issues(parsed, stage)
    texts = ["title", "stage", *ISSUE_TEXTS]
    j = _with_candidates(final, candidates, blocks, [*texts, "evidence", "laws"], 14, 30)
    from_any = lambda c: F.get(F.filter(F.transform("inherited", lambda x: strip(x[c])), lambda x: x != ""), F.lit(0))
    every = lambda c: F.slice(F.array_distinct(F.flatten(F.transform("inherited", lambda x: x[c]))), 1, 16)
    own = {c: filled(F.col(c), from_any(c)) for c in ISSUE_TEXTS} | {"title": filled(F.col("title"), from_any("title"), numbered(ISSUE)), "stage": filled(F.col("stage"), from_any("stage"), STAGE)}
    own |= {c: F.when(F.size(strings(F.col(c), 12)) > 0, strings(F.col(c), 12)).otherwise(every(c)) for c in ("evidence", "laws")}
    rest = [c for c in j.columns if c not in (*own, "inherited")]
    return _with_page(j.select(*rest, F.explode(F.array(F.struct(*[v.alias(c) for c, v in own.items()]))).alias("z")).select(*rest, "z.*"))


def full_text_issues(parsed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Issues of a one-response analysis: at most 18, without candidates, with up to 24 ids each."""
    j = _judged(anchors(_own_issues(parsed, "full_text"), "own_ids", blocks, ["doc_id", "ord"]), F.lit(None).cast("double"))
    own = {c: said(F.col(c), most) for c, (_, most) in ISSUE_TEXTS.items()} | {c: strings(F.col(c), 12) for c in ("evidence", "laws")}
    own |= {"title": said(F.nullif("title", F.lit("")), 100, numbered(ISSUE)), "stage": said(F.nullif("stage", F.lit("")), 40, STAGE)}
    return _with_page(j.withColumns(own))


def case_summary(parsed: DataFrame, issues: DataFrame, docs: DataFrame | None = None, stages: tuple[str, ...] = ("reduce", "full_text")) -> DataFrame:
    """Case data of each document that has an answer or issues; a missing result is the last conclusion.

    The core question is the claim of the first issue whose stage or title names a dispute; the topic is the cause, or the title.
    """
    names = {"caseNumber": "case_number", "court": "court", "cause": "cause", "documentType": "document_type", "procedure": "procedure", "decisionDate": "decision_date", "result": "result"}
    c = parsed.where(F.col("stage").isin(*stages)).groupBy("doc_id").agg(*[F.max(f"parsed.caseSummary.{n}").alias(f"_{out}") for n, out in names.items()])
    dispute = F.col("stage").contains(DISPUTE) | F.col("title").contains(DISPUTE)
    g = issues.groupBy("doc_id").agg(F.max_by("conclusion", F.when(F.col("conclusion") != "", F.col("ord"))).alias("last"), F.min_by("claim", F.when(dispute, F.col("ord"))).alias("core_question"))
    j = c.join(g, "doc_id", "full")
    j = j.withColumn("title", F.lit(None).cast("string")) if docs is None else j.join(docs.select("doc_id", "title"), "doc_id", "left")
    defaults = {"document_type": F.lit(DOCUMENT_TYPE), "procedure": F.lit(PROCEDURE), "result": F.col("last")}
    return j.select("doc_id", *[F.coalesce(f"_{out}", defaults.get(out, F.lit("")), F.lit("")).alias(out) for out in names.values()], F.coalesce("_cause", "title", F.lit("")).alias("surface_topic"), F.coalesce("core_question", F.lit("")).alias("core_question"), F.coalesce("_result", "last", F.lit("")).alias("core_conclusion"), F.lit(JUDGMENT_PARADIGM).alias("paradigm"), F.lit(JUDGMENT_BOUNDARY).alias("boundary"))


def token_usage(responses: DataFrame) -> DataFrame:
    """Requests and tokens per document."""
    total = lambda c: F.sum(F.coalesce(f"usage.{c}", F.lit(0))).alias(c)
    return responses.groupBy("doc_id").agg(F.count("*").alias("requests"), total("prompt_tokens"), total("completion_tokens"), total("total_tokens"))


#: Warnings kept of a map response and of another one, by kind of document.
WARNINGS = {"paper": (10, 1 << 30), "judgment": (12, 30)}


def merge_warnings(parsed: DataFrame, chunks: DataFrame, kind: str = "paper", most: int = 30) -> DataFrame:
    """doc_id, warnings: those of map responses in the order of their chunks, then of the last response, each once.

    Judgments' warnings are trimmed and blank ones go; papers' are as they were said, those of a one-response analysis even twice.
    """
    of_map, of_last = WARNINGS[kind]
    some = lambda n: strings(F.col("parsed.warnings"), n) if kind == "judgment" else F.slice(listed("parsed.warnings"), 1, n)
    w = F.when(F.col("stage") == "map", some(of_map)).otherwise(some(of_last))
    j = parsed.join(chunks.select("doc_id", "chunk_id", F.col("ord").alias("_ord")), ["doc_id", "chunk_id"], "left")
    g = j.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((F.col("stage") != "map").alias("late"), "_ord", "chunk_id", w.alias("w")))).alias("w"), F.bool_and(F.col("stage") == "full_text").alias("whole"))
    every = F.flatten(F.transform("w", lambda x: x["w"]))
    kept = every if kind == "paper" else F.array_distinct(every)
    return g.select("doc_id", F.slice(F.when(F.col("whole"), kept).otherwise(F.array_distinct(every)), 1, most).alias("warnings"))


def partial_sections(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates as provisional nodes of documents that have no final ones: inference, without anchors."""
    c = candidates.hint("merge").join(nodes.select("doc_id").distinct(), "doc_id", "left_anti")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_ord", "ord")) - 1
    kind = nodes.schema["source_anchors"].dataType
    return c.select("doc_id", F.concat(F.lit("partial-"), "candidate_id").alias("node_id"), n.alias("ord"), "title", "role", "attribution", "summary", "reasons", "confidence_pct", F.lit("ai_inference").alias("source_type"), F.lit("unread").alias("user_status"), F.array().cast(kind).alias("source_anchors"))


def library_projection(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The library's rows: page of the first anchor, four excerpts of 90 characters, the document's page and confidence in percent."""
    first = F.get("source_anchors", F.lit(0))
    d = docs.select("doc_id", F.floor(F.coalesce("average_confidence", F.lit(0.0)) * 100 + 0.5).cast("int").alias("document_confidence"), F.coalesce(F.nullif("current_page", F.lit(0)), F.lit(1)).alias("current_page"))
    return nodes.join(d, "doc_id", "left").select("doc_id", "node_id", "ord", "title", F.coalesce(first["page"], F.lit(1)).alias("page"), F.transform(F.slice("source_anchors", 1, 4), lambda a: head(a["text"], 90)).alias("materials"), "confidence_pct", "document_confidence", "current_page")


#: States that a reader may give a node or an issue.
NODE_STATUSES = ["unread", "passed", "read", "understood", "doubt", "disagree", "saved"]
ISSUE_STATUSES = ["已完成", "进行中", "待读取"]


def apply_user_status(rows: DataFrame, edits: DataFrame, key: str, statuses: list[str], column: str = "user_status") -> tuple[DataFrame, DataFrame]:
    """Rows with their new status, and the edits refused: unknown status or unknown target."""
    good = F.coalesce(F.col("new_status").isin(statuses), F.lit(False))
    e = edits.withColumnRenamed("status", "new_status")
    last = e.where(good).groupBy("doc_id", key).agg(F.max_by("new_status", "updated_at").alias("new_status"))
    out = rows.join(last, ["doc_id", key], "left").withColumn(column, F.coalesce("new_status", column)).drop("new_status")
    unknown = e.where(good).join(rows.select("doc_id", key), ["doc_id", key], "left_anti").withColumn("reason", F.lit("unknown target"))
    return out, e.where(~good).withColumn("reason", F.lit("unknown status")).unionByName(unknown)
