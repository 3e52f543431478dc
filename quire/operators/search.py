"""Search and filters over blocks, annotations, documents and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import squeeze
from quire.operators.footnotes import drop_page_artifacts


def search_blocks(blocks: DataFrame, query: str, limit: int = 80) -> DataFrame:
    """doc_id, block_id, page, block_type, snippet, rank, total: the first matches of each document.

    Any case, on white-space-squeezed text of readable blocks. Queries of fewer than two characters find
    nothing. The limit is the feature: total counts all matches. Only matches reach the shuffle.
    """
    q = query.strip()[:100]
    limit = max(1, min(200, limit or 80))
    t = squeeze(F.col("text"))
    hit = drop_page_artifacts(blocks).withColumn("t", t).where(F.contains(F.lower("t"), F.lit(q.lower())) if len(q) >= 2 else F.lit(False))
    at = F.position(F.lit(q.lower()), F.lower("t")) - 1
    start, end = F.greatest(F.lit(0), at - 36), F.least(F.length("t"), at + len(q) + 56)
    snippet = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(F.col("t"), start + 1, end - start), F.when(end < F.length("t"), "…").otherwise(""))
    doc = Window.partitionBy("doc_id")
    ranked = hit.withColumn("rank", F.row_number().over(doc.orderBy("page", "reading_order", "block_id"))).withColumn("total", F.count("*").over(doc))
    return ranked.where(F.col("rank") <= limit).select("doc_id", "block_id", "page", "block_type", snippet.alias("snippet"), "rank", "total")


def _has(query: str, *columns: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))


def filter_annotations(annotations: DataFrame, doc_id=None, project_id=None, tag: str | None = None, query: str | None = None) -> DataFrame:
    """All conditions given, newest first."""
    a = annotations
    if doc_id is not None:
        a = a.where(F.col("doc_id") == doc_id)
    if project_id is not None:
        a = a.where(F.col("project_id") == project_id)
    if tag:
        a = a.where(F.array_contains("tags", tag))
    if query:
        a = a.where(_has(query, F.col("text"), F.col("note"), F.concat_ws(" ", "tags")))
    return a.orderBy(F.desc("updated_at"), "annotation_id")


def display_tags() -> Column:
    """The card type and the tags, each once."""
    return F.filter(F.array_distinct(F.concat(F.array("card_type"), F.coalesce("tags", F.array().cast("array<string>")))), lambda t: t.isNotNull() & (t != ""))


def search_annotations_in_doc(annotations: DataFrame, doc_id, query: str, limit: int = 30) -> DataFrame:
    q = query.strip()
    if len(q) < 2:
        return annotations.where("false")
    return annotations.where((F.col("doc_id") == doc_id) & _has(q, F.col("text"), F.col("note"), F.concat_ws(" ", display_tags()))).orderBy("page", "start_offset", "annotation_id").limit(limit)


def filter_documents(docs: DataFrame, kind: str | None = None, query: str = "", order: str = "recent") -> DataFrame:
    """order: recent, progress (share read, least first) or title (as Chinese readers sort)."""
    d = active_documents(docs)
    if kind:
        d = d.where(F.col("kind") == kind)
    if query:
        d = d.where(_has(query, *[F.col(c) for c in ("title", "source", "author") if c in docs.columns]))
    share = F.when(F.col("page_count") > 0, F.col("current_page") / F.col("page_count")).otherwise(0.0)
    by = {"recent": [F.desc("updated_at")], "progress": [share.asc()], "title": [F.collate(F.col("title"), "zh").asc()]}[order]
    return d.orderBy(*by, "doc_id")


def filter_cards(cards: DataFrame, card_type: str | None = None, verified: bool | None = None, query: str = "") -> DataFrame:
    c = cards
    if card_type:
        c = c.where(F.col("type") == card_type)
    if verified is not None:
        is_verified = F.coalesce(F.col("verify_status") == "已核验", F.lit(False))
        c = c.where(is_verified if verified else ~is_verified)
    if query:
        c = c.where(_has(query, F.col("title"), F.col("excerpt"), F.col("note"), F.col("source"), F.concat_ws(" ", "tags")))
    return c


def library_counts(docs: DataFrame, cards: DataFrame) -> DataFrame:
    """Per project: papers, judgments, readable, processing, cards, pending cards."""
    d = active_documents(docs).groupBy("project_id").agg(
        F.count_if(F.col("kind") == "paper").alias("papers"), F.count_if(F.col("kind") == "judgment").alias("judgments"), F.count_if(F.col("reading_status").isin("readable", "partial")).alias("readable"), F.count_if(F.col("reading_status") == "processing").alias("processing")
    )
    c = cards.groupBy("project_id").agg(F.count("*").alias("cards"), F.count_if(~F.coalesce(F.col("verify_status") == "已核验", F.lit(False))).alias("pending_cards"))
    return d.join(c, "project_id", "full").fillna(0)


def cards_per_document(cards: DataFrame) -> DataFrame:
    return cards.groupBy("doc_id").agg(F.count("*").alias("cards"))


def cards_per_type(cards: DataFrame, types: list[str]) -> DataFrame:
    """A column per type; the types are given, so no pass over the data finds them."""
    return cards.groupBy("project_id").pivot("type", types).count().fillna(0)


def active_documents(docs: DataFrame, archived: bool = False) -> DataFrame:
    return docs.where(F.col("archived_at").isNotNull() if archived else F.col("archived_at").isNull())


visible_projects = active_documents


def document_summaries(docs: DataFrame, project_id=None) -> DataFrame:
    """The list view: one row per distinct document with its lifecycle, without blocks and hash."""
    from quire.operators.research import dedupe_documents, derive_lifecycle

    d = docs if project_id is None else docs.where(F.col("project_id") == project_id)
    return derive_lifecycle(dedupe_documents(d)).drop("content_hash", "blocks")


def dashboard_counts(docs: DataFrame, projects: DataFrame, progress: DataFrame) -> DataFrame:
    """Per project: documents (archived ones only count in archived projects), ready ones, progress."""
    d = docs.join(projects.select("project_id", F.col("archived_at").alias("p_archived")), "project_id").where("p_archived is not null or archived_at is null")
    n = d.groupBy("project_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready"))
    return projects.select("project_id").join(n, "project_id", "left").join(progress, "project_id", "left").fillna(0)


def latest_document(docs: DataFrame, kind: str) -> DataFrame:
    """project_id, doc_id: the newest document of a kind in each project."""
    return docs.where(F.col("kind") == kind).groupBy("project_id").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"))
