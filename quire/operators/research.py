"""Documents' life, research cards, evidence matrix, progress and review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import falsy_coalesce, round_half_up
from quire.operators.footnotes import nearest_match

VERIFIED, DONE, PENDING, RUNNING = "已核验", "已完成", "待核验", "进行中"
#: How far a document of each status is.
STATUS_WEIGHT = {"uploaded": 8, "parsing": 20, "ocr": 35, "review": 48, "analyzing": 62, "ready": 72, "failed": 5}
#: Rules that name the issue of a card, in order, and the name if none holds.
ISSUE_RULES = [("人格|控制|调度|管理", "平台控制与人格从属性"), ("经济|收入|依赖", "经济从属性的判断"), ("组织|管理|劳动关系", "劳动关系的认定标准"), ("证据|事实", "事实与证据评价"), ("法律|法条|规范", "法律规范的适用"), ("责任|裁判|赔偿", "裁判结论与责任分配")]
UNSORTED = "待归类争点"
STANCES = ["支持", "反对", "条件性", "背景"]


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """The newest document of each project, kind and content hash; documents without a hash all stay."""
    # the maximum is combined before the shuffle, so a content that very many documents share is no hot group
    row = F.struct(*docs.columns)
    newest = F.max_by(row, F.struct("created_at", "doc_id")).alias("r")
    hashed = docs.where("content_hash is not null and content_hash <> ''").groupBy("project_id", "kind", "content_hash").agg(newest).select("r.*")
    return hashed.unionByName(docs.where("content_hash is null or content_hash = ''"))


def derive_lifecycle(docs: DataFrame, has_analysis: str | None = "has_analysis") -> DataFrame:
    """Reading, OCR and analysis status where they are missing, from the older single status."""
    pages, low = F.coalesce(F.col("page_count"), F.lit(0)) > 0, F.size(F.coalesce("low_confidence_pages", F.array().cast("array<int>"))) > 0
    analysed = F.coalesce(F.col(has_analysis), F.lit(False)) if has_analysis in docs.columns else F.lit(False)
    s = F.col("status")
    reading = F.when((s == "failed") & ~pages, "error").when(~pages, "processing").when(low, "partial").otherwise("readable")
    ocr = F.when(s == "ocr", "running").when(low, "idle").when(pages, "completed").otherwise("idle")
    analysis = F.when(s == "analyzing", "running").when(analysed, "completed").otherwise("idle")
    for name, value in (("reading_status", reading), ("ocr_status", ocr), ("analysis_status", analysis)):
        docs = docs.withColumn(name, F.coalesce(name, value) if name in docs.columns else value)
    return docs


def anchored(c: str = "source_anchors") -> Column:
    return F.coalesce(F.size(F.col(c)) > 0, F.lit(False))


def demote_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("user_status", F.when(~anchored() & (F.col("user_status") == "understood"), "doubt").otherwise(F.col("user_status")))


def demote_issues(issues: DataFrame) -> DataFrame:
    return issues.withColumn("status", F.when(~anchored() & (F.col("status") == DONE), RUNNING).otherwise(F.col("status")))


def demote_cards(cards: DataFrame) -> DataFrame:
    return cards.withColumn("verify_status", F.when(F.col("source_anchor").isNull() & (F.col("verify_status") == VERIFIED), PENDING).otherwise(F.col("verify_status")))


def _weight(status: Column) -> Column:
    out = F.lit(0)
    for name, value in STATUS_WEIGHT.items():
        out = F.when(status == name, value).otherwise(out)
    return out


def project_progress(docs: DataFrame, nodes: DataFrame, issues: DataFrame, cards: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """project_id, progress 0..100 from status, reading, verified evidence and verified cards of active documents."""
    active = docs.where("archived_at is null").select("doc_id", "project_id", "status", "page_count", "current_page")
    share = F.when(F.coalesce("page_count", F.lit(0)) > 0, F.coalesce("current_page", F.lit(0)) / F.col("page_count")).otherwise(0.0)
    base = active.groupBy("project_id").agg((F.avg(_weight(F.col("status"))) + F.avg(share) * 12).alias("base"))
    items = nodes.select("doc_id", (anchored() & (F.col("user_status") == "understood")).alias("ok")).unionByName(issues.select("doc_id", (anchored() & (F.col("status") == DONE)).alias("ok")))
    own = active.select("doc_id", "project_id")
    evidence = items.join(own, "doc_id").groupBy("project_id").agg((F.avg(F.col("ok").cast("int")) * 12).alias("evidence"))
    ok = F.col("source_anchor").isNotNull() & (F.col("verify_status") == VERIFIED)
    quality = cards.join(own, ["doc_id", "project_id"], "left_semi").groupBy("project_id").agg((F.avg(F.coalesce(ok, F.lit(False)).cast("int")) * 4).alias("quality"))
    out = base if projects is None else projects.select("project_id").join(base, "project_id", "left")
    out = out.join(evidence, "project_id", "left").join(quality, "project_id", "left").fillna(0.0, ["base", "evidence", "quality"])
    return out.select("project_id", F.least(F.lit(100), round_half_up(F.col("base") + F.col("evidence") + F.col("quality"))).cast("int").alias("progress"))


def review_queue(docs: DataFrame, nodes: DataFrame, issues: DataFrame, cards: DataFrame) -> DataFrame:
    """What a reader still has to check, most urgent first: task_id, kind, doc_id, target_id, title, label, detail, rank, ord."""
    active = docs.where("archived_at is null").select("doc_id", "project_id", F.col("title").alias("doc_title"))
    s, a = F.col("user_status"), anchored()
    n = nodes.where(~a | s.isin("doubt", "disagree", "unread")).join(active, "doc_id").select(
        F.concat_ws("-", F.lit("paper"), F.col("doc_id").cast("string"), "node_id").alias("task_id"), F.lit("paper").alias("kind"), "project_id", "doc_id", F.col("node_id").alias("target_id"), "title", F.col("doc_title").alias("source"),
        F.when(~a, "缺少依据").when(s == "doubt", "存疑").when(s == "disagree", "有分歧").otherwise("待读取").alias("label"),
        F.when(~a, "AI 结论缺少真实原文依据").when(s == "doubt", "理解存疑，需要回到原文判断").when(s == "disagree", "与 AI 判断存在分歧").otherwise("尚未核验原文依据").alias("detail"),
        F.when(s.isin("doubt", "disagree"), 1).otherwise(4).alias("rank"), "ord",
    )
    t = F.col("status")
    i = issues.where(~a | (t != DONE)).join(active, "doc_id").select(
        F.concat_ws("-", F.lit("judgment"), F.col("doc_id").cast("string"), "issue_id").alias("task_id"), F.lit("judgment").alias("kind"), "project_id", "doc_id", F.col("issue_id").alias("target_id"), "title", F.col("doc_title").alias("source"),
        F.when(~a, "缺少依据").otherwise(t).alias("label"),
        F.when(~a, "裁判推理缺少真实原文依据").when(t == RUNNING, "正在核验法院事实、证据与说理").otherwise("尚未核验裁判原文").alias("detail"),
        F.when(t == RUNNING, 2).otherwise(5).alias("rank"), "ord",
    )
    c = cards.where(F.col("verify_status") != VERIFIED).join(active.select("doc_id"), "doc_id", "left_semi").select(
        F.concat(F.lit("card-"), F.col("card_id").cast("string")).alias("task_id"), F.lit("card").alias("kind"), "project_id", "doc_id", F.col("card_id").cast("string").alias("target_id"), "title", "source", F.col("verify_status").alias("label"), F.lit("研究卡片尚未完成原文核验").alias("detail"), F.lit(3).alias("rank"), F.lit(0).alias("ord"),
    )
    return reduce(DataFrame.unionByName, [x.withColumn("target_id", F.col("target_id").cast("string")) for x in (n, i, c)]).orderBy("rank", "project_id", "doc_id", "ord", "task_id")


def infer_issue(title: Column, text: Column) -> Column:
    value, out = F.concat_ws(" ", title, text), F.lit(UNSORTED)
    for pattern, name in reversed(ISSUE_RULES):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def matrix_rows(cards: DataFrame, docs: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per card of an active document; saved entries come before what the card itself tells."""
    active = docs.where("archived_at is null").select("doc_id", F.col("title").alias("doc_title"))
    saved = entries.select(F.col("source_key").alias("row_key"), *[F.col(c).alias(f"s_{c}") for c in ("issue", "stance", "evidence_type", "note")])
    j = cards.join(active, "doc_id").withColumn("row_key", F.concat(F.lit("card:"), F.col("card_id").cast("string"))).join(saved, "row_key", "left")
    issue = falsy_coalesce(F.col("s_issue"), F.col("outline_node"), infer_issue(F.col("title"), F.concat_ws(" ", "excerpt", F.concat_ws(" ", "tags"))))
    stance = falsy_coalesce(F.col("s_stance"), F.when(F.col("relation").isin(STANCES), F.col("relation")).otherwise("待判断"))
    evidence = falsy_coalesce(F.col("s_evidence_type"), F.when(F.col("type") == "规范卡", "规范依据").otherwise("用户摘录"))
    return j.select("row_key", "project_id", "doc_id", "doc_title", "title", F.col("excerpt").alias("summary"), F.coalesce("source_anchor.page", "page").alias("page"), issue.alias("issue"), stance.alias("stance"), evidence.alias("evidence_type"), F.coalesce(F.col("verify_status") == VERIFIED, F.lit(False)).alias("verified"), F.coalesce("s_note", "note").alias("note"))


def matrix_kpis(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id").agg(F.count("*").alias("rows"), F.count_if("verified").alias("verified"), F.count_if(F.col("stance").isin("反对", "条件性")).alias("conflicts"), F.count_distinct("issue").alias("issues"))


def matrix_filter(rows: DataFrame, issue: str | None = None, stance: str | None = None) -> DataFrame:
    if issue:
        rows = rows.where(F.col("issue") == issue)
    return rows.where(F.col("stance") == stance) if stance else rows


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], policy: str = "replace", at: str = "updated_at", protect: tuple[str, ...] = ()) -> DataFrame:
    """Keyed upsert. ``replace``: the newest change takes the row's place. ``overlay``: only fields that are not null do.

    ``protect``: columns that keep the stored value if there is one.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    newest = changes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    if policy == "replace" and not protect:
        return table.join(newest.select(*keys), keys, "left_anti").unionByName(newest, allowMissingColumns=True)
    names = [c for c in table.columns if c not in keys]
    n = newest.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in names if c in newest.columns])
    j = table.join(n, keys, "full")

    def value(c: str) -> Column:
        if f"_{c}" not in n.columns:
            return F.col(c)
        if c in protect:
            return F.coalesce(c, f"_{c}")
        return F.coalesce(f"_{c}", c) if policy == "overlay" else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))

    return j.select(*keys, *[value(c).alias(c) for c in names]).select(*table.columns)


def insert_cards_dedup(cards: DataFrame, new: DataFrame) -> DataFrame:
    key = ["doc_id", "type", "page", "excerpt"]
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("card_id"))).where("_rn = 1").drop("_rn")
    c = cards.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = reduce(lambda a, b: a & b, [first[k].eqNullSafe(c[f"_{k}"]) for k in key])
    return cards.unionByName(first.join(c, same, "left_anti"), allowMissingColumns=True)


def card_from_node(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    first = F.get("source_anchors", F.lit(0))
    return nodes.where(anchored()).join(docs.select("doc_id", "project_id", F.col("title").alias("source")), "doc_id").select(F.concat_ws("-", F.lit("card"), F.col("doc_id").cast("string"), "node_id").alias("card_id"), "project_id", "doc_id", F.lit("观点卡").alias("type"), "title", first["text"].alias("excerpt"), F.col("summary").alias("note"), "source", first["page"].alias("page"), F.lit(PENDING).alias("verify_status"), F.lit("支持").alias("relation"), F.col("node_id").alias("target_id"), first.alias("source_anchor"))


def card_from_issue(issues: DataFrame, docs: DataFrame) -> DataFrame:
    first = F.get("source_anchors", F.lit(0))
    return issues.where(anchored()).join(docs.select("doc_id", "project_id", F.col("title").alias("source")), "doc_id").select(F.concat_ws("-", F.lit("card"), F.col("doc_id").cast("string"), "issue_id").alias("card_id"), "project_id", "doc_id", F.lit("案例卡").alias("type"), "title", first["text"].alias("excerpt"), F.col("conclusion").alias("note"), "source", first["page"].alias("page"), F.lit(PENDING).alias("verify_status"), F.lit("背景").alias("relation"), F.col("issue_id").alias("target_id"), first.alias("source_anchor"))


def verify_gate(edits: DataFrame, has_anchor: Column) -> tuple[DataFrame, DataFrame]:
    """Edits that may mark a thing verified, done or understood, and those refused."""
    ok = F.coalesce(has_anchor, F.lit(False))
    return edits.where(ok), edits.where(~ok).withColumn("reason", F.lit("no source anchor"))


def cascade_delete(tables: dict[str, DataFrame], doc_ids: DataFrame | None = None, project_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without the rows of deleted documents, or of deleted projects (matrix entries and drafts too)."""
    out = dict(tables)
    if doc_ids is not None:
        ids = doc_ids.select("doc_id").distinct()
        out = {k: t.join(ids, "doc_id", "left_anti") if "doc_id" in t.columns else t for k, t in out.items()}
    if project_ids is not None:
        ids = project_ids.select("project_id").distinct()
        docs = out["documents"].join(ids, "project_id", "left_semi").select("doc_id") if "documents" in out else None
        out = {k: t.join(ids, "project_id", "left_anti") if "project_id" in t.columns else t.join(docs, "doc_id", "left_anti") if docs is not None and "doc_id" in t.columns else t for k, t in out.items()}
    return out


def replace_project_docs(docs: DataFrame, server_docs: DataFrame, project_id) -> DataFrame:
    """Documents of one project that came from the server (their id is a UUID) are replaced, others stay."""
    uuid = F.col("doc_id").cast("string").rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
    return docs.where(~((F.col("project_id") == project_id) & uuid)).unionByName(server_docs.where(F.col("project_id") == project_id), allowMissingColumns=True)


def nearest_target(cards: DataFrame, targets: DataFrame) -> DataFrame:
    """Cards without a target get the node or issue (doc_id, page, target_id) of their document on the nearest page."""
    open_cards = cards.where("target_id is null").drop("target_id")
    found = nearest_match(open_cards, targets, ["doc_id"], "page", "target_id")
    return cards.where("target_id is not null").unionByName(found)


def document_conclusion(docs: DataFrame, nodes: DataFrame, issues: DataFrame, list_view: bool = False) -> DataFrame:
    """doc_id, conclusion: the summary's, else the last node's summary, else the last issue's finding, else a placeholder.

    The list view takes a node of conclusion role, or an issue in progress, first.
    """
    n = nodes.groupBy("doc_id").agg(F.max_by("summary", "ord").alias("last_node"), F.min_by("summary", F.when(F.col("role").contains("结论"), F.col("ord"))).alias("role_node"))
    i = issues.groupBy("doc_id").agg(F.max_by("court_fact", "ord").alias("last_issue"), F.min_by("title", F.when(F.col("status") == RUNNING, F.col("ord"))).alias("running_issue"))
    j = docs.join(n, "doc_id", "left").join(i, "doc_id", "left")
    own = F.col("conclusion") if "conclusion" in docs.columns else F.lit(None).cast("string")
    order = [F.col("role_node"), F.col("running_issue"), own] if list_view else [own]
    return j.select("doc_id", falsy_coalesce(*order, F.col("last_node"), F.col("last_issue"), F.lit("尚未形成结论")).alias("conclusion"))


def results_kpis(docs: DataFrame, nodes: DataFrame, issues: DataFrame, cards: DataFrame) -> DataFrame:
    """Per project: analysed documents, cards, verified cards and their percentage."""
    has = nodes.select("doc_id").union(issues.select("doc_id")).distinct()
    d = docs.where("status = 'ready'").join(has, "doc_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("analyzed_documents"))
    c = cards.groupBy("project_id").agg(F.count("*").alias("cards"), F.count_if(F.col("verify_status") == VERIFIED).alias("verified"))
    out = d.join(c, "project_id", "full").fillna(0)
    return out.withColumn("verified_percent", F.when(F.col("cards") > 0, round_half_up(100 * F.col("verified") / F.col("cards"))).otherwise(0).cast("int"))


def paper_overview(nodes: DataFrame) -> DataFrame:
    """Per paper: anchored nodes, pending nodes, the first question's and the last conclusion's summary (else the first and last node's)."""
    question, conclusion = F.col("role").rlike("问题"), F.col("role").rlike("结论")
    return nodes.groupBy("doc_id").agg(
        F.count_if(anchored()).alias("anchored_nodes"), F.count_if(F.col("user_status").isin("unread", "doubt", "disagree")).alias("pending_nodes"),
        F.coalesce(F.min_by("summary", F.when(question, F.col("ord"))), F.min_by("summary", "ord")).alias("question"), F.coalesce(F.max_by("summary", F.when(conclusion, F.col("ord"))), F.max_by("summary", "ord")).alias("conclusion"),
    )


def footnote_for_card(cards: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds footnote, quote_text and paraphrase_text to cards."""
    d = docs.select("doc_id", F.col("author").alias("_a"), F.col("title").alias("_t"), F.col("source").alias("_s"))
    note = F.concat(F.coalesce("_a", F.lit("")), F.when(F.coalesce("_a", F.lit("")) != "", "：").otherwise(""), F.lit("《"), "_t", F.lit("》，"), F.coalesce("_s", F.lit("")), F.lit("，第"), F.col("page").cast("string"), F.lit("页。"))
    return cards.join(d, "doc_id").withColumn("footnote", note).withColumn("quote_text", F.concat(F.lit("“"), "excerpt", F.lit("”（第"), F.col("page").cast("string"), F.lit("页）"))).withColumn("paraphrase_text", F.concat(F.coalesce(F.nullif("note", F.lit("")), "excerpt"), F.lit("（第"), F.col("page").cast("string"), F.lit("页）"))).drop("_a", "_t", "_s")


def insert_citation(drafts: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations (project_id, outline_id, card_id, text, ord) appended to their drafts; an id is listed once."""
    g = citations.groupBy("project_id", "outline_id").agg(F.array_sort(F.collect_list(F.struct("ord", "card_id", "text"))).alias("c"))
    j = drafts.join(g, ["project_id", "outline_id"], "left")
    ids = F.array_distinct(F.concat(F.coalesce("citation_card_ids", F.array().cast("array<string>")), F.transform("c", lambda x: x["card_id"].cast("string"))))
    return j.withColumn("content", F.when(F.col("c").isNotNull(), F.concat(F.coalesce("content", F.lit("")), F.array_join(F.transform("c", lambda x: x["text"]), ""))).otherwise(F.col("content"))).withColumn("citation_card_ids", F.when(F.col("c").isNotNull(), ids).otherwise(F.col("citation_card_ids"))).drop("c")


def judgment_progress(issues: DataFrame) -> DataFrame:
    """doc_id, done, total, share."""
    g = issues.groupBy("doc_id").agg(F.count_if(anchored() & (F.col("status") == DONE)).alias("done"), F.count("*").alias("total"))
    return g.withColumn("share", F.col("done") / F.col("total"))


def reading_position(events: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, current_page: the page of the latest event (doc_id, page, ts), held to the document's pages."""
    last = events.groupBy("doc_id").agg(F.max_by("page", F.struct("ts", "page")).alias("page"))
    return docs.select("doc_id", "page_count").join(last, "doc_id").select("doc_id", F.greatest(F.lit(1), F.least(F.greatest(F.lit(1), F.coalesce("page_count", F.lit(1))), "page")).alias("current_page"))
