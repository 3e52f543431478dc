"""Job tables: roll-ups, work lists, stale work, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import round_half_up

ACTIVE = ["queued", "running"]
#: Stage, its label and its progress; null progress comes from the share done.
STAGES = [
    ("uploaded", "已上传，等待解析", 2),
    ("extracting_text", "提取 PDF 文字层", 12),
    ("awaiting_ocr", "等待 AI OCR", 100),
    ("kimi_ocr", "AI 正在识别页面", None),
    ("formatting", "整理文档结构", 10),
    ("format_complete", "文档结构整理完成", 100),
    ("ocr_failed", "识别过程遇到问题", 0),
    ("parse_failed", "PDF 解析失败", 0),
    ("preparing_sections", "准备分析章节", 8),
    ("analyzing_full_text", "AI 正在全文分析", 15),
    ("analyzing_sections", "AI 正在逐段分析", None),
    ("analyzing_judgment_sections", "AI 正在逐段分析", None),
    ("synthesizing_argument", "AI 正在综合论证结构", 82),
    ("synthesizing_judgment", "AI 正在综合裁判结构", 82),
    ("finalizing_anchors", "AI 正在关联原文依据", 94),
    ("finalizing_judgment_anchors", "AI 正在关联原文依据", 94),
    ("analysis_ready", "AI 阅读辅助已就绪", 100),
    ("analysis_failed", "AI 分析失败", 0),
    ("review", "可阅读", 0),
    ("ready", "可阅读 · AI 辅助就绪", 0),
]
#: The stage whose progress is all of the share done; of the others it is 10 to 75.
RECOGNISING = "kimi_ocr"


def job_rollup(page_results: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Per job: completed, failed, processed, total, progress, generated_characters, status.

    page_results: job_id, page, status ('completed' or 'failed'), characters; of repeated pages all rows count.
    All failed is failed, some failed partial; before the total is reached the job runs.
    """
    g = page_results.groupBy("job_id").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("characters"))), F.lit(0)).alias("generated_characters"))
    g = g.withColumn("processed", F.col("completed") + F.col("failed"))
    g = g.withColumn("total", F.col("processed")) if totals is None else g.join(totals.select("job_id", "total"), "job_id", "left")
    progress = F.when(F.col("total") > 0, round_half_up(100 * F.col("processed") / F.col("total"))).otherwise(0).cast("int")
    status = F.when(F.col("processed") < F.col("total"), "running").when(F.col("processed") == 0, "queued").when(F.col("completed") == 0, "failed").when(F.col("failed") > 0, "partial").otherwise("completed")
    return g.withColumn("progress", progress).withColumn("status", status)


def type_family(c: Column) -> Column:
    """Job types that must not run at once: all kinds of OCR, all kinds of analysis."""
    return F.when(c.startswith("ocr"), "ocr").when(c.startswith("analy"), "analysis").otherwise(c)


def pending_work(requests: DataFrame, jobs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Requests (doc_id, type, forced, requested_at) without an active job of their family; the first per document and family.

    A completed analysis is not repeated unless forced.
    """
    r = requests.withColumn("family", type_family(F.col("type")))
    busy = jobs.where(F.col("status").isin(ACTIVE)).select("doc_id", type_family(F.col("type")).alias("family")).distinct()
    r = r.join(busy, ["doc_id", "family"], "left_anti")
    if docs is not None:
        done = docs.where("analysis_status = 'completed'").select("doc_id", F.lit("analysis").alias("family")).withColumn("_done", F.lit(True))
        r = r.join(done, ["doc_id", "family"], "left").where("_done is null or coalesce(forced, false)").drop("_done")
    return r.groupBy("doc_id", "family").agg(F.min_by(F.struct("type", "forced", "requested_at"), "requested_at").alias("r")).select("doc_id", "family", "r.*")


def fail_stale_jobs(jobs: DataFrame, reason: str = "interrupted") -> DataFrame:
    stale = F.col("status").isin(ACTIVE)
    return jobs.withColumn("error", F.when(stale, reason).otherwise(F.col("error"))).withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def reclassify_stale(docs: DataFrame, parsing_version: str) -> tuple[DataFrame, DataFrame]:
    """Documents whose interrupted OCR or analysis goes back to review, and the list to parse again."""
    stale = F.col("status").isin("analyzing", "ocr")
    out = docs.withColumn("error", F.when(stale, F.concat(F.col("status"), F.lit(" interrupted"))).otherwise(F.col("error"))).withColumn("status", F.when(stale, "review").otherwise(F.col("status")))
    retry = docs.where(F.col("status").isin("uploaded", "parsing") | ~F.col("parsing_version").eqNullSafe(F.lit(parsing_version))).select("doc_id")
    return out, retry


def ocr_doc_status(rollup: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, ocr_status, status after an OCR job: rollup has doc_id and failed."""
    f = rollup.groupBy("doc_id").agg(F.sum("failed").alias("failed"))
    analysed = F.coalesce("has_analysis", F.lit(False)) if "has_analysis" in docs.columns else F.lit(False)
    return docs.join(f, "doc_id").select("doc_id", F.when(F.col("failed") > 0, "partial").otherwise("completed").alias("ocr_status"), F.when(analysed, "ready").otherwise("review").alias("status"))


def progress_stage(jobs: DataFrame) -> DataFrame:
    """Adds stage_label and value. A stage without a label is its own; pages recognised count fully, sections from 10 to 75."""
    dim = F.broadcast(jobs.sparkSession.createDataFrame(STAGES, "stage string, stage_label string, base int"))  # twenty rows
    share = F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0)
    by_share = F.when(F.col("stage") == RECOGNISING, round_half_up(100 * share)).otherwise(F.lit(10) + round_half_up(65 * share))
    value = F.when(F.col("stage_label").isNull(), 0).otherwise(F.coalesce(F.col("base").cast("long"), by_share))
    return jobs.join(dim, "stage", "left").withColumn("value", value.cast("int")).withColumn("stage_label", F.coalesce("stage_label", "stage")).drop("base")
