"""Markdown reports, one text per project or document, built from ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, report: lines joined in order."""
    return lines.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("report"))


PROJECT_ORDER, MATRIX_ORDER = ["part", "doc", "item"], ["part", "item"]


def project_lines(projects: DataFrame, docs: DataFrame, conclusions: DataFrame, cards: DataFrame) -> DataFrame:
    """Question, the conclusion of each active document, verified cards as bullets: a row a line, with its place."""
    head = projects.select("project_id", F.lit(0).alias("part"), F.lit("").alias("doc"), F.lit("").alias("item"), F.concat(F.lit("# "), "title", F.lit("\n\n研究问题："), F.coalesce("question", F.lit("")), F.lit("\n")).alias("line"))
    active = docs.where("archived_at is null").join(conclusions, "doc_id", "left")
    d = active.select("project_id", F.lit(1).alias("part"), F.col("doc_id").cast("string").alias("doc"), F.lit("").alias("item"), F.concat(F.lit("## "), "title", F.lit("\n\n"), F.coalesce("conclusion", F.lit(""))).alias("line"))
    c = cards.where("verify_status = '已核验'").join(active.select("doc_id"), "doc_id", "left_semi").select("project_id", F.lit(1).alias("part"), F.col("doc_id").cast("string").alias("doc"), F.col("card_id").cast("string").alias("item"), F.concat(F.lit("- "), "title", F.lit("："), F.coalesce("excerpt", F.lit("")), F.lit("（第 "), F.col("page").cast("string"), F.lit(" 页）")).alias("line"))
    return head.unionByName(d).unionByName(c)


def project_report(projects: DataFrame, docs: DataFrame, conclusions: DataFrame, cards: DataFrame) -> DataFrame:
    """project_id, report: the lines of each project in one text."""
    return joined(project_lines(projects, docs, conclusions, cards), "project_id", PROJECT_ORDER)


def matrix_lines(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """The matrix rows given (filtered or not) as a Markdown table per project: a row a line, with its place."""
    head = projects.select("project_id", F.lit(0).alias("part"), F.lit("").alias("item"), F.concat(F.lit("# 写作引用清单\n研究问题："), F.coalesce("question", F.lit("")), F.lit("\n\n| 写作章节 | 使用方式 | 材料类型 | 原文定位 |\n| --- | --- | --- | --- |")).alias("line"))
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), cell("issue"), F.lit(" | "), cell("stance"), F.lit(" | "), cell("evidence_type"), F.lit(" | "), cell("doc_title"), F.lit("，第 "), cell("page"), F.lit(" 页："), cell("title"), F.lit(" |"))
    return head.unionByName(rows.select("project_id", F.lit(1).alias("part"), F.col("row_key").alias("item"), line.alias("line")))


def matrix_report(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, report: the table of each project in one text."""
    return joined(matrix_lines(rows, projects), "project_id", MATRIX_ORDER)


def citation_list_report(citations: DataFrame) -> DataFrame:
    """Numbered formatted citations per document."""
    return joined(citations.select("doc_id", "n", F.concat(F.col("n").cast("string"), F.lit(". "), "formatted").alias("line")), "doc_id", ["n"])


def draft_report(drafts: DataFrame, cards: DataFrame) -> DataFrame:
    """project_id, outline_id, report: the draft with numbered notes from the cards it cites."""
    notes = drafts.select("project_id", "outline_id", F.posexplode("citation_card_ids").alias("pos", "card_id")).join(cards.select(F.col("card_id").cast("string").alias("card_id"), "source", "page", "excerpt"), "card_id")
    line = F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("] "), F.coalesce("source", F.lit("")), F.lit("，第 "), F.col("page").cast("string"), F.lit(" 页："), F.coalesce("excerpt", F.lit("")))
    g = notes.select("project_id", "outline_id", "pos", line.alias("line")).groupBy("project_id", "outline_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("notes"))
    return drafts.join(g, ["project_id", "outline_id"], "left").select("project_id", "outline_id", F.concat(F.coalesce("content", F.lit("")), F.when(F.col("notes").isNotNull(), F.concat(F.lit("\n\n"), "notes")).otherwise("")).alias("report"))


def write_reports(reports: DataFrame, path: str, key: str) -> None:
    """One folder of text files per key."""
    reports.select(F.col("report").alias("value"), key).write.partitionBy(key).text(path)


def write_lines(lines: DataFrame, path: str, key: str, order: list[str]) -> None:
    """One folder of text files per key, whose files, by name, hold its lines in order.

    Lines are dealt out by ranges of key and place, so a report of any size is never one row or one task.
    """
    lines.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(F.col("line").alias("value"), key).write.partitionBy(key).text(path)
