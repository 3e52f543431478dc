"""The given tables as the engine's tables.

documents: lines become blocks (eight a page), sources become projects, languages kinds; labels give
what readers decided; events are job results, tags and reading positions; conversations are ordered blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ["uploaded", "parsing", "ocr", "review", "analyzing", "ready", "failed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    b = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where(F.col("text").rlike(r"\S"))
    return b.select("doc_id", F.concat(F.lit("b"), F.lpad(F.col("pos").cast("string"), 7, "0")).alias("block_id"), (1 + F.floor(F.col("pos") / 8)).cast("int").alias("page"), F.col("pos").alias("reading_order"), F.when(F.length("text") <= 24, "heading").otherwise("paragraph").alias("block_type"), "text")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines as level-1 items."""
    b = blocks(spark, sf_dir).where(F.length("text") <= 60)
    return b.select("doc_id", F.concat(F.lit("o"), "block_id").alias("outline_id"), F.col("text").alias("title"), F.lit(1).alias("level"), "page", "block_id", F.col("reading_order").alias("ord"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("doc_id") % 7 + 1).cast("int"))
    return d.select(
        "doc_id", F.col("source").alias("project_id"), F.when(F.col("lang") == "en", "paper").otherwise("judgment").alias("kind"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("author"), "source", F.sha2("text", 256).alias("content_hash"), status.alias("status"),
        (1 + F.floor(F.col("n_chars") / 1000)).cast("int").alias("page_count"), (1 + F.floor(F.col("n_chars") / 2500)).cast("int").alias("current_page"), F.lit(None).cast("array<int>").alias("low_confidence_pages"), (F.col("doc_id") % 5 == 0).alias("has_analysis"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("2024-01-01").cast("timestamp")).alias("archived_at"), F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("created_at"), F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("updated_at"), F.lit(None).cast("string").alias("error"), F.lit("1").alias("parsing_version"),
    )


ANCHOR = "array<struct<block_id:string,page:int,text:string,bbox:array<double>>>"


def _anchors(when):
    one = F.array(F.struct(F.lit("b0000000").alias("block_id"), F.lit(1).alias("page"), F.lit("quote").alias("text"), F.lit(None).cast("array<double>").alias("bbox")))
    return F.when(when, one.cast(ANCHOR)).otherwise(F.array().cast(ANCHOR)).alias("source_anchors")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "labels").where("doc_id % 2 = 0")
    status = F.when(F.col("doc_id") % 6 == 0, "doubt").when(F.col("quality") == 1, "understood").otherwise("unread")
    return n.select("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("node_id"), F.lit(1).alias("ord"), F.concat(F.lit("Node "), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("toxic") == 1, "结论").otherwise("问题").alias("role"), F.lit("summary").alias("summary"), status.alias("user_status"), _anchors(F.col("doc_id") % 4 == 0))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "labels").where("doc_id % 2 = 1")
    status = F.when(F.col("quality") == 1, "已完成").when(F.col("doc_id") % 3 == 0, "进行中").otherwise("待读取")
    return n.select("doc_id", F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("issue_id"), F.lit(1).alias("ord"), F.concat(F.lit("Issue "), F.col("doc_id").cast("string")).alias("title"), F.lit("fact").alias("court_fact"), F.lit("held").alias("conclusion"), status.alias("status"), _anchors(F.col("doc_id") % 3 != 1))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", F.substring("text", 1, 60).alias("excerpt")), "doc_id")
    relation = F.element_at(F.array(*map(F.lit, ["支持", "反对", "条件性", "背景", "其他"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return c.select(
        F.col("doc_id").cast("string").alias("card_id"), F.col("source").alias("project_id"), "doc_id", F.when(F.col("doc_id") % 4 == 0, "规范卡").otherwise("观点卡").alias("type"), F.when(F.col("toxic") == 1, "责任与赔偿").otherwise(F.concat(F.lit("Card "), F.col("doc_id").cast("string"))).alias("title"), "excerpt", F.lit("").alias("note"), "source",
        F.lit(1).alias("page"), F.array(F.lit("t")).alias("tags"), F.when(F.col("quality") == 1, "已核验").otherwise("待核验").alias("verify_status"), relation.alias("relation"), F.when(F.col("doc_id") % 10 == 0, "第一章").otherwise("").alias("outline_node"), F.lit(None).cast("string").alias("target_id"),
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("b0000000").alias("block_id"), F.lit(2).alias("page"), F.lit("quote").alias("text"))).alias("source_anchor"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "labels").where("doc_id % 9 = 0")
    return c.select(F.concat(F.lit("card:"), F.col("doc_id").cast("string")).alias("source_key"), F.lit("保存的争点").alias("issue"), F.lit("反对").alias("stance"), F.lit("").alias("evidence_type"), F.lit(None).cast("string").alias("note"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote from each block; some name another block, some are changed."""
    b, turn = blocks(spark, sf_dir), F.col("doc_id") % 3
    quote = F.substring("text", 3, 40)
    return b.select(
        F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("-"), F.col("reading_order").cast("string")).alias("annotation_id"), F.lit("p").alias("project_id"), "doc_id", F.lit("highlight").alias("kind"), F.lit("yellow").alias("color"), F.lit("引用卡").alias("card_type"), F.when(turn == 2, F.concat(F.lit("\u0001"), quote)).otherwise(quote).alias("text"), F.lit("").alias("note"), "page",
        F.when(turn == 1, "b0000000").otherwise(F.col("block_id")).alias("block_id"), F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"), F.lit("").alias("quote_prefix"), F.lit("").alias("quote_suffix"), F.lit(None).cast("array<double>").alias("page_rect"), F.lit(None).cast("array<array<double>>").alias("page_rects"),
        F.array().cast("array<struct<block_id:string,start_offset:int,end_offset:int,text:string>>").alias("segments"), F.lit("exact").alias("anchor_status"), F.array(F.lit("t1")).alias("tags"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )


def tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("annotation_id"), (F.col("user_id") % 7).alias("project_id"), F.col("user_id").alias("doc_id"), (1 + F.col("event_id") % 20).cast("int").alias("page"), F.lit("引用卡").alias("card_type"), F.array("event_type").alias("tags"), F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"))


def page_results(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_id") % 5 == 0, "failed").otherwise("completed")
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("page"), status.alias("status"), F.floor("value").cast("long").alias("characters"), "ts")


def citation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's first word in a legal citation: six shapes in turn, some without a page, an article or a date."""
    b, k = blocks(spark, sf_dir), F.col("reading_order")
    w = F.regexp_extract("text", "([A-Za-z]{3,})", 1)
    s = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    year = 1990 + k % 30
    shapes = [
        s("12 ", w, "：《", w, "x》，载《", w, "刊》", year, "年第", k % 12 + 1, "期", F.when(k % 4 == 0, "，第3-5页").otherwise(""), "。"),
        s(w, "：《T", k, "》，", w, "出版社", year, "年版", F.when(k % 4 == 1, "，第7页").otherwise("")),
        s(w, "市人民法院（2020）京01民终", k, "号民事判决书"),
        s("《", w, "法》", F.when(k % 4 == 3, "").otherwise(s("第", k, "条"))),
        s("《", w, "》, http://e.org/", w, F.when(k % 8 == 4, "，访问日期：2020-01-02").otherwise("")),
        s(w, " plain"),
    ]
    return b.withColumn("text", F.element_at(F.array(*shapes), (k % 6 + 1).cast("int"))).withColumn("block_type", F.lit("footnote")).withColumn("footnote_marker", F.lit(None).cast("string"))
