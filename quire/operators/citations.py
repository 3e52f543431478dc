"""Legal citations, table-driven: a note is taken apart once, its parts tell its type, and the type's template
puts them together again and names what is missing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import squeeze
from quire.operators.footnotes import looks_like_footnote

#: The types as the reader sees them.
WEB, JUDGMENT, STATUTE, JOURNAL, BOOK, OTHER = "网络资料", "裁判文书", "法律法规", "期刊论文", "专著", "其他文献"
#: How each part of a note is written; the first group is the part.
PARTS = {
    "url": r"(?i)(https?://[^\s，。]+)",
    "access": r"(?:最后)?访问(?:日期|时间)?[：:]?\s*(\d{4}[-./年]\d{1,2}[-./月]\d{1,2}日?)",
    "title": "《([^》]+)》",
    "author": "^([^：，]+)：",
    "container": "载《([^》]+)》",
    "year": r"(\d{4})\s*年",
    "issue": r"第\s*(\d+)\s*期",
    "publisher": "，([^，。]*?(?:出版社|出版))",
    "court": "([^，。；：]+法院)",
    "number": r"(（\d{4}）[^\s，。；]{2,40}?号)",
    "article": r"(第\s*\d+\s*条)",
    "pages": r"(第\s*\d+(?:\s*[-—]\s*\d+)?\s*页)",
}
#: Parts that are looked for in the note as it is written: full-width marks would break an address.
AS_WRITTEN = {"url", "access"}
#: What tells a type, in this order; a note is of the first type of which any pattern is found.
SIGNS = [
    (WEB, [PARTS["url"]]),
    (JUDGMENT, [r"(?:人民法院|法院).{0,30}(?:案|字)|（\d{4}）[^\s，。]{2,30}号"]),
    (STATUTE, [PARTS["article"], "^(?!.*载《).*(法|条例|办法|规定|解释)》"]),
    (JOURNAL, ["载《", r"\d{4}\s*年第\s*\d+\s*期"]),
    (BOOK, ["出版"]),
]
#: What a type is put together from: a part, what stands before it, what stands behind it.
TEMPLATES = {
    WEB: [("lead", "", "，"), ("url", "", ""), ("access", "，最后访问日期：", "")],
    JUDGMENT: [("court", "", "："), ("number", "", ""), ("title", "《", "》"), ("at_page", "，", "")],
    STATUTE: [("name", "", ""), ("at_article", "", "")],
    JOURNAL: [("author", "", "："), ("title", "《", "》"), ("container", "，载《", "》"), ("year", "", "年"), ("issue", "第", "期"), ("at_page", "，", "")],
    BOOK: [("author", "", "："), ("title", "《", "》"), ("publisher", "，", ""), ("year", "", "年版"), ("at_page", "，", "")],
    OTHER: [("original", "", "")],
}
#: What is said if one of these parts is missing.
REQUIRED = {
    WEB: [(["title"], "未识别到网络资料标题"), (["access"], "缺少访问日期")],
    JUDGMENT: [(["court"], "未识别到审理法院"), (["number"], "未识别到案号")],
    STATUTE: [(["title"], "未识别到法规名称"), (["article"], "缺少具体条文号")],
    JOURNAL: [(["author"], "未识别到作者"), (["title"], "未识别到篇名"), (["container"], "未识别到刊名"), (["year", "issue"], "缺少年份或期号"), (["pages"], "缺少引证页码")],
    BOOK: [(["author"], "未识别到作者"), (["title"], "未识别到书名"), (["publisher", "year"], "缺少出版社或版本年份"), (["pages"], "缺少引证页码")],
    OTHER: [(["type"], "无法可靠识别文献类型，已保留原文")],
}
#: A pinpoint's number, and the marker before a note. The first digits of a year are no marker.
PINPOINT = r"(?:第\s*)?(\d+(?:\s*[-—]\s*\d+)?)\s*(?:页|条)"
MARKER = r"^(\[\d{1,3}\]|\d{1,3}(?!\d)(?!\s*年)|[①-⑳]|[＊*])[.、\s]*"


def full_width(c: Column) -> Column:
    """Commas, colons and semicolons in their full-width form."""
    return F.translate(squeeze(c), ",:;", "，：；")


def take_apart(text: Column) -> Column:
    """The parts of a note as a struct of texts; null where a part is not there."""
    written, original = (F.trim(F.regexp_replace(c, MARKER, "")) for c in (squeeze(text), full_width(text)))
    found = {name: F.nullif(F.regexp_extract(written if name in AS_WRITTEN else original, pattern, 1), F.lit("")) for name, pattern in PARTS.items()}
    numbers = F.regexp_extract_all(original, F.lit(PINPOINT), F.lit(1))
    last = F.regexp_replace(F.get(F.reverse(numbers), F.lit(0)), r"\s", "")
    found |= {"original": original, "lead": F.regexp_replace(full_width(F.substring_index(written, "http", 1)), "[，。]+$", "")}
    found |= {"at_page": F.concat(F.lit("第"), last, F.lit("页")), "at_article": F.concat(F.lit("第"), last, F.lit("条"))}
    found["name"] = F.coalesce(F.concat(F.lit("《"), found["title"], F.lit("》")), F.regexp_replace(original, "。+$", ""))
    return F.struct(*[c.alias(name) for name, c in found.items()])


def type_of(parts: Column) -> Column:
    """The first type that has a sign in the note."""
    out = F.lit(OTHER)
    for kind, patterns in reversed(SIGNS):
        of = parts["url"] if kind == WEB else parts["original"]
        seen = F.coalesce(reduce(lambda a, b: a | b, [of.rlike(p) for p in patterns]), F.lit(False))
        out = F.when(seen, kind).otherwise(out)
    return out


def put_together(kind: Column, parts: Column) -> Column:
    """The note by its type's template, with a stop at its end."""
    out = F.lit("")
    for name, template in TEMPLATES.items():
        pieces = [F.when(F.length(parts[p]) > 0, F.concat(F.lit(before), parts[p], F.lit(behind))).otherwise("") for p, before, behind in template]
        out = F.when(kind == name, F.concat(*pieces)).otherwise(out)
    return F.when((out == "") | out.rlike("[。！？]$"), out).otherwise(F.concat(out, F.lit("。")))


def missing_parts(kind: Column, parts: Column) -> Column:
    """What the type requires and the note does not have."""
    there = lambda names: reduce(and_, [parts[n].isNotNull() if n != "type" else F.lit(False) for n in names])
    return F.array_compact(F.array(*[F.when((kind == name) & ~there(needed), F.lit(said)) for name, rules in REQUIRED.items() for needed, said in rules]))


def normalize_citations(notes: DataFrame, text: str = "text") -> DataFrame:
    """Adds citation_type, original, formatted, issues and confidence to each note.

    A web address is looked for before punctuation is made full-width, so it is found as it is written.
    """
    d = notes.withColumn("_parts", take_apart(F.col(text))).withColumn("citation_type", type_of(F.col("_parts")))
    kind, parts = F.col("citation_type"), F.col("_parts")
    out = d.withColumn("original", parts["original"]).withColumn("formatted", put_together(kind, parts)).withColumn("issues", missing_parts(kind, parts))
    return out.withColumn("citation_confidence", F.when(F.size("issues") > 0, 0.62).otherwise(0.9)).drop("_parts")


def citations_by_document(blocks: DataFrame) -> DataFrame:
    """Citations of every footnote or footnote-like block, with id, page and marker."""
    notes = blocks.where((F.col("block_type") == "footnote") | looks_like_footnote(F.col("text")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "reading_order", "block_id"))
    c = normalize_citations(notes.withColumn("n", n))
    return c.select("doc_id", F.coalesce("block_id", F.concat(F.lit("citation-"), (F.col("n") - 1).cast("string"))).alias("citation_id"), F.coalesce(F.nullif("page", F.lit(0)), F.lit(1)).alias("page"), F.coalesce("footnote_marker", F.col("n").cast("string")).alias("marker"), "n", "citation_type", "original", "formatted", "issues", "citation_confidence")


def citation_summary(citations: DataFrame, only_risks: bool = False) -> DataFrame:
    """doc_id, total, needs_review."""
    c = citations.where(F.size("issues") > 0) if only_risks else citations
    return c.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.size("issues") > 0).alias("needs_review"))


def citation_corpus_summary(citations: DataFrame) -> DataFrame:
    """Counts over all documents by type (issue null), and by issue within the type, in one grouping."""
    each = F.explode(F.concat(F.array(F.lit(None).cast("string")), "issues")).alias("issue")
    return citations.select("citation_type", each).groupBy("citation_type", "issue").agg(F.count("*").alias("n"))
