"""Lines from glyph runs, text quality of pages, OCR rows, document roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import boxes
from quire.functions.text import CJK, clamp, head, normalize_text, strip

PAGE = ["doc_id", "page"]
#: Block types that an OCR service may name.
BLOCK_TYPES = ["heading", "paragraph", "footnote", "page_number", "table", "caption", "header", "footer"]


#: Runs of a part of a page, within which what is known so far is copied.
PART = 256


def group_lines(page_items: DataFrame, exact: bool = True) -> DataFrame:
    """Positioned runs to lines: doc_id, page, block_id, reading_order, text, bbox, font_size.

    Runs go from the top, left first; the first line whose height differs by at most
    max(2, 0.28 * run height) takes a run, and its height becomes the mean of the two.
    ``exact=False`` compares a run with the one before only, for pages of very many runs.
    """
    items = page_items.withColumn("text", normalize_text(F.col("str"))).where("text <> ''").withColumn("height", F.abs("height"))
    if not exact:
        w = Window.partitionBy(*PAGE).orderBy(F.desc("y"), "x", "item_no")
        gap = F.coalesce(F.lag("y").over(w) - F.col("y"), F.lit(1e9))
        lined = items.withColumn("brk", (gap > F.greatest(F.lit(2.0), F.col("height") * 0.28)).cast("int")).withColumn("line", F.sum("brk").over(w))
        top = F.max("y").over(Window.partitionBy(*PAGE, "line"))
        rows = lined.withColumn("row_y", top)
    else:
        run = F.struct((-F.col("y")).alias("ny"), "x", "item_no", "y", "width", "height", "font_size", "text")
        # the state: the open lines with their heights, and how many there are. Runs come from the top, so a line that lies
        # further over a run than the page's widest tolerance takes none any more. Runs go in parts: what a part gives is
        # copied within the part only. The first line near enough is looked for once: k is its place from 1, or 0
        line = "struct<line:int,y:double>"
        step = """element_at(transform(array(filter(t.open, p -> p.y <= r.y + reach)), open ->
            element_at(transform(array(array_position(transform(open, p -> abs(p.y - r.y) <= greatest(2.0D, r.height * 0.28D)), true)), k ->
                CASE WHEN k > 0 THEN named_struct('open', transform(open, (q, i) -> CASE WHEN i = k - 1 THEN named_struct('line', q.line, 'y', (q.y + r.y) / 2) ELSE q END), 'n', t.n, 'out', concat(t.out, array(named_struct('line', open[cast(k - 1 as int)].line, 'y', (open[cast(k - 1 as int)].y + r.y) / 2))))
                     ELSE named_struct('open', concat(open, array(named_struct('line', t.n, 'y', r.y))), 'n', t.n + 1, 'out', concat(t.out, array(named_struct('line', t.n, 'y', r.y)))) END), 1)), 1)"""
        part = f"aggregate(slice(runs, j * {PART} + 1, {PART}), named_struct('open', s.open, 'n', s.n, 'out', cast(array() as array<{line}>)), (t, r) -> {step})"
        place = f"""aggregate(sequence(0, (size(runs) - 1) div {PART}), named_struct('open', cast(array() as array<{line}>), 'n', 0, 'out', cast(array() as array<array<{line}>>)), (s, j) ->
            element_at(transform(array({part}), d -> named_struct('open', d.open, 'n', d.n, 'out', concat(s.out, array(d.out)))), 1)).out"""
        pages = items.groupBy(*PAGE).agg(F.array_sort(F.collect_list(run)).alias("runs"), F.greatest(F.lit(2.0), F.max("height") * 0.28).alias("reach"))
        pages = pages.withColumn("placed", F.flatten(F.expr(place)))
        rows = pages.select(*PAGE, F.posexplode(F.arrays_zip("runs", "placed")).alias("k", "z")).select(*PAGE, "z.placed.line", F.col("z.placed.y").alias("line_y"), "k", "z.runs.x", "z.runs.y", "z.runs.width", "z.runs.height", "z.runs.font_size", "z.runs.text", "z.runs.item_no")
        # a line's height is what its last run made it
        rows = rows.withColumn("row_y", F.max_by("line_y", "k").over(Window.partitionBy(*PAGE, "line")))
    lines = rows.groupBy(*PAGE, "line", "row_y").agg(
        F.array_sort(F.collect_list(F.struct("x", "item_no", "text"))).alias("parts"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max("height").alias("h"), F.max("font_size").alias("font_size"),
    )
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("row_y"), "line"))
    out = lines.withColumn("reading_order", order).withColumn("text", normalize_text(F.array_join(F.transform("parts", lambda p: p["text"]), " ")))
    bbox = F.array(*[F.round(c, 2) for c in (F.col("x"), F.col("y"), F.col("right") - F.col("x"), F.col("h"))])
    return out.where("text <> ''").select(*PAGE, F.concat(F.lit("b-"), F.col("page").cast("string"), F.lit("-"), F.col("reading_order").cast("string")).alias("block_id"), "reading_order", F.lit("paragraph").alias("block_type"), "text", bbox.alias("bbox"), F.round("font_size", 2).alias("font_size"), F.lit("pdf_text_layer").alias("extraction_method"), F.lit(1.0).alias("confidence"))


def quality_of(length: Column, broken: Column, blocks: Column, no_word: Column, tiny: Column, cjk: Column, kinds: Column, most: Column) -> tuple[Column, Column]:
    """Confidence and reason from a page's counts: the first rule that holds decides."""
    diversity, dominant = kinds / F.least(cjk, F.lit(160)), most / cjk
    rules = [
        (length < 25, 0.2, "too_little_text"),
        (broken / length > 0.01, 0.25, "broken_character_map"),
        ((blocks >= 20) & ((no_word / blocks >= 0.3) | (tiny / blocks >= 0.55)), 0.3, "broken_reading_order_or_font_map"),
        ((cjk >= 40) & ((diversity < 0.16) | (dominant > 0.22)), 0.35, "suspicious_glyph_repetition"),
        ((cjk >= 40) & ((diversity < 0.24) | (dominant > 0.14)), 0.72, "text_layer_needs_review"),
    ]
    confidence = reason = None
    for test, value, name in rules:
        test = F.coalesce(test, F.lit(False))
        confidence = F.when(test, value) if confidence is None else confidence.when(test, value)
        reason = F.when(test, name) if reason is None else reason.when(test, name)
    return confidence.otherwise(1.0), reason.otherwise(F.lit(None).cast("string"))


def page_text_quality(blocks: DataFrame, block_rule: bool = True) -> DataFrame:
    """doc_id, page, text_length, block_count, confidence, quality_issue.

    Sums over blocks give all but the character frequencies; only pages with 40 or more CJK
    characters have their characters counted, combined before the shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    cjk = F.regexp_count(text, F.lit(CJK))
    sums = blocks.groupBy(*PAGE).agg(
        (F.sum(F.length(text)) + F.count("*") - 1).alias("text_length"),
        F.count("*").alias("block_count"),
        F.sum(F.regexp_count(text, F.lit(r"[\x{FFFD}\x{0}]"))).alias("broken"),
        F.count_if(~text.rlike(r"[\p{L}\p{N}]")).alias("no_word"),
        F.count_if(F.length(text) <= 3).alias("tiny"),
        F.sum(cjk).alias("cjk"),
    )
    chars = blocks.where(cjk > 0).select(*PAGE, F.explode(F.split(F.regexp_replace(text, r"[^\x{3400}-\x{9FFF}]", ""), "")).alias("ch")).where("ch <> ''")
    freq = chars.groupBy(*PAGE, "ch").count().groupBy(*PAGE).agg(F.count("*").alias("kinds"), F.max("count").alias("most"))
    joined = sums.join(freq, PAGE, "left")
    blocks_n = F.col("block_count") if block_rule else F.lit(0)
    confidence, reason = quality_of(*(F.col(c) for c in ("text_length", "broken")), blocks_n, *(F.col(c) for c in ("no_word", "tiny", "cjk", "kinds", "most")))
    return joined.select(*PAGE, "text_length", "block_count", confidence.alias("confidence"), reason.alias("quality_issue"))


def page_summary(blocks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Page rows with quality and extraction method; pages without blocks are kept if ``pages`` is given."""
    quality = page_text_quality(blocks)
    if pages is not None:
        keep = [c for c in pages.columns if c not in quality.columns or c in PAGE]
        quality = pages.select(*keep).join(quality, PAGE, "left").fillna({"text_length": 0, "block_count": 0, "confidence": 0.2}).withColumn("quality_issue", F.when(F.col("block_count") == 0, "too_little_text").otherwise(F.col("quality_issue")))
    return quality.withColumn("extraction_method", F.when(F.col("confidence") < 0.65, "ocr_required").otherwise("pdf_text_layer"))


def push_confidence(blocks: DataFrame, quality: DataFrame) -> DataFrame:
    """The page's confidence on each of its blocks."""
    return blocks.drop("confidence").join(quality.select(*PAGE, "confidence"), PAGE, "left")


def document_rollup(quality: DataFrame) -> DataFrame:
    """doc_id, page_count, low_confidence_pages, character_count, average_confidence from page rows."""
    low = F.sort_array(F.collect_list(F.when(F.col("confidence") < 0.65, F.col("page"))))
    return quality.groupBy("doc_id").agg(F.count("*").alias("page_count"), low.alias("low_confidence_pages"), F.sum("text_length").alias("character_count"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"))


def page_rects(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return blocks.join(pages.select(*PAGE, "width", "height"), PAGE, "left").withColumn("page_rect", boxes.page_rect(F.col("bbox"), F.col("width"), F.col("height"))).drop("width", "height")


def repair_legacy_boxes(blocks: DataFrame, pages: DataFrame, method: str = "vision_ocr") -> DataFrame:
    """Boxes of one OCR method that an older scaling wrote a thousand times too small."""
    is_ocr = (F.col("extraction_method") == method) & F.col("font_size").isNull()
    return blocks.join(pages.select(*PAGE, "width", "height"), PAGE, "left").withColumn("bbox", boxes.repair_legacy_box(F.col("bbox"), F.col("width"), F.col("height"), is_ocr)).drop("width", "height")


def clean_marker(c: Column) -> Column:
    """A footnote marker without the brackets around it (fixed values), at most 20 characters."""
    return head(F.regexp_replace(strip(c.cast("string")), r"^[（(\[]|[）)\]]$", ""), 20)


def infer_marker(text: Column) -> Column:
    return F.nullif(F.regexp_extract(strip(text), r"^(\*+|[①-⑳]|\d{1,3})", 1), F.lit(""))


def repair_ref_offsets(refs: Column, text: Column) -> Column:
    """References with offsets that point at their marker, at most 40; those that cannot be placed go.

    refs: array<struct<marker, quote, start_offset int, end_offset int>>; offsets count from 0.
    """
    marker = lambda r: clean_marker(r["marker"])
    quote = lambda r: head(strip(F.translate(F.coalesce(r["quote"], F.lit("")), "\x00", "")), 120)

    def fix(r):
        m, q, a, b = marker(r), quote(r), r["start_offset"], r["end_offset"]
        valid = F.coalesce((a >= 0) & (b > a) & (b <= F.length(text)) & F.contains(F.substring(text, a + 1, b - a), m), F.lit(False))
        at, inside = F.position(q, text) - 1, F.position(m, q) - 1
        found = (F.length(q) > 0) & (at >= 0)
        start = F.when(valid, a).when(found, at + F.greatest(inside, F.lit(0))).otherwise(a)
        end = F.when(valid, b).when(found & (inside >= 0), at + inside + F.length(m)).when(found, at + F.length(q)).otherwise(b)
        return F.struct(m.alias("marker"), q.alias("quote"), start.cast("int").alias("start_offset"), end.cast("int").alias("end_offset"))

    sane = lambda r: F.coalesce((F.length(r["marker"]) > 0) & (r["start_offset"] >= 0) & (r["end_offset"] > r["start_offset"]) & (r["end_offset"] <= F.length(text)), F.lit(False))
    return F.slice(F.filter(F.transform(F.coalesce(refs, F.array().cast("array<struct<marker:string,quote:string,start_offset:int,end_offset:int>>")), fix), sane), 1, 40)


def normalize_ocr_blocks(raw: DataFrame, pages: DataFrame, model: str = "ocr") -> DataFrame:
    """OCR service rows (doc_id, page, items array<struct<type, text, bbox, confidence, footnote_marker, footnote_refs>>) to blocks."""
    items = raw.select(*PAGE, F.posexplode("items").alias("pos", "b")).where("pos < 180").join(pages.select(*PAGE, "width", "height"), PAGE, "left")
    kind = F.when(F.col("b.type").isin(BLOCK_TYPES), F.col("b.type")).otherwise("paragraph")
    text = head(strip(F.translate(F.coalesce("b.text", F.lit("")), "\x00", "")), 6000)
    t = items.withColumn("block_type", kind).withColumn("text", text).where("text <> ''")
    note = F.col("block_type") == "footnote"
    given = clean_marker(F.col("b.footnote_marker"))
    empty_refs = F.array().cast("array<struct<marker:string,quote:string,start_offset:int,end_offset:int>>")
    return t.select(
        *PAGE,
        F.concat(F.lit("ocr-"), F.col("page").cast("string"), F.lit("-"), (F.col("pos") + 1).cast("string")).alias("block_id"),
        (F.col("pos") + 1).alias("reading_order"),
        "block_type",
        "text",
        boxes.ocr_bbox_to_page(F.col("b.bbox"), F.col("width"), F.col("height")).alias("bbox"),
        F.lit(None).cast("double").alias("font_size"),
        F.lit("vision_ocr").alias("extraction_method"),
        clamp(F.coalesce(F.col("b.confidence").cast("double"), F.lit(75.0)) / 100, 0.2, 0.98).alias("confidence"),
        F.lit(model).alias("model"),
        F.when(note, F.coalesce(F.nullif(given, F.lit("")), infer_marker(F.col("text")))).alias("footnote_marker"),
        F.when(note, empty_refs).otherwise(repair_ref_offsets(F.col("b.footnote_refs"), F.col("text"))).alias("footnote_refs"),
    )


def ocr_page_quality(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Confidence and issue per OCR page; ``pages`` has page_type and ink_coverage and every page."""
    weighted = blocks.groupBy(*PAGE).agg((F.sum(F.col("confidence") * F.length("text")) / F.sum(F.length("text"))).alias("weighted"))
    q = page_text_quality(blocks, block_rule=False).withColumnRenamed("confidence", "rule")
    j = pages.select(*PAGE, "page_type", "ink_coverage").join(q, PAGE, "left").join(weighted, PAGE, "left").fillna({"text_length": 0, "block_count": 0, "rule": 0.2})
    blank = (F.col("page_type") == "blank") & (F.col("block_count") == 0) & (F.coalesce("ink_coverage", F.lit(1.0)) < 0.00015)
    sparse = (F.col("text_length") > 0) & (F.col("text_length") < 25)
    w = F.nullif(F.col("weighted"), F.lit(0.0))
    confidence = F.when(blank, 1.0).when(sparse, F.least(F.lit(0.9), F.coalesce(w, F.lit(0.75)))).otherwise(F.least("rule", F.coalesce(w, F.col("rule"))))
    issue = F.when(blank, F.lit(None)).when(sparse, "sparse_text_page").when(F.col("block_count") == 0, "too_little_text").otherwise(F.col("quality_issue"))
    return j.select(*PAGE, "page_type", "text_length", "block_count", confidence.alias("confidence"), issue.alias("quality_issue"), blank.alias("confirmed_blank"))


def accept_ocr_pages(quality: DataFrame) -> DataFrame:
    return quality.where("(confirmed_blank or block_count > 0) and confidence >= 0.65")


def normalize_layout_blocks(raw: DataFrame, markdown: DataFrame, pages: DataFrame) -> DataFrame:
    """Layout service rows (doc_id, page, item_no, label, content, bbox in 0..1 corners) with page Markdown to blocks."""
    unmark = lambda c: F.regexp_replace(c, r"\*{1,3}(.+?)\*{1,3}", "$1")
    plain = lambda c: strip(F.regexp_replace(unmark(F.regexp_replace(F.regexp_replace(c, r"(?m)^#{1,6}\s+", ""), r"(?m)^>\s+", "")), "`([^`]+)`", "$1"))
    titles = markdown.select(*PAGE, F.explode(F.split("markdown", "\n")).alias("line")).select(*PAGE, unmark(strip(F.regexp_extract("line", r"^#{1,4}\s+(.+)", 1))).alias("title")).where("title <> ''").distinct().withColumn("is_title", F.lit(True))
    rows = raw.where(F.col("label").isin("text", "formula", "table")).withColumn("content", head(F.coalesce("content", F.lit("")), 6000)).withColumn("text", plain(F.col("content"))).where("text <> ''")
    rows = rows.withColumn("title", strip(F.regexp_replace(unmark(F.col("content")), r"^#+\s*", ""))).join(titles, [*PAGE, "title"], "left").join(pages.select(*PAGE, "width", "height"), PAGE, "left")
    short = (F.length("text") <= 80) & F.col("text").rlike(r"^[^。，；：、,.;:\n]+$")
    kind = F.when(F.col("label") == "table", "table").when(F.coalesce("is_title", F.lit(False)) | short, "heading").otherwise("paragraph")
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("item_no"))
    # the boxes have their origin at the top and are turned once
    return rows.select(*PAGE, F.concat(F.lit("ocr-"), F.col("page").cast("string"), F.lit("-"), order.cast("string")).alias("block_id"), order.alias("reading_order"), kind.alias("block_type"), "text", boxes.ocr_bbox_to_page(F.col("bbox"), F.col("width"), F.col("height")).alias("bbox"), F.lit(None).cast("double").alias("font_size"), F.lit("layout_ocr").alias("extraction_method"), F.lit(0.92).alias("confidence"))


def replace_pages(blocks: DataFrame, new_blocks: DataFrame, accepted: DataFrame) -> DataFrame:
    """All blocks of accepted pages go, the new ones of these pages come."""
    keys = accepted.select(*PAGE).distinct()
    return blocks.join(keys, PAGE, "left_anti").unionByName(new_blocks.join(keys, PAGE, "left_semi"), allowMissingColumns=True)


def replace_page_rows(pages: DataFrame, accepted: DataFrame) -> DataFrame:
    keep = accepted.select(*PAGE, *[c for c in accepted.columns if c in pages.columns and c not in PAGE])
    return pages.join(keep.select(*PAGE), PAGE, "left_anti").unionByName(keep, allowMissingColumns=True)


def ocr_history(log: DataFrame, keep: int = 1000) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("ts"), F.desc("page"))
    return log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")


def pages_to_ocr(docs: DataFrame, requests: DataFrame, limit: int = 120) -> DataFrame:
    """doc_id, page: all pages, the listed ones, or the low ones; distinct, in range, the first ``limit``.

    docs: doc_id, page_count, low_confidence_pages; requests: doc_id, scope, pages array<int>.
    """
    j = docs.join(requests, "doc_id")
    every = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count").cast("int"))).otherwise(F.array().cast("array<int>"))
    chosen = F.when(F.col("scope") == "all", every).when(F.size(F.coalesce("pages", F.array().cast("array<int>"))) > 0, F.col("pages")).otherwise(F.col("low_confidence_pages").cast("array<int>"))
    wanted = F.slice(F.filter(F.array_distinct(chosen), lambda p: (p >= 1) & (p <= F.col("page_count"))), 1, limit)
    return j.select("doc_id", F.explode(wanted).alias("page"))
