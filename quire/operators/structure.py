"""Headings, outlines, sections, size-bounded chunks, requests, reader paragraphs.

Blocks are read in document order: page, then reading_order, then block_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clamp, head, normalize_text, number_or, squeeze, strip
from quire.shared import written

ORDER = ["page", "reading_order", "block_id"]
#: Titles that are headings by themselves (any case).
FIXED_TITLES = ["摘要", "关键词", "引言", "导论", "绪论", "结语", "结论", "参考文献", "附录", "后记", "abstract", "keywords"]
#: Endings of headings that must be followed by body text.
HEADING_ENDINGS = ["问题的提出", "理论基础", "制度背景", "规范分析", "比较法", "实证分析", "案例分析", "裁判", "解释路径", "制度完善", "规则构造", "研究方法", "文献综述", "核心概念", "结论与建议", "结论"]
#: Endings of numbered references.
REFERENCE_ENDINGS = ["参见", "载", "出版社", "页", "号"]
#: Numerals and how headings and references are numbered.
DIGITS = "一二三四五六七八九十"
CHAPTER = f"^第[{DIGITS}百]+(章|节|部分)"
ENUMERATED = f"^[{DIGITS}]+、"
BRACKETED = f"^[（(][{DIGITS}]+[）)]"
DECIMAL = r"^\d+(\.\d+){0,3}[、.．\s]"
REFERENCE = r"^(\d+|[①-⑳])\s*[、.．]"


def in_doc():
    """The window of document order; a function, as windows need a session."""
    return Window.partitionBy("doc_id").orderBy(*ORDER)


def _any_of(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


def heading_level(c: Column) -> Column:
    """1 for chapters and 一、, 2 for （一） and 1.1, 3 for 1.1.1."""
    return F.when(c.rlike(f"^第[{DIGITS}百]+[章节部分]") | c.rlike(ENUMERATED), 1).when(c.rlike(BRACKETED), 2).when(c.rlike(r"^\d+\.\d+\.\d+"), 3).when(c.rlike(r"^\d+\.\d+"), 2).otherwise(1)


def detect_headings(blocks: DataFrame) -> DataFrame:
    """Blocks that are headings, with level and confidence."""
    following = F.coalesce(F.lead("text").over(in_doc()), F.lit(""))
    v = F.regexp_replace(normalize_text(F.col("text")), r"^\s*[①-⑳]\s*", "")
    b = blocks.withColumn("next_text", following).withColumn("v", v)
    v = F.col("v")
    fixed = F.lower(v).isin(FIXED_TITLES)
    numbered = v.rlike(CHAPTER) | v.rlike(ENUMERATED) | v.rlike(BRACKETED) | v.rlike(DECIMAL)
    body_follows = (F.length("next_text") >= 24) & ~F.col("next_text").rlike(REFERENCE)
    ending = v.rlike(_any_of(HEADING_ENDINGS) + "$") & body_follows
    sane = F.length(v).between(2, 80) & ~v.rlike("[。！？；;]$") & ~(v.rlike(REFERENCE) & v.rlike(_any_of(REFERENCE_ENDINGS) + "$"))
    return b.where(sane & (fixed | numbered | ending)).withColumn("level", heading_level(v)).withColumn("confidence", F.when(fixed | numbered, 0.9).otherwise(0.72)).drop("next_text", "v")


def semantic_outline(blocks: DataFrame, limit: int = 160) -> DataFrame:
    """doc_id, outline_id, title, level, page, block_id, confidence, source, ord."""
    n = F.row_number().over(in_doc())
    return detect_headings(blocks).withColumn("ord", n).where(F.col("ord") <= limit).select("doc_id", F.concat(F.lit("outline-semantic-"), F.col("ord").cast("string")).alias("outline_id"), F.col("text").alias("title"), "level", "page", "block_id", "confidence", F.lit("automatic").alias("source"), "ord")


def choose_outline(semantic: DataFrame, native: DataFrame, limit: int = 300) -> DataFrame:
    """Bookmarks (doc_id, title, level, page, ord) only for documents without a semantic outline."""
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    marks = native.join(semantic.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("ord", rn).where(F.col("ord") <= limit)
    marks = marks.select("doc_id", F.concat(F.lit("outline-native-"), F.col("ord").cast("string")).alias("outline_id"), "title", clamp(F.col("level"), 1, 4).alias("level"), "page", F.lit(None).cast("string").alias("block_id"), F.lit(1.0).alias("confidence"), F.lit("automatic").alias("source"), "ord")
    return semantic.unionByName(marks)


def mark_headings(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    named = outline.where("block_id is not null").select("doc_id", "block_id").distinct().withColumn("is_heading", F.lit(True))
    return blocks.join(named, ["doc_id", "block_id"], "left").withColumn("block_type", F.when(F.col("is_heading"), "heading").otherwise(F.col("block_type"))).drop("is_heading")


def merge_model_outline(response: DataFrame, blocks: DataFrame, limit: int = 160) -> DataFrame:
    """Model rows (doc_id, ord, block_id, title, level, confidence) whose block exists; the first of each block."""
    real = blocks.where(~F.col("block_type").isin("footnote", "header", "footer", "page_number") & (F.length(strip(F.col("text"))) > 0)).withColumn("at", F.row_number().over(in_doc())).select("doc_id", "block_id", "page", "at", F.col("text").alias("block_text"))
    j = response.join(real, ["doc_id", "block_id"])
    first = F.row_number().over(Window.partitionBy("doc_id", "block_id").orderBy("ord"))
    j = j.withColumn("rn", first).where("rn = 1").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "at"))).where(F.col("n") <= limit)
    return j.select("doc_id", F.concat(F.lit("outline-ai-"), F.col("n").cast("string")).alias("outline_id"), head(squeeze(F.coalesce("title", "block_text")), 180).alias("title"), clamp(number_or(F.col("level"), 1), 1, 4).cast("int").alias("level"), "page", "block_id", clamp(number_or(F.col("confidence"), 0.72), 0.45, 0.98).alias("confidence"), F.lit("ai_format").alias("source"), F.col("n").alias("ord"))


def apply_format_corrections(blocks: DataFrame, response: DataFrame, strict: bool = False) -> DataFrame:
    """Corrections (doc_id, block_index from 0, block_type, text) laid over blocks.

    A blank text removes the block. Blocks without a correction stay as they are; with ``strict`` only
    corrected blocks come back.
    """
    indexed = blocks.where(F.length(strip(F.coalesce("text", F.lit("")))) > 0).withColumn("block_index", F.row_number().over(in_doc()) - 1)
    fix = response.select("doc_id", F.col("block_index").cast("int").alias("block_index"), F.col("block_type").alias("new_type"), F.col("text").alias("new_text"), F.lit(True).alias("fixed")).dropDuplicates(["doc_id", "block_index"])
    j = indexed.join(fix, ["doc_id", "block_index"], "inner" if strict else "left")
    kind = F.when(F.col("new_type").isin("heading", "paragraph", "footnote", "table", "caption"), F.col("new_type")).otherwise("paragraph")
    fixed = F.coalesce("fixed", F.lit(False))
    text = F.when(fixed, head(strip(F.coalesce("new_text", "text")), 6000)).otherwise(F.col("text"))
    out = j.withColumn("block_type", F.when(fixed, kind).otherwise(F.col("block_type"))).withColumn("text", text).withColumn("format_corrected", fixed)
    return out.where("text <> ''").drop("new_type", "new_text", "fixed", "block_index")


def format_outline(response: DataFrame, old: DataFrame, limit: int = 160) -> DataFrame:
    """Model outline rows (doc_id, ord, title, level, page); documents without any keep the old outline."""
    r = response.select("doc_id", "ord", head(strip(F.col("title")), 200).alias("title"), clamp(number_or(F.col("level"), 1), 1, 4).cast("int").alias("level"), number_or(F.col("page"), 1).cast("int").alias("page")).where("title <> ''")
    r = r.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "title", "page").orderBy("ord"))).where("rn = 1")
    r = r.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("n") <= limit)
    new = r.select("doc_id", F.concat(F.lit("fmt-h"), F.col("n").cast("string")).alias("outline_id"), "title", "level", "page", F.lit(None).cast("string").alias("block_id"), F.lit(0.85).alias("confidence"), F.lit("ai_format").alias("source"), F.col("n").alias("ord"))
    return new.unionByName(old.join(new.select("doc_id").distinct(), "doc_id", "left_anti"), allowMissingColumns=True)


#: What an outline item without a title is called.
UNTITLED = "未命名目录"


def sanitize_user_outline(rows: DataFrame, limit: int = 300) -> DataFrame:
    """A reader's outline (doc_id, ord, title, level, page, block_id, perhaps outline_id): the first ``limit`` items, with what is missing filled in."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    r = rows.withColumn("title", head(F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)), 160)).withColumn("ord", n).where(F.col("ord") <= limit)
    own = F.nullif("outline_id", F.lit("")) if "outline_id" in rows.columns else F.lit(None).cast("string")
    return r.select("doc_id", F.coalesce(own, F.concat(F.lit("outline-user-"), F.col("ord").cast("string"))).alias("outline_id"), "title", clamp(number_or(F.col("level"), 1), 1, 4).cast("int").alias("level"), F.greatest(F.lit(1), number_or(F.col("page"), 1).cast("int")).alias("page"), "block_id", F.lit(1.0).alias("confidence"), F.lit("user").alias("source"), "ord")


def log_edits(log: DataFrame, edits: DataFrame, keep: int = 100) -> DataFrame:
    """Edit log (doc_id, type, edited_at) with new edits; of each document the last ``keep``, equal times by type and the other columns."""
    others = [c for c in log.columns if c not in ("doc_id", "type", "edited_at")]
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("edited_at"), "type", *others))
    return log.unionByName(edits.select(*log.columns)).withColumn("_n", n).where(F.col("_n") <= keep).drop("_n")


def indexed_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with text and their 0-based place in the document."""
    return blocks.where(F.length(strip(F.coalesce("text", F.lit("")))) > 0).withColumn("idx", F.row_number().over(in_doc()) - 1)


def section_boundaries(outline: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, idx, section_id, title: where sections begin.

    A level-1 item begins at its block, else at the first block of its page or a later one. Of items at
    one place the first counts. A document whose first boundary is not its first block gets an opening.
    """
    b = indexed_blocks(blocks).select("doc_id", "block_id", "page", "idx")
    items = outline.where("level = 1").select("doc_id", "outline_id", "title", F.col("page").alias("item_page"), "block_id", "ord")
    exact = items.join(b.select("doc_id", "block_id", "idx"), ["doc_id", "block_id"], "left")
    # the first block from a page on: the least index over this and all later pages
    pages = b.groupBy("doc_id", "page").agg(F.min("idx").alias("idx"))
    later = pages.withColumn("from_page", F.coalesce(F.lag("page").over(Window.partitionBy("doc_id").orderBy("page")) + 1, F.lit(-(10**9)))).select("doc_id", "from_page", F.col("page").alias("to_page"), F.col("idx").alias("page_idx"))
    placed = exact.join(later, (exact["doc_id"] == later["doc_id"]) & exact["idx"].isNull() & (exact["item_page"] >= later["from_page"]) & (exact["item_page"] <= later["to_page"]), "left").select(exact["doc_id"], "outline_id", "title", "item_page", "ord", F.coalesce("idx", "page_idx").alias("idx"))
    rn = F.row_number().over(Window.partitionBy("doc_id", "idx").orderBy("ord"))
    marks = placed.where("idx is not null").withColumn("rn", rn).where("rn = 1").select("doc_id", "idx", F.coalesce("outline_id", F.concat(F.lit("heading-"), F.col("item_page").cast("string"))).alias("section_id"), "title")
    first = b.select("doc_id").distinct().join(marks.groupBy("doc_id").agg(F.min("idx").alias("first_idx")), "doc_id", "left").where("first_idx is null or first_idx > 0")
    opening = first.select("doc_id", F.lit(0).alias("idx"), F.lit("document-opening").alias("section_id"), F.when(F.col("first_idx").isNull(), "正文").otherwise("标题前正文").alias("title"))
    return marks.unionByName(opening)


def assign_sections(blocks: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Each block with the latest boundary at or before it: an as-of join by union and a running last."""
    b = indexed_blocks(blocks).select("doc_id", "idx", F.lit(1).alias("is_block"), F.struct("block_id", "page", "reading_order", "text").alias("b"), F.lit(None).cast("struct<section_id:string,title:string,start_idx:int>").alias("s"))
    m = boundaries.select("doc_id", "idx", F.lit(0).alias("is_block"), F.lit(None).cast(b.schema["b"].dataType).alias("b"), F.struct("section_id", "title", F.col("idx").alias("start_idx")).alias("s"))
    w = Window.partitionBy("doc_id").orderBy("idx", "is_block").rowsBetween(Window.unboundedPreceding, 0)
    return b.unionByName(m).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("is_block = 1").select("doc_id", "idx", "b.*", "s.section_id", F.col("s.title").alias("section_title"), F.col("s.start_idx").alias("section_start"))


#: Rows of a segment whose starts are followed within one row.
SEGMENT = 4096

#: From the pointers of places (null: out), all places that a chain from ``{0}`` visits: its length doubles each round.
CHAIN = """aggregate(sequence(1, cast(ceil(log2(size(ptr) + 1)) as int)), named_struct('r', array({0}), 'p', ptr), (s, k) ->
    named_struct('r', concat(s.r, filter(transform(s.r, i -> get(s.p, i)), i -> i is not null)), 'p', transform(s.p, i -> if(i is null, null, get(s.p, i))))).r"""


#: Rows of a key that are folded as one row; keys of more are packed by pointers.
FOLDED = 1024

#: From the sizes of a key's rows in order, the pack of each.
FOLD = """aggregate(_rows, named_struct('total', 0L, 'pack', 0, 'packs', cast(array() as array<int>)), (s, r) ->
    if(s.pack = 0 or s.total + r._size > {0},
        named_struct('total', r._size, 'pack', s.pack + 1, 'packs', concat(s.packs, array(s.pack + 1))),
        named_struct('total', s.total + r._size, 'pack', s.pack, 'packs', concat(s.packs, array(s.pack)))), s -> s.packs)"""


def pack_sequential(df: DataFrame, keys: list[str], order: list[str], size: str, cap: int) -> DataFrame:
    """Adds ``pack`` (from 1): consecutive rows of a key are packed greedily up to ``cap``.

    A pack closes when it is not empty and the next row would not fit; a row over the cap is a pack by itself. Sizes
    below zero and missing ones count nothing. Keys of at most FOLDED rows meet in one row and are folded, after one
    shuffle; larger ones, and rows that hold maps, which have no order, take the way of ``_pack_by_pointers``. Which keys
    are large is asked when this is called.
    """
    large = df.groupBy(*keys).count().where(F.col("count") > FOLDED).select(*keys)
    if any("map<" in f.dataType.simpleString() for f in df.schema):
        return _pack_by_pointers(df, keys, order, size, cap)
    some = not large.isEmpty()
    few = df
    if some:
        large = written(large, "large")
        few = df.join(_renamed(large), _equal(keys), "left_anti")
    sized = F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("long").alias("_size")
    row = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], sized, F.struct(*[c for c in df.columns if c not in keys]).alias("_row"))
    folded = few.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows")).withColumn("_packs", F.expr(FOLD.format(cap)))
    out = folded.select(*keys, F.inline(F.arrays_zip("_rows", "_packs"))).select(*[F.col(c) if c in keys else F.col(f"_rows._row.`{c}`") for c in df.columns], F.col("_packs").alias("pack"))
    if some:
        out = out.unionByName(_pack_by_pointers(df.join(_renamed(large), _equal(keys), "left_semi"), keys, order, size, cap))
    return out


def _pack_by_pointers(df: DataFrame, keys: list[str], order: list[str], size: str, cap: int) -> DataFrame:
    """``pack_sequential`` for keys of any number of rows.

    Where a pack that begins at a row would end is an as-of lookup in the running sum; the starts are then followed by
    doubling, within segments of SEGMENT rows first and from segment to segment after, where only rows remain at which a
    segment can be entered. So no row of a key holds all its rows. What is read several times is written once.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(w).cast("long"))
    k = [f"_m{i}" for i in range(len(keys))]
    named = rows.select(*[F.col(c).alias(x) for c, x in zip(keys, k, strict=True)], "_n", F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("long").alias("_size"))
    ends = named.withColumn("_end", F.sum("_size").over(Window.partitionBy(*k).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)))
    # the first row whose end is over the cap from a start on: ends and limits in falling order, limits before equal ends
    both = ends.select(*k, F.col("_end").alias("_v"), F.lit(1).alias("_row"), "_n").unionByName(ends.select(*k, (F.col("_end") - F.col("_size") + cap).alias("_v"), F.lit(0).alias("_row"), "_n"))
    falling = Window.partitionBy(*k).orderBy(F.desc("_v"), "_row").rowsBetween(Window.unboundedPreceding, 0)
    after = both.withColumn("_next", F.min(F.when(F.col("_row") == 1, F.col("_n"))).over(falling)).where("_row = 0").select(*k, "_n", F.greatest("_next", F.when(F.col("_next").isNotNull(), F.col("_n") + 1)).alias("_next"))
    segment = F.floor((F.col("_n") - 1) / SEGMENT).alias("_segment")
    joined = after.groupBy(*k, segment).agg(F.min("_n").alias("_base"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "_next"))), lambda x: x["_next"]).alias("_nexts"))
    joined = written(joined, "segments").withColumn("ptr", F.transform("_nexts", lambda x: F.when(x < F.col("_base") + F.size("_nexts"), (x - F.col("_base")).cast("int"))))
    # where each row's chain leaves the segment
    leave = "aggregate(sequence(1, cast(ceil(log2(size(_nexts) + 1)) as int)), _nexts, (e, k) -> transform(e, v -> if(v < _base + size(_nexts), get(e, cast(v - _base as int)), v)))"
    exits = joined.select(*k, F.posexplode(F.expr(leave)).alias("_at", "_exit"), "_base").select(*k, (F.col("_base") + F.col("_at")).alias("_n"), "_exit")
    exits = written(exits, "exits")
    entries = exits.select(*k, F.col("_exit").alias("_n")).where("_n is not null").unionByName(exits.where("_n = 1").select(*k, "_n")).distinct()
    numbered = exits.join(_renamed(entries), _equal(k, "_n"), "left_semi").withColumn("_i", F.row_number().over(Window.partitionBy(*k).orderBy("_n")) - 1)
    to = _renamed(numbered.select(*k, F.col("_n").alias("_exit"), F.col("_i").alias("_to")))
    linked = numbered.join(to, _equal(k, "_exit"), "left").groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("_i", "_n", "t_to"))).alias("e"))
    linked = linked.withColumn("ptr", F.transform("e", lambda x: x["t_to"]))
    entered = linked.select(*k, F.explode(F.expr(f"transform({CHAIN.format(0)}, i -> get(e, i)._n)")).alias("_n")).withColumn("_segment", F.floor((F.col("_n") - 1) / SEGMENT))
    entered = _renamed(entered.select(*k, "_segment", F.col("_n").alias("_entry")))
    starts = joined.join(entered, _equal(k, "_segment")).withColumn("_from", (F.col("t_entry") - F.col("_base")).cast("int")).select(*k, "_base", F.explode(F.expr(CHAIN.format("_from"))).alias("_at")).select(*k, (F.col("_base") + F.col("_at")).alias("_m"))
    starts = starts.withColumn("_pack", F.row_number().over(Window.partitionBy(*k).orderBy("_m")))
    found = rows.join(starts, _same(keys), "left")
    return found.withColumn("pack", F.last("_pack", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))).drop("_pack", "_n", "_m", *k)


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"t{c}") for c in df.columns])


def _equal(keys: list[str], *others: str) -> Column:
    """Equal keys, nulls too, and equal other columns of a table and a renamed one."""
    out = F.lit(True)
    for c in keys:
        out = out & F.col(c).eqNullSafe(F.col(f"t{c}"))
    for c in others:
        out = out & (F.col(c) == F.col(f"t{c}"))
    return out


def _same(keys: list[str]) -> Column:
    out = F.col("_n") == F.col("_m")
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_m{i}"))
    return out


def source_line(page: str = "page", block_id: str = "block_id", text: str = "text") -> Column:
    return F.concat(F.lit("[P"), F.col(page).cast("string"), F.lit("#"), F.col(block_id).cast("string"), F.lit("] "), F.col(text))


def analysis_chunks(blocks: DataFrame, outline: DataFrame, cap: int = 10_000) -> DataFrame:
    """Sections packed into parts of at most ``cap`` characters, with ids, pages and source text."""
    placed = assign_sections(blocks, section_boundaries(outline, blocks)).withColumn("line", source_line()).withColumn("size", F.length("line") + 1)
    packed = pack_sequential(written(placed, "placed"), ["doc_id", "section_start"], ["idx"], "size", cap)
    parts = packed.groupBy("doc_id", "section_start", "section_id", "section_title", "pack").agg(
        F.min("idx").alias("first_idx"), F.min_by("page", "idx").alias("start_page"), F.max_by("page", "idx").alias("end_page"), F.sum("size").alias("character_count"), F.array_sort(F.collect_list(F.struct("idx", "line", "block_id"))).alias("lines")
    )
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_idx"))
    return parts.withColumn("ord", n).select("doc_id", F.concat(F.lit("section-part-"), F.col("ord").cast("string")).alias("chunk_id"), "section_id", F.col("pack").alias("part"), F.col("section_title").alias("title"), "start_page", "end_page", "character_count", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("source_text"), F.transform("lines", lambda x: x["block_id"]).alias("block_ids"), "ord")


def route_by_size(chunks: DataFrame, limit: int = 80_000) -> DataFrame:
    """doc_id, total_chars, n_chunks, route: one request, or one per chunk and one to reduce them."""
    return chunks.groupBy("doc_id").agg(F.sum(F.length("source_text")).alias("total_chars"), F.count("*").alias("n_chunks")).withColumn("route", F.when(F.col("total_chars") <= limit, "full_text").otherwise("map_reduce"))


def build_requests(chunks: DataFrame, question: str = "", wave: int = 6, limit: int = 80_000) -> DataFrame:
    """doc_id, stage, chunk_id, wave, prompt: one row per request for a model."""
    routed = chunks.join(route_by_size(chunks, limit).select("doc_id", "route"), "doc_id")
    lead = F.lit(f"{question}\n" if question else "")
    maps = routed.where("route = 'map_reduce'").select("doc_id", F.lit("map").alias("stage"), "chunk_id", F.floor((F.col("ord") - 1) / wave).cast("int").alias("wave"), F.concat(lead, "source_text").alias("prompt"))
    last = maps.groupBy("doc_id").agg(F.max("wave").alias("w")).select("doc_id", F.lit("reduce").alias("stage"), F.lit("reduce").alias("chunk_id"), (F.col("w") + 1).alias("wave"), F.lit(question).alias("prompt"))
    whole = routed.where("route = 'full_text'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source_text"))).alias("c")).select("doc_id", F.lit("full_text").alias("stage"), F.lit("full_text").alias("chunk_id"), F.lit(0).alias("wave"), F.concat(lead, F.array_join(F.transform("c", lambda x: x["source_text"]), "\n")).alias("prompt"))
    return maps.unionByName(last).unionByName(whole)


def reader_outline(blocks: DataFrame) -> DataFrame:
    """The reader's looser headings: by type, by short 一、 or 第一， lines, or at the start of a paragraph."""
    t = squeeze(F.col("text"))
    deep = t.rlike(f"^第[{DIGITS}]+[，,]") & (F.length(t) <= 42)
    enumerated = t.rlike(ENUMERATED) & (F.length(t) <= 64)
    embedded = F.regexp_extract(t, f"^([{DIGITS}]+、[^。！？；\\s]{{2,40}})\\s", 1)
    typed = F.col("block_type") == "heading"
    title = F.when(typed | enumerated | deep, t).when(F.length(embedded) > 0, embedded)
    level = F.when(enumerated, 2).when(deep, 3).when(typed, heading_level(t)).otherwise(2)
    return blocks.withColumn("title", title).where("title is not null").withColumn("level", level).select("doc_id", "block_id", "page", "reading_order", "title", "level")


#: Words of an author's affiliation.
AFFILIATION = ["大学", "学院", "研究院", "研究所", "法院", "作者", "教授", "博士", "硕士"]


def merge_continuous_paragraphs(blocks: DataFrame) -> DataFrame:
    """Adds group (from 1 per document): paragraphs that run on across blocks share it."""
    t = squeeze(F.col("text"))
    author = (F.length(t) <= 80) & t.rlike(_any_of(AFFILIATION))
    heading = (F.col("block_type") == "heading") | (t.rlike(ENUMERATED) & (F.length(t) <= 64)) | (t.rlike(f"^第[{DIGITS}]+[，,]") & (F.length(t) <= 42))
    closed = t.rlike("[。！？!?；;：:.…][”’\"』」）)]?$")
    b = blocks.withColumn("_p", F.col("block_type") == "paragraph").withColumn("_h", heading).withColumn("_a", author).withColumn("_c", closed).withColumn("_e", t.rlike(ENUMERATED))
    before = lambda c: F.lag(c).over(in_doc())
    joins = F.col("_p") & before("_p") & ~before("_a") & ~before("_h") & ~F.col("_h") & ~before("_c") & ~F.col("_e")
    return b.withColumn("_break", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("group", F.sum("_break").over(in_doc())).drop("_p", "_h", "_a", "_c", "_e", "_break")


def merged_paragraphs(blocks: DataFrame) -> DataFrame:
    """One row per group: its first block, its pages and its joined text."""
    g = merge_continuous_paragraphs(blocks)
    key = F.struct(*ORDER)
    return g.groupBy("doc_id", "group").agg(F.min_by("block_id", key).alias("block_id"), F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("n_blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "text"))), lambda x: x["text"]), "").alias("text"))


def pair_batches(blocks: DataFrame, size: int = 8) -> DataFrame:
    """doc_id, batch, prompt: ``size`` consecutive texts joined by a blank line."""
    b = indexed_blocks(blocks).withColumn("batch", F.floor(F.col("idx") / size).cast("int"))
    return b.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n").alias("prompt"), F.count("*").alias("n_blocks"))


def attach_batches(blocks: DataFrame, responses: DataFrame, size: int = 8) -> DataFrame:
    """Parts of each response (doc_id, batch, raw), split at blank lines, back to their blocks by place."""
    b = indexed_blocks(blocks).withColumn("batch", F.floor(F.col("idx") / size).cast("int")).withColumn("pos", (F.col("idx") % size).cast("int"))
    parts = responses.select("doc_id", "batch", F.posexplode(F.split("raw", r"\n\s*\n")).alias("pos", "part"))
    return b.join(parts, ["doc_id", "batch", "pos"], "left").select("doc_id", "block_id", "idx", "text", strip(F.col("part")).alias("part"))


def outline_hints(outline: DataFrame, k: int = 12) -> DataFrame:
    """doc_id, page, hints: the first k titles on each page."""
    rn = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    return outline.withColumn("rn", rn).where(F.col("rn") <= k).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"]).alias("hints"))
