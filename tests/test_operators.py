"""Golden rows, with CJK text that the given tables lack, and properties."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.functions.text import normalize_text, round_half_up
from quire.operators import annotations as an
from quire.operators import citations as ci
from quire.operators import footnotes as fo
from quire.operators import jobs as jo
from quire.operators import pages as pa
from quire.operators import research as re_
from quire.operators import responses as rs
from quire.operators import structure as st
from quire.sources import reports, workspace


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_normalize_text(spark):
    d = spark.createDataFrame([("中 文　 字 a  b c\x00",), (None,)], "t string")
    assert [r[0] for r in d.select(normalize_text(F.col("t"))).collect()] == ["中文字 a b c", ""]
    assert spark.range(1).select(round_half_up(F.lit(-0.5)), round_half_up(F.lit(2.5))).first()[:] == (0, 3)


def test_group_lines_first_fit(spark):
    items = [("d", 1, i, s, x, y, 10.0, 10.0, 10.0) for i, (s, x, y) in enumerate([("B", 20.0, 101.0), ("A", 0.0, 100.0), ("C", 0.0, 50.0), ("", 0.0, 10.0)])]
    d = spark.createDataFrame(items, "doc_id string, page int, item_no int, str string, x double, y double, width double, height double, font_size double")
    for exact in (True, False):
        got = pa.group_lines(d, exact).select("block_id", "text", "bbox").orderBy("reading_order").collect()
        assert [(r["block_id"], r["text"]) for r in got] == [("b-1-1", "A B"), ("b-1-2", "C")]
        assert got[0]["bbox"] == [0.0, 100.0, 30.0, 10.0]


@pytest.mark.parametrize("text,issue", [("短", "too_little_text"), ("�" * 2 + "x" * 100, "broken_character_map"), ("的" * 60, "suspicious_glyph_repetition"), ("x" * 60, None)])
def test_page_quality(spark, text, issue):
    d = spark.createDataFrame([("d", 1, text)], "doc_id string, page int, text string")
    assert pa.page_text_quality(d).first()["quality_issue"] == issue


def blocks(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, f"b{i:03d}", 1 + i // 8, i, "paragraph", t) for i, t in enumerate(texts)], "doc_id string, block_id string, page int, reading_order int, block_type string, text string")


def test_headings(spark):
    b = blocks(spark, ["摘要", "第一章 总论", "一、问题", "（二）方法", "1.1 scope", "这是正文。", "研究方法", "这里是一段足够长的正文文字，用来让前面的小标题成立并且超过二十四个字。", "1. 某某，出版社"])
    got = rows(st.detect_headings(b).select("text", "level", "confidence", "reading_order"), "reading_order")
    assert [(t, lv, c) for t, lv, c, _ in got] == [("摘要", 1, 0.9), ("第一章 总论", 1, 0.9), ("一、问题", 1, 0.9), ("（二）方法", 2, 0.9), ("1.1 scope", 2, 0.9), ("研究方法", 1, 0.72)]


def test_judgment_check(spark):
    """Twelve one-block pages of about 8 400 characters: twelve chunks of one opening section, map and reduce."""
    b = spark.createDataFrame([("j", f"block-{i}", i, 0, "paragraph", "判" * 8400) for i in range(1, 13)], "doc_id string, block_id string, page int, reading_order int, block_type string, text string")
    outline = spark.createDataFrame([("j", "o1", "t", None, 1, "block-1", 1)], "doc_id string, outline_id string, title string, level int, page int, block_id string, ord int")
    chunks = st.analysis_chunks(b, outline)
    assert chunks.count() == 12 and {r["section_id"] for r in chunks.collect()} == {"document-opening"}
    req = st.build_requests(chunks)
    assert {(r["stage"], r["count"]) for r in req.groupBy("stage").count().collect()} == {("map", 12), ("reduce", 1)}
    raw = '{"issues": [{"title": "争议", "claim": "c", "sourceBlockIds": ["%s"]}]}'
    resp = chunks.select("doc_id", "chunk_id", F.lit("map").alias("stage"), F.format_string(raw, F.element_at("block_ids", 1)).alias("raw"))
    issue_type = "issues array<struct<" + ",".join(x.split()[0] + ":" + x.split()[1] for x in rs.ISSUE_SCHEMA.split(", ")) + ">>"
    cand = rs.normalize_map_issues(rs.parse_json_lenient(resp, issue_type), chunks)
    reduce_raw = '{"issues": [' + ",".join('{"candidateIds": ["section-part-%d-issue-1"]}' % i for i in range(1, 13)) + "]}"
    final = rs.synthesize_issues(rs.parse_json_lenient(spark.createDataFrame([("j", "reduce", "reduce", reduce_raw)], "doc_id string, chunk_id string, stage string, raw string"), issue_type), cand, b.withColumn("bbox", F.lit(None).cast("array<double>")))
    got = final.collect()
    assert len(got) == 12 and all(len(r["source_anchors"]) == 1 and r["claim"] == "c" for r in got)


def test_pack_properties(spark):
    d = spark.range(300).select((F.col("id") % 7).alias("k"), "id", ((F.col("id") * 37) % 50 + 1).alias("size"))
    packed = st.pack_sequential(d, ["k"], ["id"], "size", 100)
    assert packed.count() == 300
    assert packed.groupBy("k", "pack").agg(F.sum("size").alias("s"), F.count("*").alias("n")).where("s > 100 and n > 1").isEmpty()


def test_footnotes(spark):
    body = spark.createDataFrame([("d", "b1", 5, [Row(marker="1", quote="q", start_offset=0, end_offset=1)])], "doc_id string, block_id string, page int, footnote_refs array<struct<marker:string,quote:string,start_offset:int,end_offset:int>>")
    notes = spark.createDataFrame([("d", "n1", 1, 1, "1 a", None), ("d", "n2", 6, 1, "x", "1"), ("d", "n3", 4, 2, "1 c", None)], "doc_id string, block_id string, page int, reading_order int, text string, footnote_marker string")
    linked = fo.link_footnotes(body, notes)
    assert linked.first()["target_footnote_id"] == "n3"
    assert [len(r["footnote_references"] or []) for r in fo.reverse_footnote_refs(linked, notes).orderBy("block_id").collect()] == [0, 0, 1]


def test_recovered_footnotes_skip_repeats(spark):
    o = spark.createDataFrame([("d", "o1", "1 张三：《书》，法律出版社2000年版", 1, None, 1), ("d", "o2", "1 张三：《书》，法律出版社", 1, None, 2)], "doc_id string, outline_id string, title string, page int, block_id string, ord int")
    notes = spark.createDataFrame([], "doc_id string, page int, reading_order int, text string")
    assert fo.recover_footnotes(o, notes).count() == 1


def test_citation_year_is_no_marker(spark):
    d = spark.createDataFrame([("2010 年第 3 期",), ("[12] 张三：《题》，载《刊》2001年第2期，第3-5页",)], "text string")
    a, b = ci.normalize_citations(d).collect()
    assert a["original"].startswith("2010") and b["formatted"] == "张三：《题》，载《刊》2001年第2期，第3-5页。" and b["issues"] == []


def test_longest_common_run(spark):
    d = spark.createDataFrame([("k", "xxabcdefyy", "zzzabcdefw"), ("l", "abc", "abd")], "key string, a string, b string")
    assert [tuple(r) for r in an.longest_common_run(d, "a", "b", "key").collect()] == [("k", 2, 3, 6)]


def test_resolve_ranges_slice_back(spark):
    b = blocks(spark, ["alpha beta gamma delta"])
    base = dict(doc_id="d", block_id="b000", start_offset=0, end_offset=0)
    a = spark.createDataFrame([Row(annotation_id="f", text="beta  gamma", **base), Row(annotation_id="r", text="zz gamma delta zz", **base)]).withColumn("segments", F.array().cast("array<struct<block_id:string,start_offset:int,end_offset:int,text:string>>"))
    got = {r["annotation_id"]: "alpha beta gamma delta"[r["start_offset"] : r["end_offset"]] for r in an.resolve_ranges(a, b).collect()}
    assert got == {"f": "beta gamma", "r": "gamma delta"}


def test_segments_recover(spark):
    b = blocks(spark, ["hello world", "moved text"])
    seg = lambda t: [Row(block_id="b000", start_offset=0, end_offset=len(t), text=t)]
    a = spark.createDataFrame([("e", "d", "b000", 1, 0, 5, seg("hello")), ("m", "d", "b000", 1, 0, 5, seg("moved")), ("o", "d", "b000", 1, 0, 5, seg("gone!"))], "annotation_id string, doc_id string, block_id string, page int, start_offset int, end_offset int, segments array<struct<block_id:string,start_offset:int,end_offset:int,text:string>>").withColumn("anchor_status", F.lit("exact"))
    assert rows(an.recover_segment_anchors(a, b).select("annotation_id", "anchor_status", "block_id"), "annotation_id") == [("e", "exact", "b000"), ("m", "recovered", "b001"), ("o", "orphaned", "b000")]


def test_last_writer_wins_any_arrival_order(spark):
    s = spark.createDataFrame([("a", 5, "s"), ("b", 1, "s")], "k string, t int, v string")
    i = spark.createDataFrame([("a", 5, "i"), ("b", 2, "i"), ("b", 3, "j"), ("c", 1, "i")], "k string, t int, v string")
    want = [("a", 5, "s"), ("b", 3, "j"), ("c", 1, "i")]
    assert rows(an.last_writer_wins(s, i, ["k"], "t"), "k") == want
    step = an.last_writer_wins(an.last_writer_wins(s, i.where("t > 2"), ["k"], "t"), i.where("t <= 2"), ["k"], "t")
    assert rows(step, "k") == want


def test_lenient_json(spark):
    d = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('so: {"a": 2} ok',), ('{"a": 3',), (None,), ("",)], "raw string")
    got = [(r["parsed"]["a"] if r["parsed"] else None, r["parse_error"] is None) for r in rs.parse_json_lenient(d, "a int").collect()]
    assert got == [(1, True), (2, True), (None, False), (None, False), (None, False)]


def test_seed_without_anchors_is_demoted(spark):
    n = spark.createDataFrame([("d", "understood", None)], "doc_id string, user_status string, source_anchors array<string>")
    c = spark.createDataFrame([("c", "已核验", None)], "card_id string, verify_status string, source_anchor string")
    assert re_.demote_nodes(n).first()["user_status"] == "doubt" and re_.demote_cards(c).first()["verify_status"] == "待核验"


def test_titles_sort_as_chinese_readers_sort(spark):
    from quire.operators import search as se

    d = spark.createDataFrame([(i, t, None, None, 1, 1) for i, t in enumerate(["张三", "阿姨", "李四"])], "doc_id int, title string, archived_at timestamp, updated_at timestamp, page_count int, current_page int")
    assert [r["title"] for r in se.filter_documents(d, order="title").collect()] == ["阿姨", "李四", "张三"]


def test_marked_up_layout(spark):
    raw = spark.createDataFrame([("d", 1, 1, "text", "# **Title** here, yes", [0.1, 0.1, 0.2, 0.2]), ("d", 1, 2, "text", "> some *quoted* `code`, and more", [0.1, 0.1, 0.2, 0.2]), ("d", 1, 3, "image", "x", None)], "doc_id string, page int, item_no int, label string, content string, bbox array<double>")
    md = spark.createDataFrame([("d", 1, "# **Title** here, yes\ntext")], "doc_id string, page int, markdown string")
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page int, width double, height double")
    got = rows(pa.normalize_layout_blocks(raw, md, pages).select("reading_order", "block_type", "text"), "reading_order")
    assert got == [(1, "heading", "Title here, yes"), (2, "paragraph", "some quoted code, and more")]


def test_real_response_keys(spark):
    """A paper's answers with the keys that the prompts ask for."""
    raw = '{"sectionSummary": "sum", "sectionAnalysis": {"legalQuestion": "q", "analysisApproach": "a", "framework": ["f"], "sourceBlockIds": ["b000", "zz"]}, "nodes": [{"title": "t", "sourceBlockIds": ["b001"]}, {"summary": ""}], "warnings": ["w"]}'
    b = blocks(spark, ["one", "two"]).withColumn("bbox", F.lit(None).cast("array<double>"))
    chunks = spark.createDataFrame([("d", "section-part-1", "s", "T", 1, 1, 1, ["b000", "b001"])], "doc_id string, chunk_id string, section_id string, title string, start_page int, end_page int, ord int, block_ids array<string>")
    parsed = rs.parse_json_lenient(spark.createDataFrame([("d", "map", "section-part-1", raw)], "doc_id string, stage string, chunk_id string, raw string"), rs.PAPER_RESPONSE)
    r = rs.normalize_chunk_reading(parsed, chunks, b).first()
    assert (r["legal_question"], r["summary"], r["approach"], r["framework"], r["block_ids"]) == ("q", "sum", "a", ["f"], ["b000"])
    n = rs.normalize_map_nodes(parsed, chunks).collect()
    assert [(x["candidate_id"], x["title"], x["role"], x["block_ids"], x["confidence_pct"]) for x in n] == [("section-part-1-node-1", "t", "论证展开", ["b001"], 70.0)]


def test_pending_work(spark):
    r = spark.createDataFrame([("d", "ocr_page", False, 1), ("e", "ocr_page", False, 1), ("e", "ocr_all", False, 2)], "doc_id string, type string, forced boolean, requested_at int")
    j = spark.createDataFrame([("d", "ocr_all", "running")], "doc_id string, type string, status string")
    assert [(x["doc_id"], x["type"]) for x in jo.pending_work(r, j).collect()] == [("e", "ocr_page")]


def test_filename_repair(spark):
    bad = "法条.pdf".encode().decode("latin-1")
    d = spark.createDataFrame([(bad, bad[:-4]), ("ok é.pdf", "own")], "original_filename string, title string")
    assert rows(workspace.repair_filenames(d), "title") == [("ok é.pdf", "own"), ("法条.pdf", "法条")]


def test_workspace_and_snapshot(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"documents": [{"id": "d", "projectId": "p", "blocks": [{"id": "b", "page": 1, "readingOrder": 1, "text": "t", "bbox": [1,2,3,4]}]}]}')
    t = workspace.read_workspace(spark, str(tmp_path / "w.json"))
    assert t["blocks"].select("doc_id", "block_id", "bbox").first()[:] == ("d", "b", [1.0, 2.0, 3.0, 4.0]) and t["jobs"].count() == 0 and t["meta"].first()[0] == 2
    s = workspace.write_snapshot(spark, {"blocks": t["blocks"]}, str(tmp_path / "snap"))
    assert workspace.read_snapshot(spark, str(tmp_path / "snap"), s)["blocks"].count() == 1
    with pytest.raises(ValueError):
        workspace.read_snapshot(spark, str(tmp_path / "snap"), s, version=3)
    last = workspace.write_snapshot(spark, {"blocks": t["blocks"].limit(0)}, str(tmp_path / "snap"))
    assert workspace.current_snapshot(spark, str(tmp_path / "snap")) == last != s
    assert workspace.read_snapshot(spark, str(tmp_path / "snap"))["blocks"].count() == 0


def test_matrix_report(spark):
    p = spark.createDataFrame([("p", "q?")], "project_id string, question string")
    r = spark.createDataFrame([("p", "card:1", "争点", "支持", "用户摘录", "文", 3, "题|")], "project_id string, row_key string, issue string, stance string, evidence_type string, doc_title string, page int, title string")
    assert reports.matrix_report(r, p).first()["report"].endswith("| 争点 | 支持 | 用户摘录 | 文，第 3 页：题\\| |")
