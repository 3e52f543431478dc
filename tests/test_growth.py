"""What must grow no faster than its input: expressions computed once a row, tables made once a query."""

import random

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quire import shared
from quire.operators import annotations as an
from quire.operators import responses as rs
from quire.operators import structure as st
from quire.sources import workspace


def test_responses_are_parsed_once_a_row(spark):
    good = '{"warnings": ["a", " "], "nodes": [{"title": "t"}]}'
    raw = {"plain": good, "fenced": f"```json\n{good}\n```", "words": f"Here: {good} end", "spaces": f" \n{good}\ufeff", "broken": '{"warnings": [', "torn": "{x} {", "list": "[1]", "empty": "", "null": None}
    df = spark.createDataFrame([(k, v) for k, v in raw.items()], "k string, raw string")
    parsed = rs.parse_json_lenient(df, rs.PAPER_RESPONSE)
    got = {r["k"]: (r["parsed"] and r["parsed"]["warnings"], r["parse_error"], r["raw"]) for r in parsed.collect()}
    fine = {"plain", "fenced", "words", "spaces"}
    assert {k for k, v in got.items() if v[1] is None} == fine
    assert all(got[k][0] == ["a", " "] and got[k][2] == raw[k] for k in fine)
    nodes = parsed.select("k", F.posexplode("parsed.nodes").alias("ord", "n")).where("ord < 7").select("k", F.upper("n.title").alias("t"))
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2
    assert sorted(r["k"] for r in nodes.collect()) == sorted(k for k in got if got[k][1] is None)


def test_long_quotes_ask_for_few_grams(spark):
    """Texts of 400 characters hold about 390 grams; the index holds an eighth of them, and still finds every quote."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(50)]
    b = spark.createDataFrame([(1, f"b{k:02d}", k // 8, k, t) for k, t in enumerate(texts)], "doc_id int, block_id string, page int, reading_order int, text string")
    q = spark.createDataFrame([(k, 1, 0, texts[k % 50][(s := rng.randrange(350)) : s + 40]) for k in range(200)], "quote_id int, doc_id int, home_page int, quote string")
    rows = {}
    kept, an.written = an.written, lambda df, name: rows.setdefault(name, shared.written(df, name))
    try:
        got = {r["quote_id"]: r["hit"]["block_id"] for r in an.find_quotes(q, b).collect()}
    finally:
        an.written = kept
    assert got == {k: f"b{k % 50:02d}" for k in range(200)}
    assert rows["grams"].count() < sum(len(t) - 3 for t in texts) / 6


def test_keys_of_few_rows_take_one_shuffle(spark):
    """Orders are packed in one pass: no join and one exchange; keys of many rows keep their places beside them."""
    rows = [(k, i, (i * 37 + k) % 90) for k in range(40) for i in range(25)]
    d = spark.createDataFrame(rows, "k int, i int, s int")
    plan = st.pack_sequential(d, ["k"], ["i"], "s", 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    many = d.unionByName(spark.range(5000).selectExpr("cast(null as int) as k", "cast(id as int) as i", "cast(id % 7 * 20 as int) as s"))
    got = {(r["k"], r["i"]): r["pack"] for r in st.pack_sequential(many, ["k"], ["i"], "s", 100).collect()}
    want = {}
    for k, i, s in sorted([(-1 if r["k"] is None else r["k"], r["i"], r["s"]) for r in many.collect()]):
        total, pack = (0, 0) if i == 0 else (total, pack)
        total, pack = (s, pack + 1) if not pack or total + s > 100 else (total + s, pack)
        want[None if k < 0 else k, i] = pack
    assert got == want


def test_parts_are_made_once(spark, tmp_path):
    """What is hashed, written and named in the manifest is one table: rows that change from reading to reading stay whole."""
    d = spark.range(2000).select("id", F.expr("uuid()").alias("t"))
    workspace.publish_parts(spark, {"t": (d, ["id"])}, str(tmp_path / "p"))
    back = workspace.read_parts(spark, str(tmp_path / "p"), {"t": d.schema})["t"]
    assert sorted(r["id"] for r in back.collect()) == list(range(2000))


def test_ocr_blocks_are_made_once(spark):
    from quire.plans.queries import QUERIES
    from tests.conftest import SF

    plan = QUERIES["replace_pages"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 1 and "Window" not in plan


def test_near_copies_do_not_all_meet(spark, monkeypatch):
    """In a group of near copies, many of which are too far apart to link, a pair is made about once, not once a list."""
    from quire.llm import jaccard

    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = [(c, " ".join(f"e{c}x{k}" if k in at else w for k, w in enumerate(base))) for c in range(150) for at in [set(rng.sample(range(200), 1 + c % 4))]]
    made, cross = [], jaccard.cross_pairs

    def as_made(*args):
        with monkeypatch.context() as m:  # what the join itself gives
            m.setattr(DataFrame, "distinct", lambda df: df)
            made.append(cross(*args))
        return made[-1].distinct()

    monkeypatch.setattr(jaccard, "cross_pairs", as_made)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    jaccard.representatives(d, words=5, percent=80).count()
    (pairs,) = made
    assert pairs.count() <= 1.5 * pairs.distinct().count()


def test_near_copies_leave_little_behind(spark, tmp_path, monkeypatch):
    """Stars are found in one step, shuffles go with the table they made, and tables of pairs and texts when nothing reads them."""
    import os

    from quire.llm import common, jaccard
    from quire.llm import components as co

    made, kept = [], co.stored
    co.stored = lambda df, name: made.append(name) or kept(df, name)
    try:
        edges = spark.createDataFrame([(k, 1000 + k % 3) for k in range(50)], "a long, b long")
        got = {(r["node"], r["component"]) for r in co.components(edges).collect()}
    finally:
        co.stored = kept
    assert got == {(n, k) for k in range(3) for n in [*range(k, 50, 3), 1000 + k]}
    assert made.count("stars") <= 2
    monkeypatch.setattr(common, "scratch", lambda spark, name: f"file://{tmp_path}/{name}-{len(os.listdir(tmp_path))}-{os.urandom(4).hex()}")
    base = [f"w{k}" for k in range(120)]
    d = spark.createDataFrame([(c, " ".join(base[:c] + [f"e{c}"] + base[c:])) for c in range(40)], "doc_id long, text string")
    assert jaccard.link(d).select("component_id").distinct().count() == 1
    names = {f.rsplit("-", 2)[0] for f in os.listdir(tmp_path)}
    assert "signed" in names and not names & {"needed", "texts", "ends", "near-ends", "hub-pairs", "keys-met-again", "lists", "list-ends"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_blocks_of_few_ranges_are_cut_in_one_shuffle(spark):
    """One exchange, no join and no window, and more tasks where there are more rows."""
    b = spark.createDataFrame([(d, f"b{k}", "x" * (5 + k)) for d in range(20) for k in range(4)] + [(None, "b0", "xyz")], "doc_id long, block_id string, text string")
    r = spark.createDataFrame([(d, f"b{k}", f"a{j}", 2 - j, (None, 1)[j], (4, None)[j]) for d in range(20) for k in range(5) for j in range(2)], "doc_id long, block_id string, annotation_id string, ord int, start_offset int, end_offset int")
    m = spark.createDataFrame([(d, "b1", "m", 2, 3) for d in range(20)], "doc_id long, block_id string, marker string, start_offset int, end_offset int")
    out = an.split_ranges(r, m, b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, an._split_by_spans(r, m, b).collect()))
    few, an.SWEPT_IN_TASK = an.SWEPT_IN_TASK, 10
    try:
        assert an.split_ranges(r, m, b).rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        an.SWEPT_IN_TASK = few


def test_runs_are_named_once(spark):
    """The search for longest common runs is done once a pair: what follows reads what it found."""
    d = spark.createDataFrame([("x", "abcdefgh", "zzcdefzz"), ("y", "abc", "abc")], "k string, l string, r string")
    out = an.longest_common_run(d, "l", "r", "k")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 2
    assert [tuple(r) for r in out.collect()] == [("x", 2, 2, 4)]


def test_workspace_texts_are_searched_once(spark, tmp_path):
    """Pieces of workspace files are looked through once: what puts items together reads what was found."""
    (tmp_path / "w.json").write_text('{"version":3,"documents":[{"id":"a","title":"}{"},{"id":"b"}]}')
    items = workspace.workspace_items(spark, str(tmp_path))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert " text" not in plan and "regexp" not in plan
    assert sorted(r["json"] for r in items.where("name = 'documents'").collect()) == ['{"id":"a","title":"}{"}', '{"id":"b"}']


SEGMENTS = "array<struct<block_id:string,start_offset:int,end_offset:int,text:string>>"


def quoted(spark):
    """Blocks of four documents and annotations of them: exact, elsewhere in the document, nowhere, of a null document."""
    rng = random.Random(11)
    texts = {(d, k): "".join(rng.choice("ab ") for _ in range(rng.randrange(8, 40))) for d in (*range(4), None) for k in range(30)}
    b = spark.createDataFrame([(d, f"b{k:02d}", k // 8, k, t) for (d, k), t in texts.items()], "doc_id int, block_id string, page int, reading_order int, text string")
    pieces = [(d, k, texts.get((d, k), "abcdefgh" * 3)[(s := rng.randrange(6)) : s + rng.randrange(12)] + ("#" if rng.random() < 0.1 else "")) for d in (*range(5), None) for k in range(30)]
    a = [(f"a{i}", d, f"b{rng.choice([k, rng.randrange(35)]):02d}", rng.randrange(5), 7, 9, t) for i, (d, k, t) in enumerate(pieces)]
    a = spark.createDataFrame(a, "annotation_id string, doc_id int, block_id string, page int, start_offset int, end_offset int, text string").withColumn("anchor_status", F.lit("?"))
    return a, b


def by_index(monkeypatch, find):
    with monkeypatch.context() as m:
        m.setattr(an, "SEARCHED", 100)
        return sorted(map(str, find().collect()))


def test_quotes_are_found_beside_their_blocks(spark, monkeypatch):
    """In documents of common size nothing is written but the (empty) list of larger ones, and blocks and annotations are shuffled once."""
    a, b = quoted(spark)
    a = a.withColumn("segments", F.array().cast(SEGMENTS))
    made = []
    monkeypatch.setattr(an, "written", lambda df, name: made.append(name) or shared.written(df, name))
    out = an.recover_anchors(a, b)
    assert made == ["large-documents"] and out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    got = out.collect()
    assert {r["anchor_status"] for r in got} == {"exact", "recovered", "orphaned"}
    assert sorted(map(str, got)) == by_index(monkeypatch, lambda: an.recover_anchors(a, b).select(*out.columns)) and "grams" in made


def test_segments_are_found_beside_their_blocks(spark, monkeypatch):
    a, b = quoted(spark)
    # by the first text both start at its offset or have to be found
    seg = F.struct("block_id", F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"), "text")
    a = a.where("text <> ''").groupBy("doc_id", (F.xxhash64("annotation_id") % 40).alias("g")).agg(F.min("annotation_id").alias("annotation_id"), F.min("block_id").alias("block_id"), F.min("page").alias("page"), F.array_sort(F.collect_list(seg)).cast(SEGMENTS).alias("segments")).drop("g")
    a = shared.written(a.select("*", F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"), F.lit("?").alias("anchor_status")), "segmented")
    made = []
    monkeypatch.setattr(an, "written", lambda df, name: made.append(name) or shared.written(df, name))
    find = lambda: an.recover_segment_anchors(a, b).select("annotation_id", "doc_id", "block_id", "page", "start_offset", "segments", "anchor_status")
    out = find()
    assert made == ["large-documents"] and out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    got = out.collect()
    assert {r["anchor_status"] for r in got} >= {"recovered", "orphaned"}
    assert sorted(map(str, got)) == by_index(monkeypatch, find)


def test_synthesis_shuffles_texts_once(spark, monkeypatch):
    """Candidates are dealt to their documents once, whatever names them: no window, no join by name, and no table of them."""
    from quire.plans import queries_responses as qr
    from tests.conftest import SF

    made = []
    monkeypatch.setattr(shared, "stored", lambda df, name, kept=shared.stored: made.append(name) or kept(df, name))
    monkeypatch.setattr(qr, "stored", shared.stored)
    for query in (qr.synthesize_issues, qr.synthesize_nodes, qr.case_summary):
        made.clear()
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and not [x for x in plan.splitlines() if "Join" in x and "candidate_id" in x]
        assert sorted(made) == ["chunk-ids", "chunks", "responses"]


def test_a_final_row_takes_what_its_candidates_say(spark):
    """Names in their order, unknown ones left out; a document without final rows has its first candidates; ids that exist, once."""
    schema = "title string, role string, attribution string, summary string, reasons array<string>, sourceBlockIds array<string>, candidateIds array<string>, confidence double"
    node = lambda n, ids, names=None, title=None: (title, None, None, f"s{n}", [f"r{n}"], ids, names, None)
    rows = [(1, "c2", "map", ([node(1, ["b2", "no"])],)), (1, "c1", "map", ([node(2, ["b1"]), node(3, ["b1", "b0"])],)), (2, "c1", "map", ([node(4, ["b1"])] * 9,)), (2, "lost", "map", ([node(5, ["b1"])],)), (None, "c1", "map", ([node(6, ["b1"])],)), (1, "reduce", "reduce", ([node(7, ["b3", "b2"], ["c1-node-2", "none", "c2-node-1"], "T")],))]
    parsed = spark.createDataFrame(rows, f"doc_id int, chunk_id string, stage string, parsed struct<nodes:array<{rs.struct_of(schema)}>>")
    chunks = spark.createDataFrame([(d, c, o, ids) for d in (1, 2, None) for c, o, ids in (("c1", 0, ["b0", "b1"]), ("c2", 1, ["b2", "b3"]))], "doc_id int, chunk_id string, ord int, block_ids array<string>")
    b = spark.createDataFrame([(d, f"b{k}", k, f"t{k}") for d in (1, 2, None) for k in range(4)], "doc_id int, block_id string, page int, text string")
    c = rs.normalize_map_nodes(parsed.where("stage = 'map'"), chunks)
    assert sorted((r["doc_id"] or 0, r["candidate_id"], r["chunk_ord"], r["block_ids"]) for r in c.collect() if r["doc_id"] != 2) == [(0, "c1-node-1", None, []), (1, "c1-node-1", 0, ["b1"]), (1, "c1-node-2", 0, ["b1", "b0"]), (1, "c2-node-1", 1, ["b2"])]
    out = {(r["doc_id"], r["ord"]): r for r in rs.synthesize_nodes(parsed, c, b).collect()}
    assert sorted((k[0] or 0, k[1]) for k in out) == [(0, 0), (1, 0)] + [(2, k) for k in range(8)]
    one = out[1, 0]
    assert (one["title"], one["summary"], one["reasons"]) == ("T", "s7", ["r7"]) and [a["block_id"] for a in one["source_anchors"]] == ["b1", "b0", "b2", "b3"] and one["source_anchors"][1]["text"] == "t0"
    # a place that is not known comes first
    assert [out[2, k]["summary"] for k in range(8)] == ["s5"] + ["s4"] * 7 and out[2, 0]["source_type"] == "ai_inference" and out[None, 0]["source_anchors"] == []


def test_ids_of_responses_are_not_broadcast(spark):
    """Responses of ids take so little room that a broadcast would look cheap at any size."""
    from quire.plans.queries import QUERIES
    from tests.conftest import SF

    for name in ("full_text_issues", "full_text_sections", "full_text_nodes"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Broadcast") == 0, name


def test_workspaces_leave_only_their_items(spark, tmp_path, monkeypatch):
    """Pieces go when they are placed, placed ones when items are whole; files are written after one shuffle."""
    import os

    at = lambda s, name: f"file://{tmp_path}/{name}-{len(os.listdir(tmp_path))}"
    monkeypatch.setattr(shared, "new_checkpoint", at)
    monkeypatch.setattr(workspace, "new_checkpoint", at)
    d = spark.range(300).selectExpr("id", "to_json(named_struct('id', cast(id AS string), 'title', concat('}{\"', repeat('x', cast(id % 50 AS int))))) AS json")
    workspace.write_workspaces({"documents": (d, "id"), "jobs": (d, "id")}, str(tmp_path / "files"), 3)
    t = workspace.read_workspace(spark, str(tmp_path / "files" / "*"))
    assert {f.split("-")[0] for f in os.listdir(tmp_path)} == {"files", "items"}
    assert {r["doc_id"]: len(r["title"]) for r in t["documents"].collect()} == {str(k): 3 + k % 50 for k in range(300)} and t["jobs"].count() == 300
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
