"""Workspace files read in splits, against the parsed objects."""

import json

import pytest

from quire.sources import workspace

ODD = ["a } b", '{"documents":[{', '"x\\":[{', "é}\\", "\\\\}", '"', '}]},"jobs":[{"id":"no"}', " \n\t ", "法}院" * 50, ""]
DOCS = [{"id": f"d{i}", "title": ODD[i % 10], "blocks": [{"id": f"b{j}", "page": 1, "readingOrder": j, "text": ODD[(i + j) % 10] + str(j), "footnoteRefs": [{"marker": "1"}]} for j in range(i % 5)], "analysis": {"nodes": [{"id": "n", "title": "}"}]} if i % 3 else None} for i in range(40)]
ROOT = {
    "note": '"jobs":[{', "settings": {"documents": [{"id": "wrong"}], "x": {"y": {}}}, "odd": [[1, {"a": 1}], [2]], "empty": [], "documents": DOCS, "tags": ["}", "{"], "other": [1, {"id": "wrong"}, {"id": "wrong"}],
    "version": 5, "jobs": [{"id": f"j{i}", "stage": ODD[i % 10]} for i in range(12)], "annotations": [], "last": {"jobs": [{"id": "wrong"}], "version": 9},
}


@pytest.mark.parametrize("indent, split", [(None, 1 << 27), (1, 900)])
def test_workspace_in_splits(spark, tmp_path, indent, split):
    (tmp_path / "a.json").write_text(json.dumps(ROOT, indent=indent, ensure_ascii=False) + "\n" * (indent or 0))
    (tmp_path / "b.json").write_text('{"documents": [{"id": "e1"}], "jobs": []}')
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d.json").write_text("")
    with_split = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in with_split}
    try:
        for k, v in with_split.items():
            spark.conf.set(k, v)
        t = workspace.read_workspace(spark, str(tmp_path))
        assert sorted(r[0] for r in t["meta"].collect()) == [2, 2, 5]
        assert {r["doc_id"]: r["title"] for r in t["documents"].collect()} == {d["id"]: d["title"] for d in DOCS} | {"e1": None}
        assert sorted((r["doc_id"], r["ord"], r["block_id"], r["text"]) for r in t["blocks"].collect()) == sorted((d["id"], n, b["id"], b["text"]) for d in DOCS for n, b in enumerate(d["blocks"], 1))
        assert sorted((r["job_id"], r["stage"]) for r in t["jobs"].collect()) == sorted((j["id"], j["stage"]) for j in ROOT["jobs"])
        assert t["nodes"].count() == 26 and t["annotations"].count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cut_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"documents":[{"id":"x"},{"id":"y"')
    with pytest.raises(Exception, match="not a whole workspace file"):
        workspace.read_workspace(spark, str(tmp_path))["documents"].collect()
