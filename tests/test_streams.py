"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from quire.operators.annotations import sync_annotations
from quire.plans import adapters as ad
from quire.streaming import streams


def test_sync_equals_batch(spark, sf, tmp_path):
    docs, blocks = ad.documents(spark, sf).select("doc_id", "project_id", "page_count"), ad.blocks(spark, sf)
    a = ad.annotations(spark, sf).where("doc_id < 30 and text <> ''")
    newer = a.where("doc_id % 2 = 0").withColumn("note", F.lit("newer")).withColumn("updated_at", F.lit("2025-01-01").cast("timestamp"))
    older = a.where("doc_id % 3 = 0").withColumn("note", F.lit("older")).withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    for i, part in enumerate((a, newer, older)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = streams.stream_sync_annotations(source, str(tmp_path / "out"), docs, blocks, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    got = streams.read_versions(spark, str(tmp_path / "out"), None, a.schema)
    every = a.unionByName(newer).unionByName(older)
    want = sync_annotations(a.limit(0), every, docs, blocks)
    pick = lambda d: sorted(tuple(r) for r in d.select("annotation_id", "note", "anchor_status", "block_id", "start_offset").collect())
    assert pick(got) == pick(want) and got.count() == a.count()


ROW = "annotation_id string, doc_id long, note string"


def test_manifest_names_what_is_read(spark, tmp_path):
    """Many batches: the listing stays as it is, superseded files go, a batch that runs again changes nothing."""
    path, buckets = str(tmp_path / "t"), 4
    want, sizes = {}, set()
    for batch in range(14):
        new = [(f"a{batch % 5}-{d}", d, f"n{batch}") for d in range(batch % 3, 12, 3)]
        rows = spark.createDataFrame(new, ROW).coalesce(1)
        touched = sorted(r[0] for r in rows.select(streams.bucket_of(buckets)).distinct().collect())
        put = lambda stored, rows=rows: stored.join(rows.select("annotation_id"), "annotation_id", "left_anti").unionByName(rows)
        for _ in range(2 if batch in (5, 9) else 1):
            streams.commit(spark, path, batch, touched, buckets, rows.schema, put)
        want |= {i: (d, n) for i, d, n in new}
        sizes.add(len(streams.manifest_versions(spark, path)))
        held = [p for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")]
        assert len(held) <= buckets + streams.KEPT
        assert {r[0]: tuple(r)[1:] for r in streams.read_versions(spark, path, None, rows.schema).collect()} == want
    assert max(sizes) <= streams.KEPT
    newest = streams.newest_manifest(spark, path)
    assert newest["batch"] == 13 and streams.newest_manifest(spark, path, before=13)["batch"] == 12
    # a batch that broke off before its manifest leaves the table as it was
    (tmp_path / "t" / f"v={newest['version'] + 1}" / "bucket=0").mkdir(parents=True)
    assert streams.read_versions(spark, path, None, rows.schema).count() == len(want)


def test_changed_blocks_anchor_again(spark, sf, tmp_path):
    docs, blocks = ad.documents(spark, sf).select("doc_id", "project_id", "page_count"), ad.blocks(spark, sf)
    a = ad.annotations(spark, sf).where("doc_id in (0, 3, 6) and text <> '' and length(text) > 20")
    a.coalesce(1).write.parquet(str(tmp_path / "in" / "p0"))
    q = streams.stream_sync_annotations(spark.readStream.schema(a.schema).parquet(str(tmp_path / "in" / "*")), str(tmp_path / "out"), docs, blocks, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    before = {r["annotation_id"]: r for r in streams.read_versions(spark, str(tmp_path / "out"), None, a.schema).collect()}
    moved = blocks.withColumn("text", F.when(F.col("doc_id") == 3, F.concat(F.lit(">> "), "text")).when(F.col("doc_id") == 6, F.lit("gone")).otherwise(F.col("text")))
    streams.reanchor(spark, str(tmp_path / "out"), spark.createDataFrame([(3,), (6,)], "doc_id long"), moved, a.schema)
    after = {r["annotation_id"]: r for r in streams.read_versions(spark, str(tmp_path / "out"), None, a.schema).collect()}
    assert before.keys() == after.keys() and len(after) > 10
    for i, r in after.items():
        old = before[i]
        want = {0: (old["anchor_status"], old["start_offset"]), 3: ("exact", old["start_offset"] + 3), 6: ("orphaned", old["start_offset"])}[r["doc_id"]]
        assert (r["anchor_status"], r["start_offset"]) == want
    assert streams.newest_manifest(spark, str(tmp_path / "out"))["batch"] == 0
