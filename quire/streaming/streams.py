"""Streams: what the batch operators compute, kept up to date.

The watermark of job progress (one hour unless given) is an addition that bounds the state of seen
pages; it is not part of the results while events are at most that late.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.annotations import recover_anchors, recover_segment_anchors, sync_annotations
from quire.shared import new_checkpoint  # noqa: F401


BUCKETS = 64
#: Manifests that stay, so that a reader of the one before still finds its files.
KEPT = 2


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


def stream_sync_annotations(incoming: DataFrame, path: str, docs: DataFrame, blocks: DataFrame, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge each micro-batch of annotations into a versioned table below ``path``.

    Documents are dealt to a fixed number of buckets. A batch reads and writes only the buckets of the documents it
    touches; a manifest, written last, names the version of every bucket. A batch starts from the newest manifest of an
    earlier batch and only strictly newer rows win, so one that runs twice gives the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        touched = sorted(r[0] for r in batch.select(bucket_of(buckets).alias("b")).distinct().collect())  # at most ``buckets``
        if touched:
            here = lambda df: df.where(bucket_of(buckets).isin(touched))
            commit(batch.sparkSession, path, batch_id, touched, buckets, batch.schema, lambda stored: sync_annotations(stored, batch, here(docs), here(blocks)))

    return incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def reanchor(spark, path: str, changed: DataFrame, blocks: DataFrame, schema, buckets: int = BUCKETS) -> None:
    """Anchor again the stored annotations of documents (changed: doc_id) whose blocks have changed, as a version of its own.

    It runs between batches: it counts as a further step of the last one.
    """
    touched = sorted(r[0] for r in changed.select(bucket_of(buckets).alias("b")).distinct().collect())
    last = newest_manifest(spark, path)
    if not touched or last is None:
        return
    ids = changed.select("doc_id").distinct()

    def again(stored: DataFrame) -> DataFrame:
        here = stored.join(ids, "doc_id", "left_semi")
        b = blocks.join(ids, "doc_id", "left_semi")
        return stored.join(ids, "doc_id", "left_anti").unionByName(recover_anchors(here, b)).unionByName(recover_segment_anchors(here, b))

    commit(spark, path, last["batch"] + 1, touched, buckets, schema, again, last["batch"])


def commit(spark, path: str, batch_id: int, touched: list[int], buckets: int, schema, change, recorded: int | None = None) -> None:
    """Write the touched buckets as ``change`` makes them of the newest manifest before ``batch_id``, then the manifest, then delete what none names."""
    base = newest_manifest(spark, path, before=batch_id) or {"version": 0, "batch": -1, "buckets": {}}
    version = base["version"] + 1
    stored = read_manifest_table(spark, path, base, schema, touched)
    change(stored).withColumn("bucket", bucket_of(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={version}")
    now = base["buckets"] | {str(b): version for b in touched}
    write_text(spark, manifest_path(path, version), json.dumps({"version": version, "batch": batch_id if recorded is None else recorded, "buckets": now}))
    clean_up(spark, path)


def manifest_path(path: str, version: int) -> str:
    return f"{path}/manifest/{version:012d}.json"


def _fs(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all."""
    fs, at = _fs(spark, path)
    _, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(beside, at):
        raise OSError(f"{path} cannot be written")


def read_text(spark, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def manifest_versions(spark, path: str) -> list[int]:
    """The manifests that are there, KEPT and one more at most."""
    fs, at = _fs(spark, f"{path}/manifest")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def newest_manifest(spark, path: str, before: int | None = None, version: int | None = None) -> dict | None:
    """The newest manifest, of a batch before ``before`` or up to ``version`` where they are given."""
    for v in reversed(manifest_versions(spark, path)):
        if version is None or v <= version:
            found = json.loads(read_text(spark, manifest_path(path, v)))
            if before is None or found["batch"] < before:
                return found
    return None


def read_manifest_table(spark, path: str, manifest: dict | None, schema, wanted: list[int] | None = None) -> DataFrame:
    named = manifest["buckets"] if manifest else {}
    fs, _ = _fs(spark, path)
    parts = [f"{path}/v={v}/bucket={b}" for b, v in sorted(named.items()) if wanted is None or int(b) in wanted]
    # a bucket all of whose rows went has no folder
    parts = [p for p in parts if fs.exists(_fs(spark, p)[1])]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def read_versions(spark, path: str, version: int | None, schema, wanted: list[int] | None = None) -> DataFrame:
    """The table at ``version`` (none: the newest), as its manifest names it."""
    return read_manifest_table(spark, path, newest_manifest(spark, path, version=version), schema, wanted)


def clean_up(spark, path: str) -> None:
    """Delete all manifests but the newest KEPT, and the files that only they name."""
    versions = manifest_versions(spark, path)
    read = {v: json.loads(read_text(spark, manifest_path(path, v)))["buckets"] for v in versions}
    named = {(b, v) for k in versions[-KEPT:] for b, v in read[k].items()}
    fs, _ = _fs(spark, path)
    for k in versions[:-KEPT]:
        for b, v in read[k].items():
            if (b, v) not in named:
                whole = v not in {x for _, x in named}
                fs.delete(_fs(spark, f"{path}/v={v}" if whole else f"{path}/v={v}/bucket={b}")[1], True)
        fs.delete(_fs(spark, manifest_path(path, k))[1], False)


def read_newest(spark, path: str, version: int | None, schema) -> DataFrame:
    """The table at ``version`` (none: the newest that is complete); empty if there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if fs.exists(fs_path):
        for s in fs.listStatus(fs_path):
            name = s.getPath().getName()
            if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                found.append(int(name[2:]))
    found = [v for v in found if version is None or v <= version]
    return spark.read.parquet(f"{path}/v={max(found)}") if found else spark.createDataFrame([], schema)


def job_progress_stream(page_results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running roll-up per job over page-result events (job_id, page, status, characters, ts); a page counts once.

    Events not after the watermark with which the batch before began are not counted: ``late_rows`` keeps them.
    """
    once = page_results.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "page"])
    return once.groupBy("job_id").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("processed"), F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("characters"))), F.lit(0)).alias("generated_characters"))


def late_rows(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", at: str = "ts") -> DataFrame:
    """Run over all that is there, batch by batch, and return the events that a roll-up of the same batches leaves out, with their batch.

    A batch is held against the watermark with which the one before it began: the latest time, in whole milliseconds, of
    the batches up to the second last, less ``delay``. The latest time of each batch is kept beside the rows, so that the
    next one knows it after a new start, too.
    """
    spark = events.sparkSession
    seen = f"{path}/seen"

    def split(batch: DataFrame, batch_id: int) -> None:
        fs, folder = _fs(spark, seen)
        before = spark.read.schema("batch long, latest timestamp").json(seen).where(F.col("batch") < batch_id - 1).agg(F.date_trunc("millisecond", F.max("latest"))).first()[0] if fs.exists(folder) else None
        limit = F.lit(before) - F.expr(f"INTERVAL {delay}") if before else F.lit(None).cast("timestamp")
        batch.where(F.col(at) <= limit).withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/late/b={batch_id}")
        latest = batch.agg(F.max(at).cast("string")).first()[0]
        write_text(spark, f"{seen}/{batch_id}.json", json.dumps({"batch": batch_id, "latest": latest}))

    q = events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    fs, folder = _fs(spark, f"{path}/late")
    return spark.read.parquet(f"{path}/late").drop("b") if fs.exists(folder) else spark.createDataFrame([], events.schema.add("batch", "long"))


def reading_position_stream(events: DataFrame) -> DataFrame:
    """The page of the latest event of each document (doc_id, page, ts)."""
    return events.groupBy("doc_id").agg(F.max_by("page", F.struct("ts", "page")).alias("page"), F.max("ts").alias("ts"))


def run_available(df: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and return its table (``complete`` or ``append`` mode).

    Each micro-batch is written to the shared folder beside the checkpoint; a complete table replaces the one before.
    """
    path = f"{checkpoint}-out"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id + 1}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = df.sparkSession
    if mode == "complete":
        return read_newest(spark, path, None, df.schema)
    return spark.read.parquet(path).drop("v")
