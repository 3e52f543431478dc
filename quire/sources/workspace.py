"""The nested workspace file, document files, and versioned snapshots of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.structure import pack_sequential
from quire.shared import discard, shuffles_dropped, stored, written
from quire.streaming.streams import new_checkpoint

BLOCK = "id string, page int, readingOrder int, blockType string, text string, bbox array<double>, fontSize double, extractionMethod string, confidence double, footnoteMarker string, footnoteRefs array<struct<marker:string,quote:string,startOffset:int,endOffset:int>>"
PAGE = "page int, width double, height double, textLength int, blockCount int, extractionMethod string, confidence double, qualityIssue string"
OUTLINE = "id string, title string, level int, page int, blockId string, confidence double, source string"
ANCHOR = "array<struct<blockId:string,page:int,text:string,bbox:array<double>>>"
NODE = f"id string, title string, role string, attribution string, summary string, reasons array<string>, confidence double, sourceType string, userStatus string, sourceAnchors {ANCHOR}"
ISSUE = f"id string, stage string, title string, claim string, courtFact string, reasoning string, conclusion string, evidence array<string>, laws array<string>, page int, status string, confidence double, sourceAnchors {ANCHOR}"
MAX_FILE_BYTES = 100 * 1024 * 1024


def _array(ddl: str) -> T.ArrayType:
    return T.ArrayType(T.StructType.fromDDL(ddl))


def workspace_schema() -> T.StructType:
    document = T.StructType.fromDDL("id string, projectId string, kind string, title string, originalFilename string, fileSize long, contentHash string, status string, readingStatus string, ocrStatus string, analysisStatus string, currentPage int, pageCount int, averageConfidence double, characterCount long, lowConfidencePages array<int>, parsingVersion string, error string, archivedAt timestamp, createdAt timestamp, updatedAt timestamp")
    document = document.add("pages", _array(PAGE)).add("blocks", _array(BLOCK)).add("outline", _array(OUTLINE)).add("analysis", T.StructType().add("nodes", _array(NODE)).add("issues", _array(ISSUE)))
    job = "id string, documentId string, type string, status string, progress int, stage string, totalPages int, completedPages int, failedPages int, error string, createdAt timestamp, startedAt timestamp, completedAt timestamp"
    annotation = "id string, projectId string, documentId string, kind string, color string, cardType string, text string, note string, page int, blockId string, startOffset int, endOffset int, quotePrefix string, quoteSuffix string, pageRect array<double>, pageRects array<array<double>>, segments array<struct<blockId:string,startOffset:int,endOffset:int,text:string>>, anchorStatus string, tags array<string>, createdAt timestamp, updatedAt timestamp"
    return T.StructType().add("version", T.IntegerType()).add("documents", T.ArrayType(document)).add("jobs", _array(job)).add("annotations", _array(annotation))


RENAMED = {"projectId": "project_id", "documentId": "doc_id"}


def snake(name: str) -> str:
    return RENAMED.get(name) or "".join("_" + c.lower() if c.isupper() else c for c in name)


def _flat(df: DataFrame, key: str) -> DataFrame:
    """Snake-case columns; ``id`` becomes ``key``."""
    return df.select(*[F.col(c).alias(key if c == "id" else snake(c)) for c in df.columns])


#: The arrays of a workspace file that are read.
ARRAYS = ["documents", "jobs", "annotations"]
KEYED_ARRAY = r'"([^":,]*)"\s*:\s*\[\s*\{'


def workspace_items(spark: SparkSession, path: str) -> DataFrame:
    """file, name, ord, json: the objects in the top-level arrays of workspace files (UTF-8), read in splits.

    Files are cut after each closing brace. Whether a piece begins inside a string, and how deep it begins, are running sums over the
    pieces: inside a split by a window, over splits by their totals. Objects two levels down are put together from their
    pieces, so a task holds one of them at a time, not a file. The version is an item of its own. A file whose braces and
    brackets do not meet is an error; an empty file has no items.
    """
    return _items(_placed_pieces(spark, path)[0])


def _placed_pieces(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The pieces of files with what they open and end, written to the shared folder, and where."""
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("t"))
    # no brace comes right after an escape, so escapes end inside their piece; what is left of quotes then begins or ends strings
    unescaped = F.explode(F.array(F.regexp_replace("t", r"(?s)\\.", ""))).alias("e")  # of one row, so that it is done once
    e = raw.select("*", unescaped).withColumn("odd", (F.length("e") - F.length(F.replace("e", F.lit('"')))) % 2)
    rest = lambda c: F.regexp_replace(c, r'"[^"]*("|$)', "")
    depth = lambda c: F.length(F.regexp_replace(c, r"[^\[{]", "")) - F.length(F.regexp_replace(c, r"[^\]}]", ""))
    # a piece ends with a brace, which counts unless it is in a string: both ways, as what begins the piece is not known yet
    def ways(begins):
        c = F.concat(F.lit('"'), F.col("e")) if begins else F.col("e")
        return depth(rest(c)) - F.when((F.col("odd") + begins) % 2 == 0, 1).otherwise(0)

    # the patterns over texts are looked for once a piece; texts without escapes are made again, not kept beside the others
    e, pieces_at = stored(e.withColumn("d0", ways(0)).withColumn("d1", ways(1)).drop("e"), "pieces")
    before = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = e.withColumn("q", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    within = within.withColumn("in0", F.when(F.col("q") == 0, F.col("d0")).otherwise(F.col("d1"))).withColumn("in1", F.when(F.col("q") == 0, F.col("d1")).otherwise(F.col("d0")))
    # one row a split from here: what its pieces add, for either way to begin
    splits = within.groupBy("file", "split").agg((F.sum("odd") % 2).alias("odd"), F.sum("in0").alias("in0"), F.sum("in1").alias("in1"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("begins", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).withColumn("adds", F.when(F.col("begins") == 0, F.col("in0")).otherwise(F.col("in1")))
    total = F.sum("adds").over(Window.partitionBy("file"))
    # white space after the last brace is a piece, too
    level = F.when(total.isin(0, -1), F.coalesce(F.sum("adds").over(earlier), F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("not a whole workspace file: "), F.col("file"))).cast("long"))
    placed = within.join(splits.select("file", "split", "begins", level.alias("level")), ["file", "split"])
    own = F.when(F.col("begins") == 0, F.col("in0")).otherwise(F.col("in1"))
    p = placed.withColumn("adds", own).withColumn("inside", (F.col("q") + F.col("begins")) % 2)
    p = p.withColumn("start", F.col("level") + F.coalesce(F.sum("adds").over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("adds"))
    p = p.select("*", unescaped)
    closes = (F.col("inside") + F.col("odd")) % 2 == 0
    outside = F.col("inside") == 0
    level_at = lambda pattern: F.col("start") + depth(rest(F.left("e", F.position(F.regexp_extract("e", pattern, 0), F.col("e")) - 1)))
    s0 = rest(F.col("e"))
    leading = F.length(F.regexp_replace(F.regexp_extract(s0, r"^[^\[{]*", 0), r"[^\]]", ""))
    # the name of an array of objects that opens here at the top; other values at the top end what was open
    name = F.when(outside & F.col("e").rlike(KEYED_ARRAY) & (level_at(KEYED_ARRAY) == 1), F.regexp_extract("e", KEYED_ARRAY, 1)).when(outside & (F.col("start") - leading <= 1), F.lit(""))
    version = r'"version"\s*:\s*\d+'
    stated = F.when(outside & F.col("e").rlike(version) & (level_at(version) == 1), F.regexp_extract("e", r'"version"\s*:\s*(\d+)', 1))
    p = p.withColumn("opens", name).withColumn("stated", stated).withColumn("ends", (closes & (F.col("end") == 2)).cast("int"))
    upto = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("since", F.last("opens", ignorenulls=True).over(upto)).withColumn("ended", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # an item's first piece still has what stands before it
    head = F.when(F.col("opens") != "", F.regexp_replace("t", F.concat(F.lit('(?s)^.*?"'), "opens", F.lit(r'"\s*:\s*\[\s*\{')), F.lit("{"))).when(F.col("start") == 2, F.regexp_replace("t", r"^\s*,\s*", "")).otherwise(F.col("t"))
    placed = stored(p.select("file", "split", "at", "opens", "stated", "ends", "since", "ended", "end", F.concat(head, F.lit("}")).alias("t")), "placed-pieces")
    discard(spark, pieces_at)
    return placed


def _items(p: DataFrame) -> DataFrame:
    """The objects that placed pieces make up."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # names and numbers of items run on over splits as depths do
    parts = p.groupBy("file", "split").agg(F.max_by("opens", F.when(F.col("opens").isNotNull(), F.col("at"))).alias("opens"), F.sum("ends").alias("ends"))
    parts = parts.select("file", "split", F.last("opens", ignorenulls=True).over(earlier).alias("was"), F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("had"))
    p = p.join(parts, ["file", "split"]).withColumn("name", F.coalesce("since", "was")).withColumn("ord", F.col("had") + F.col("ended"))
    pieces = p.where("name <> '' and end >= 2").select("file", "name", "ord", F.struct("split", "at", "t", "ends").alias("x"))
    whole = pieces.groupBy("file", "name", "ord").agg(F.array_sort(F.collect_list("x")).alias("x")).where(F.exists("x", lambda v: v["ends"] == 1))
    items = whole.select("file", "name", "ord", F.array_join(F.transform("x", lambda v: v["t"]), "").alias("json"))
    return items.unionByName(p.groupBy("file").agg(F.max("stated").alias("json")).select("file", F.lit("version").alias("name"), F.lit(0).cast("long").alias("ord"), "json"))


def read_workspace(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Flat tables from workspace files (one JSON object each), in parallel also within a file. Missing arrays are empty, a missing version is 2.

    The files are taken apart once, when this is called; the tables are read from what it writes to the shared folder.
    """
    at = new_checkpoint(spark, "items")
    placed, placed_at = _placed_pieces(spark, path)
    with shuffles_dropped(spark):
        _items(placed).where(F.col("name").isin("version", *ARRAYS)).write.option("compression", "zstd").partitionBy("name").parquet(at)
    discard(spark, placed_at)
    items = spark.read.schema("file string, ord long, json string, name string").parquet(at)

    def array(name: str) -> DataFrame:
        schema = workspace_schema()[name].dataType.elementType
        return items.where(F.col("name") == name).select(F.from_json("json", schema).alias("x")).select("x.*")

    docs = array("documents")

    def embedded(column: Column, key: str) -> DataFrame:
        e = docs.select(F.col("id").alias("_doc"), F.posexplode(column).alias("_ord", "x")).select("_doc", "_ord", "x.*")
        out = _flat(e.drop("_doc", "_ord"), key)
        return e.select(F.col("_doc").alias("doc_id"), (F.col("_ord") + 1).alias("ord"), *[F.col(c).alias(n) for c, n in zip(e.columns[2:], out.columns, strict=True)])

    return {
        "meta": items.where("name = 'version'").select(F.greatest(F.coalesce(F.col("json").cast("int"), F.lit(2)), F.lit(2)).alias("version")),
        "documents": _flat(docs.withColumn("hasAnalysis", F.col("analysis").isNotNull()).drop("pages", "blocks", "outline", "analysis"), "doc_id"),
        "pages": embedded(F.col("pages"), "page_id"),
        "blocks": embedded(F.col("blocks"), "block_id"),
        "outline": embedded(F.col("outline"), "outline_id"),
        "nodes": embedded(F.col("analysis.nodes"), "node_id"),
        "issues": embedded(F.col("analysis.issues"), "issue_id"),
        "jobs": _flat(array("jobs"), "job_id"),
        "annotations": _flat(array("annotations"), "annotation_id"),
    }


def write_workspaces(tables: dict[str, tuple[DataFrame, str]], path: str, files: int) -> None:
    """Workspace files of whole objects: for each array its objects as JSON rows (``json``) and the column that deals them to files."""
    rows = None
    for i, (name, (df, key)) in enumerate(tables.items()):
        one = df.select(F.pmod(F.xxhash64(key), F.lit(files)).cast("int").alias("file"), F.lit(i).alias("i"), F.lit(name).alias("name"), "json")
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy("file").orderBy("i", "json")
    before, after = F.lag("i").over(w), F.lead("i").over(w)
    opening = F.concat(F.when(before.isNull(), '{"version":3,').otherwise("],"), F.lit('"'), "name", F.lit('":['))
    line = F.concat(F.when(before == F.col("i"), ",").otherwise(opening), "json", F.when(after.isNull(), "]}").otherwise(""))
    numbered = rows.select("file", "i", F.row_number().over(w).alias("n"), line.alias("value"))
    # a file's rows are in one task since they were numbered
    with shuffles_dropped(df.sparkSession):
        numbered.sortWithinPartitions("file", "n").select("file", "value").write.partitionBy("file").text(path)


def title_of(filename: Column) -> Column:
    return F.regexp_replace(filename, r"(?i)\.pdf$", "")


def describe_files(files: DataFrame) -> DataFrame:
    """path, original_filename, title, file_size, content_hash of rows of path, content: PDF names up to 100 MB."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    size = F.octet_length("content")
    return files.where(F.lower("path").endswith(".pdf") & (size <= MAX_FILE_BYTES)).select("path", name.alias("original_filename"), title_of(name).alias("title"), size.alias("file_size"), F.sha2("content", 256).alias("content_hash"))


def ingest_files(spark: SparkSession, glob: str) -> DataFrame:
    """Document files with size, title and hash; the size test comes from the listing, before any file is read."""
    files = spark.read.format("binaryFile").load(glob).where(F.col("length") <= MAX_FILE_BYTES)
    return describe_files(files.select("path", "content"))


def repair_filenames(df: DataFrame, name: str = "original_filename", title: str = "title") -> DataFrame:
    """UTF-8 names that were read as Latin-1, read right again; a title that came from the name moves along."""
    c = F.col(name)
    fixed = F.expr(f"try_validate_utf8(cast(encode({name}, 'ISO-8859-1') as string))")
    good = F.when(c.rlike(r"^[\x{0}-\x{FF}]*$"), F.coalesce(fixed, c)).otherwise(c)
    out = df.withColumn("_good", F.when(F.contains(good, F.lit("�")), c).otherwise(good))
    if title in df.columns:
        out = out.withColumn(title, F.when(F.col(title) == title_of(c), title_of(F.col("_good"))).otherwise(F.col(title)))
    return out.withColumn(name, F.col("_good")).drop("_good")


MANIFEST = "version int, name string, part string, rows long, published_at timestamp"


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, version: int = 2) -> str:
    """Publish tables as one snapshot: data in a new folder, then the manifest; readers see all or nothing.

    Returns the snapshot's id. Older snapshots stay until ``drop_obsolete`` removes them.
    """
    snapshot = uuid.uuid4().hex
    rows = []
    for name, df in tables.items():
        part = f"data/{snapshot}/{name}"
        df.write.parquet(f"{path}/{part}")
        rows.append((version, name, part, spark.read.parquet(f"{path}/{part}").count()))
    manifest = spark.createDataFrame(rows, "version int, name string, part string, rows long").withColumn("published_at", F.current_timestamp())
    manifest.coalesce(1).write.parquet(f"{path}/manifest/{snapshot}")
    return snapshot


def current_snapshot(spark: SparkSession, path: str) -> str:
    """The id of the snapshot published last; none is an error."""
    every = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path}/manifest")
    part = every.agg(F.max_by("part", F.struct("published_at", "part"))).first()[0]
    if part is None:
        raise ValueError("no snapshot")
    return part.split("/")[1]


def read_snapshot(spark: SparkSession, path: str, snapshot: str | None = None, version: int = 2) -> dict[str, DataFrame]:
    """The tables that a manifest names (the last one published unless one is given).

    A missing part, another version or another row count is an error.
    """
    snapshot = snapshot or current_snapshot(spark, path)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{snapshot}").collect()
    out = {}
    for row in manifest:
        if row["version"] != version:
            raise ValueError(f"snapshot version {row['version']}, expected {version}")
        df = spark.read.parquet(f"{path}/{row['part']}")
        if df.count() != row["rows"]:
            raise ValueError(f"part {row['part']} is incomplete")
        out[row["name"]] = df
    return out


def drop_obsolete(spark: SparkSession, path: str, keep: str) -> None:
    """Remove the data and manifests of all snapshots but one."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind in ("manifest", "data"):
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}")
        for s in fs.listStatus(top) if fs.exists(top) else []:
            if s.getPath().getName() != keep:
                fs.delete(s.getPath(), True)


#: The bytes that a part aims at, and the most that one may have.
PART_TARGET, PART_MOST = 24 * 1024, 32 * 1024
PART_MANIFEST = "name string, part int, hash string, folder string, rows long, bytes long, published_at timestamp"


def byte_parts(rows: DataFrame, name: str, order: list[str], target: int = PART_TARGET, most: int = PART_MOST) -> DataFrame:
    """name, part (from 0), value, rows, bytes, hash, too_large: the rows as JSON lists of at most ``target`` bytes, in order.

    A row over the target is a part by itself; one over ``most`` is ``too_large``, as no part may hold it.
    """
    item = F.to_json(F.struct(*rows.columns))
    sized = rows.select(F.lit(name).alias("name"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], item.alias("json")).withColumn("size", F.octet_length("json") + 1)
    packed = pack_sequential(sized, ["name"], [f"o{i}" for i in range(len(order))] + ["json"], "size", target - 1)
    place = F.struct(*[f"o{i}" for i in range(len(order))], "json")
    g = packed.groupBy("name", (F.col("pack") - 1).cast("int").alias("part")).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["json"]).alias("items"))
    g = g.withColumn("value", F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    return g.select("name", "part", "value", F.size("items").cast("long").alias("rows"), F.octet_length("value").cast("long").alias("bytes"), F.sha2("value", 256).alias("hash"), (F.octet_length("value") > most).alias("too_large"))


def publish_parts(spark: SparkSession, tables: dict[str, tuple[DataFrame, list[str]]], path: str, target: int = PART_TARGET, most: int = PART_MOST) -> str:
    """Publish tables (with the order of their rows) as parts of bounded size; returns the snapshot's id.

    A part is known by the hash of what it holds: those that the snapshot before has are not written again. The manifest
    is written last. A row that no part may hold is an error, and nothing is published.
    """
    snapshot = uuid.uuid4().hex
    parts = None
    for name, (df, order) in tables.items():
        one = byte_parts(df, name, order, target, most)
        parts = one if parts is None else parts.unionByName(one)
    parts = written(parts, "byte-parts")
    large = parts.where("too_large").groupBy("name").count().collect()
    if large:
        raise ValueError("rows over %d bytes: %s" % (most, ", ".join(f"{r['name']}: {r['count']}" for r in sorted(large))))
    known = _part_manifest(spark, path).select("hash", "folder").distinct()
    parts.join(known, "hash", "left_anti").dropDuplicates(["hash"]).select("hash", "value").write.parquet(f"{path}/parts/{snapshot}")
    manifest = parts.join(known, "hash", "left").select("name", "part", "hash", F.coalesce("folder", F.lit(snapshot)).alias("folder"), "rows", "bytes", F.current_timestamp().alias("published_at"))
    manifest.write.parquet(f"{path}/part-manifest/{snapshot}")
    return snapshot


def _part_manifest(spark: SparkSession, path: str, snapshot: str | None = None) -> DataFrame:
    """The manifest of a snapshot, or of the one published last; empty if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    top = at(f"{path}/part-manifest")
    complete = [s.getPath().getName() for s in fs.listStatus(top) if fs.exists(at(s.getPath(), "_SUCCESS"))] if fs.exists(top) else []
    if snapshot is None and complete:
        every = spark.read.schema(PART_MANIFEST).parquet(*[f"{path}/part-manifest/{s}" for s in complete]).withColumn("s", F.regexp_extract(F.input_file_name(), "part-manifest/([^/]+)/", 1))
        snapshot = every.agg(F.max_by("s", F.struct("published_at", "s"))).first()[0]
    if snapshot is None:
        return spark.createDataFrame([], PART_MANIFEST)
    return spark.read.schema(PART_MANIFEST).parquet(f"{path}/part-manifest/{snapshot}")


def read_parts(spark: SparkSession, path: str, schemas: dict[str, T.StructType], snapshot: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot (the last one published unless one is given); a part that is missing or changed is an error."""
    manifest = _part_manifest(spark, path, snapshot)
    folders = [r["folder"] for r in manifest.select("folder").distinct().collect()]
    if not folders:
        raise ValueError("no snapshot")
    held = spark.read.schema("hash string, value string").parquet(*[f"{path}/parts/{f}" for f in folders]).where(F.sha2("value", 256) == F.col("hash")).dropDuplicates(["hash"])
    lost = manifest.join(held, "hash", "left_anti").count()
    if lost:
        raise ValueError(f"{lost} parts are missing")
    found = manifest.join(held, "hash")
    return {name: found.where(F.col("name") == name).select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("x")).select("x.*") for name, schema in schemas.items()}
