"""WARC archives: writing pages, reading them back, putting segmented records together.

Writing: a page becomes a ``response`` record, or a ``revisit`` of an equal payload. A block
longer than ``segment_bytes`` is cut: the first part stays in the record (segment 1), the
others follow as ``continuation`` records that name the origin and, in the last one, the total
length. Bodies of ``chunk_bytes`` or more use HTTP's chunked transfer framing. Spark's text
sink writes the files, so they are committed as any Spark output is and may lie in any store.

Reading: files are parsed record by record. Complete records are decoded where they are
read; only segments carry their bytes through the shuffle, grouped by origin identifier,
ordered by segment number, checked against the total length, then their framing is decoded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import scratch, table

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE, REVISIT_BYTES = 16_384, 4_096, 1_024, 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
PARSED = "origin string, segment int, page_id long, record_type string, refers_to long, total long, payload_bytes long, payload_digest string, claimed string, block binary, valid boolean"


def payload(html: str | Column = "html") -> Column:
    html = F.col(html) if isinstance(html, str) else html
    return F.coalesce(html.cast("string").cast("binary"), F.lit(b""))


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to: the smallest page_id with the same payload.

    refers_to is null for that page itself (and its repeated rows), for payloads under
    ``least`` bytes and for payloads whose pages all have a null id. The grouping combines
    before its shuffle; the join is on freshly dealt keys, so Spark can split a hot payload.
    """
    body = payload()
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    firsts = (
        hashed.where(F.col("size") >= least)
        .groupBy(F.unhex("digest").alias("key"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select(F.lower(F.hex("key")).alias("digest"), "first_id")
    )
    joined = hashed.join(firsts, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))


def chunked(body: bytes, size: int) -> bytes:
    """HTTP chunked transfer framing; cuts fall between characters."""
    out, at = [], 0
    while at < len(body):
        to = cut(body, at + size)
        out += [b"%x\r\n" % (to - at), body[at:to], b"\r\n"]
        at = to
    return b"".join(out) + b"0\r\n\r\n"


def cut(data: bytes, at: int) -> int:
    """The first place from ``at`` that is not inside a UTF-8 character, so that each part is text."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def unchunk(body: bytes) -> bytes | None:
    """Decode chunked framing; None if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def header(fields: dict) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n"


def clean_uri(url: str | None) -> str | None:
    return None if url is None else "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)


def records(page_id, url, html, digest, refers_to, name: str, date: str, segment_bytes: int, chunk_bytes: int) -> bytes:
    """All records of one page, each ended by two line breaks."""
    body = (html or "").encode("utf-8", "surrogatepass")
    frame = f"Content-Length: {len(body)}" if refers_to is not None or len(body) < chunk_bytes else "Transfer-Encoding: chunked"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{frame}\r\n\r\n".encode()
    if refers_to is None:
        block += chunked(body, chunk_bytes) if "chunked" in frame else body
    parts, at = [], 0
    while at < len(block):
        to = cut(block, at + segment_bytes)
        parts.append(block[at:to])
        at = to
    origin = f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"
    out = []
    for k, part in enumerate(parts, 1):
        last = k == len(parts) > 1
        fields = {"WARC-Type": "continuation" if k > 1 else "response" if refers_to is None else "revisit", "WARC-Record-ID": origin if k == 1 else f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name}#{k}')}>", "WARC-Date": date, "WARC-Target-URI": clean_uri(url)}
        if k == 1:
            fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Profile": PROFILE if refers_to is not None else None, "Page-ID": page_id, "Refers-To-Page-ID": refers_to}
        if len(parts) > 1:
            fields |= {"WARC-Segment-Number": k, "WARC-Segment-Origin-ID": origin if k > 1 else None, "WARC-Segment-Total-Length": len(block) if last else None}
        fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(part)}
        out += [header(fields), part, b"\r\n\r\n"]
    return b"".join(out)


def write_archives(planned: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write ``with_revisits()`` rows as gzip-compressed WARC files of at most ``records_per_file`` pages."""

    def run(batches):
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k += 1
                # the sink adds the last line feed
                out.append(records(*row, f"{row[0]}/{row[3]}/{task}/{k}", date, segment_bytes, chunk_bytes)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])

    (planned.mapInArrow(run, "value string").write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def parse(stream):
    """(fields, block) of each record of an archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue  # the line breaks between records
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def split_http(block: bytes) -> tuple[dict, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, body


def decode_block(kind: str, block: bytes, claimed: str | None) -> tuple[int | None, str | None, bool]:
    """Length and digest of the payload, and whether they agree with what the record claims."""
    fields, body = split_http(block)
    if kind == "revisit":
        return int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None, claimed, claimed is not None
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunk(body)
        if body is None:
            return None, None, False
    elif fields.get("content-length", "").isdigit() and int(fields["content-length"]) != len(body):
        return None, None, False
    digest = hashlib.sha256(body).hexdigest()
    return len(body), digest, claimed in (None, digest)


def number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


def parse_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path`` (plain or gzip), with bytes only for segments."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = io.BytesIO(content.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows = []
                for f, block in parse(stream):
                    kind, claimed = f.get("warc-type", ""), f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    seg = number(f.get("warc-segment-number"))
                    row = [f.get("warc-segment-origin-id") or f.get("warc-record-id"), seg, number(f.get("page-id")), kind, number(f.get("refers-to-page-id")), number(f.get("warc-segment-total-length"))]
                    size, digest, valid = decode_block(kind, block, claimed) if seg is None else (None, None, False)
                    rows.append([*row, size, digest, claimed, None if seg is None else block, valid])
                    if len(rows) >= 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in PARSED.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, PARSED)


def reassemble(parsed: DataFrame) -> DataFrame:
    """One row per logical record: segments ordered, total length verified, framing decoded.

    ``complete`` is false, and length and digest are null, when a segment is missing or repeated,
    the total length disagrees, the framing is broken or the digest is not the claimed one.
    """
    grouped = parsed.groupBy("origin").agg(
        F.max("page_id").alias("page_id"),
        F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"),
        F.max("refers_to").alias("refers_to"),
        F.max("total").alias("total"),
        F.max("payload_bytes").alias("payload_bytes"),
        F.max("payload_digest").alias("payload_digest"),
        F.max("claimed").alias("claimed"),
        F.max("valid").alias("valid"),
        F.sort_array(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "block")))).alias("segments"),
    )
    whole = F.expr("size(segments) > 0 and forall(transform(segments, (s, i) -> s.segment = i + 1), x -> x) and aggregate(segments, 0L, (a, s) -> a + octet_length(s.block)) = total")
    ready = grouped.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "claimed", "valid", F.size("segments").alias("n_segments"), F.when(whole, F.expr("aggregate(segments, cast('' as binary), (a, s) -> concat(a, s.block))")).alias("block"))

    def run(batches):
        for b in batches:
            kinds, sizes, digests, claims, valid, n, blocks = (b.column(i).to_pylist() for i in (1, 3, 4, 5, 6, 7, 8))
            for i, block in enumerate(blocks):
                if n[i]:
                    sizes[i], digests[i], valid[i] = decode_block(kinds[i], block, claims[i]) if block is not None and kinds[i] else (None, None, False)
                if not valid[i]:
                    sizes[i] = digests[i] = None
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), b.column(1), b.column(2), pa.array([max(1, x) for x in n], pa.int32()), pa.array(valid, pa.bool_())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_segments", "complete"])

    return ready.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, n_segments int, complete boolean")


def archive_round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back, one row per page.

    Null html is an empty payload; repeated rows give as many records; a null page_id stays null.
    An empty table gives no rows. Further columns are not read.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(with_revisits(pages), path, segment_bytes, chunk_bytes)
    return reassemble(parse_archives(spark, path))


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("n_segments")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
     m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q),
     r AS (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM m)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to,
       true AS complete
FROM r
"""
