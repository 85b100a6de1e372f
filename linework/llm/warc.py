"""Operator 2: WARC archives and their chunked record table.

Pages are written as records of gzipped WARC files, payloads slice by slice.
Records with equal payloads are written once as response; the others are revisit
records that refer to it.  Archives are read back as a table of chunks: record
and chunk number, the chunk's bytes, and the SHA-1 of the payload up to and
including the chunk.  Readers hold one chunk at a time, so a record of any size
takes no more memory than a small one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import hidden, join_counted, local_fs, scratch, shown, table, written

#: Bytes of a chunk: what is read, hashed and sent at once.
CHUNK_BYTES = 64 << 10
#: Payloads from this size on are deduplicated.
MIN_BYTES = 0
#: An archive is closed when it has so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
#: Chunks are handed to Spark when so many bytes are waiting.
FLUSH_BYTES = 4 << 20
DATE = "2000-01-01T00:00:00Z"
RECORD = "urn:record:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = "record_id string, chunk_no int, offset long, data binary, digest string, last boolean, payload_bytes long, record_type string, refers_to string, target_uri string, intact boolean"


def marked(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages with sha1 (hex) and refers_to: the largest key among the rows of an equal payload, null for that row itself.

    Equal means equal in SHA-1, SHA-256 and size.  A null payload is empty.  Rows
    that share the largest key are all responses.  A row with a null key refers to the
    largest key like any other; of rows that all have null keys each is a response.
    Columns of pages called sha1 or refers_to (in any
    case) are replaced, all others keep their values.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(*hidden(pages), F.col(key).alias("key__"), F.sha1(body).alias("sha1__"), F.sha2(body, 256).alias("sha2__"), F.octet_length(body).alias("bytes__"))
    digests = ["sha1__", "sha2__", "bytes__"]
    same = rows.groupBy(*digests).agg(F.max("key__").alias("first__"), F.count("*").alias("n__"))
    same = same.where((F.col("n__") > 1) & (F.col("bytes__") >= min_bytes))
    rows = join_counted(rows, same, digests, "n__", "key__")
    return rows.select(*shown(pages.columns, ("sha1", "refers_to")), F.col("sha1__").alias("sha1"), F.when(~F.col("key__").eqNullSafe(F.col("first__")), F.col("first__")).alias("refers_to"))


def header(kind: str, record: str, uri: str, sha1: str, refers_to: str | None, size: int, date: str) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record; the latter has the size of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{RECORD}{record}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_archives(rows: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = DATE, chunk: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row of marked() and returns the manifest (path, records) of the archives.

    Each attempt of a task writes files of its own, and the manifest has those
    of the attempts that Spark committed, so lost or repeated tasks leave
    unused files and no double records.
    """
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"), "sha1", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches):
        fs, base = local_fs(folder)
        fs.create_dir(base, recursive=True)
        part, out, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, records = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                record, uri, sha1, refers_to = (columns[k][i].as_py() for k in (0, 1, 3, 4))
                body = memoryview(columns[2][i].as_buffer() if columns[2][i].is_valid else b"")
                kind = "response" if refers_to is None else "revisit"
                uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")
                head, http = header(kind, record or "", uri, sha1, refers_to, len(body), date)
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                pieces = [head + http, *(body[k : k + chunk] for k in range(0, len(body), chunk) if kind == "response"), b"\r\n\r\n"]
                for piece in pieces:
                    if packed := member.compress(piece):
                        out.write(packed)
                        size += len(packed)
                packed = member.flush()
                out.write(packed)
                size, records = size + len(packed), records + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n, _ in done], pa.string()), pa.array([r for _, r in done], pa.int64())], names=["path", "records"])

    return written(rows.mapInArrow(run, "path string, records long"), "manifest")


def chunks_of(stream, chunk: int):
    """Rows of CHUNK_SCHEMA of an uncompressed WARC stream, one chunk in memory at a time."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        full = 0
        while left:
            line = stream.readline(left)
            left -= len(line)
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                full = int(value)
            if line in (b"\r\n", b"\n"):
                break
        bare = lambda v: v.strip("<>").removeprefix(RECORD) if v else None
        named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        kind = fields.get("warc-type")
        common = (full, kind, bare(fields.get("warc-refers-to")), fields.get("warc-target-uri"))
        record, sha, at, number = bare(fields["warc-record-id"]), hashlib.sha1(), 0, 0
        if kind == "revisit":
            yield (record, 0, 0, b"", named, True, *common, None)
        while kind != "revisit":
            data = stream.read(min(chunk, left))
            if left and not data:
                raise EOFError(f"record {record} ends early")
            sha.update(data)
            left -= len(data)
            digest = base64.b32encode(sha.digest()).decode()
            yield (record, number, at, data, digest, left == 0, *common, (digest == named and at + len(data) == full) if left == 0 else None)
            at, number = at + len(data), number + 1
            if not left:
                break


def read_chunks(manifest: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the archives in a manifest; a task reads one archive after the other.

    A record without payload has one empty chunk.  A revisit has one empty chunk
    with the digest and size of the payload that it stands for.  intact, on the
    last chunk, says whether digest and size are those that the header names.
    """
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [types[f.split()[1]] for f in CHUNK_SCHEMA.split(", ")]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = local_fs(path)
                with fs.open_input_stream(at, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) as stream:
                    for row in chunks_of(stream, chunk):
                        waiting.append(row)
                        size += len(row[3]) + 200
                        if size >= FLUSH_BYTES:
                            yield packed(waiting)
                            waiting, size = [], 0
        if waiting:
            yield packed(waiting)

    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives).mapInArrow(run, CHUNK_SCHEMA)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = write_archives(marked(pages), scratch(spark, "warc"))
    ends = read_chunks(manifest).where("last")
    return ends.select(F.nullif("record_id", F.lit("")).cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), F.coalesce("intact", F.lit(True)).alias("intact"))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, b, sha1(b) AS hex FROM p),
bits AS (SELECT *, array_to_string(list_transform(string_split(regexp_replace(upper(hex), '(.)', '\\1 ', 'g'), ' ')[1:40],
    lambda x: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789ABCDEF', x)]), '') AS bits FROM h),
d AS (SELECT page_id, payload_bytes, b, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda k: CAST(substr(bits, (i * 5 + k + 1)::BIGINT, 1) AS BIGINT) << (4 - k)))::BIGINT, 1)), '') AS payload_digest FROM bits),
m AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to, true AS intact FROM m
"""
