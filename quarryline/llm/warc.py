"""WARC archives of pages: a deterministic sharded writer, and a reader.

Records are sorted by page_id over ranges of pages. Each task writes its range as files of
gzip members, one a record, and begins a new file once the compressed size passes `roll_bytes`. Files
are written under temporary names that no other attempt uses. The attempts that succeed list their
files in a table; tasks rename only those to their final names, and the manifest, a folder of JSON
lines, is written last. The driver sees no list of files. Lost executors and repeated attempts therefore leave no half-written archive, and
contents don't depend on who wrote them: record ids, dates and headers follow from the rows alone.

Of records with equal payloads of at least `least_bytes`, the smallest page_id is a response, others
are revisits that name it and carry its digest and length but no payload. Who is the first of its
payload is found by a grouped minimum on the digest, combined before the shuffle.

Defined results: null html is an empty payload; rows that repeat the smallest page_id of their payload
are responses as well; a null page_id is kept, and is a response only if its payload has no other
page; a null url becomes a urn of the page_id; control characters and spaces in urls are
percent-encoded; very long payloads are written and read in one piece, one at a time; other columns
aren't looked at; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.scratch import fresh_path, materialize

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 64 << 20
ENDING = b"\r\n\r\n"
MANIFEST = "name string, records long, bytes long, sha256 string"
#: Most tasks that read archives.
FILES_READ = 50_000


def record_id(page_id: int | None) -> str:
    """A custom (version 8) UUID that holds the page_id in its last 62 bits and one more byte."""
    n = (page_id or 0) & (1 << 64) - 1
    high = 0x7175_6172_7279 << 16 | 0x8000 | (n >> 62) << 8 | (page_id is None)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | 2 << 62 | n & (1 << 62) - 1)}>"


def page_of(said: str) -> int | None:
    """The page_id that a record id holds."""
    n = uuid.UUID(said.strip("<>")[9:]).int
    if n >> 64 & 1:
        return None
    value = n & (1 << 62) - 1 | (n >> 72 & 3) << 62
    return value - (1 << 64) if value >> 63 else value


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def target_of(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if re.search(r"[^\x21-\x7e]", url) else url


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, first_url: str | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target_of(url, page_id)}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"WARC-Refers-To-Target-URI: {target_of(first_url, first)}", f"WARC-Refers-To-Date: {DATE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + ENDING + block + ENDING


def file_system(uri: str):
    """A file system that tasks can write to, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file:" + uri if not uri.startswith("file:") else "file://" + uri[5:])


def with_firsts(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Rows to write: page_id, part, url, html, key, first, first_url.

    Part 1 are the pages. Part 0 tells, before a page, the first page of an equal payload with this key;
    so payloads needn't be joined, only their keys, and are shuffled once.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    # the payload's hash is a key only; digests are made anew from the payloads when records are written
    keyed = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "url", F.sha2(F.col("html").cast("binary"), 256).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = materialize(firsts, "firsts")  # written, so that the join may split a payload of many pages
    told = keyed.select("page_id", "key").join(firsts, "key").select("page_id", "key", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")).where("not (page_id <=> first)").distinct()
    none = F.lit(None).cast("string")
    told = told.select("page_id", F.lit(0).alias("part"), none.alias("url"), none.alias("html"), "key", "first", "first_url")
    return rows.select("page_id", F.lit(1).alias("part"), "url", "html", none.alias("key"), F.lit(None).cast("long").alias("first"), none.alias("first_url")).unionByName(told)


def committed(files: DataFrame, to: str) -> DataFrame:
    """Renames the files (shard, roll, at, ...) to their final names and returns name, records, bytes, sha256.

    A task that runs again finds a file renamed already, and leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(to)
        for batch in batches:
            shard, roll, at = (batch.column(k).to_pylist() for k in range(3))
            names = [f"pages-{s:06d}-{r:06d}.warc.gz" for s, r in zip(shard, roll)]
            for one, name in zip(at, names):
                if system.get_file_info(one).type.name == "File":
                    system.move(one, posixpath.join(root, name))
                elif system.get_file_info(posixpath.join(root, name)).type.name != "File":
                    raise FileNotFoundError(one)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns[3:]], ["name", "records", "bytes", "sha256"])

    return files.select("shard", "roll", "at", "records", "bytes", "sha256").mapInArrow(run, MANIFEST)


def write_archives(pages: DataFrame, to: str, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes all records below `to` and returns the manifest: name, records, bytes, sha256 of each file."""
    spark = pages.sparkSession
    prepared = with_firsts(pages, least_bytes)
    ordered = prepared.repartitionByRange("page_id").sortWithinPartitions("page_id", "part", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(to)
        context = TaskContext.get()
        shard, attempt = context.partitionId(), f"{context.stageId()}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        done, out, begun, told = [], None, None, (None, {})
        system.create_dir(f"{root}/temporary", recursive=True)

        def close() -> None:
            out.close()
            name, at, count, size, check = begun
            done.append((shard, len(done), at, count[0], size[0], check.hexdigest()))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), *(c.to_pylist() for c in batch.columns[4:])):
                page_id, part, url, html, key, first, first_url = row
                if page_id != told[0]:
                    told = (page_id, {})
                if part == 0:
                    told[1][key] = (first, first_url)
                    continue
                payload = html.as_py().encode("utf-8", "surrogatepass")
                first, first_url = told[1].get(hashlib.sha256(payload).hexdigest(), (None, None)) if told[1] else (None, None)
                if out is None:
                    at = f"{root}/temporary/{shard:06d}-{len(done):06d}-{attempt}"
                    out, begun = system.open_output_stream(at), (None, at, [0], [0], hashlib.sha256())
                made = gzip.compress(record(page_id, url, payload, first, first_url, first is not None), 6, mtime=0)
                out.write(made)
                begun[2][0] += 1
                begun[3][0] += len(made)
                begun[4].update(made)
                if begun[3][0] >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "roll", "at", "records", "bytes", "sha256"])

    # the list of files is written before any is renamed: a task that runs again can't change it
    files = materialize(ordered.mapInArrow(run, "shard int, roll int, at string, records long, bytes long, sha256 string"), "archives")
    committed(files, to).write.json(f"{to}/manifest")
    system, root = file_system(to)
    if system.get_file_info(f"{root}/temporary").type.name == "Directory":
        system.delete_dir(f"{root}/temporary")  # what other attempts left
    return spark.read.schema(MANIFEST).json(f"{to}/manifest")


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("a record must begin with its version")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode("utf-8").partition(":")
            headers[key.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != ENDING:
            raise ValueError("a record must end with two line ends")
        yield headers, block


def read_archives(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for revisits) of each record."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    files = manifest.count()
    names = manifest.select("name").repartition(max(1, min(files, FILES_READ)), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                    for headers, block in records_in(stream):
                        head, _, payload = block.partition(ENDING)
                        if headers["warc-block-digest"] != "sha1:" + digest_of(block):
                            raise ValueError(f"block digest of {headers['warc-record-id']} in {name}")
                        whole = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        revisit = headers["warc-type"] == "revisit"
                        if not revisit and (len(payload), digest_of(payload)) != (whole, digest):
                            raise ValueError(f"payload of {headers['warc-record-id']} in {name}")
                        rows.append((page_of(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"], whole, digest, page_of(headers["warc-refers-to"]) if revisit else None, None if revisit else payload))
                        held += len(payload)
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return names.mapInArrow(run, schema)


def archived(pages: DataFrame, to: str | None = None, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes archives (below the shared folder, if no place is given) and reads every record back."""
    to = to or fresh_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, to, write_archives(pages, to, least_bytes, roll_bytes))
