"""WARC archives as a chunked record table.

Writing: a payload becomes rows (record, chunk number, bytes); each task streams its rows into one archive in the shared
folder, a gzip member a record, and reports splits (archive, first and last byte). Reading: each split is streamed into
rows (record_id, chunk_no, chunk) that carry the bytes and the SHA-256 of the payload so far, so the last row of a record
has the digest of the whole payload and no step holds more of it than a chunk.

Archives are opened through pyarrow's file systems (file, hdfs, s3, gs). An archive counts only once its task has
committed its splits: what a lost attempt leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm._shared import shared_path, ship, stored
from candela.llm.exact_dedup import annotate_copies

#: Bytes of a chunk, uncompressed bytes after which a new split begins, and payloads too small for revisits.
CHUNK, SPLIT, SMALL = 1 << 18, 1 << 23, 100
#: Compressed bytes that a reading task takes on.
TASK_BYTES = 1 << 26
#: Rows and bytes gathered before a batch is handed to Spark.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 22
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORDS = "archive string, record_id string, page_id long, url string, record_type string, refers_to long, chunk_no long, last boolean, chunk binary, bytes_so_far long, sha256_so_far string, payload_bytes long, payload_digest string"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, payload (binary), payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of SMALL bytes or more the smallest id is the response, the others revisit it; rows that repeat this
    id and payload too revisit it as well. Null payloads are empty; null ids are never revisited if another id has the payload.
    """
    payload = F.coalesce(pages[payload_col].cast("binary"), F.lit(b""))
    plain = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    out = annotate_copies(plain, plain["payload"], "page_id", keep="min", carry=("page_id", "url", "payload"))
    size = F.octet_length("_row.payload").cast("long")
    revisit = ~F.col("kept") & (size >= SMALL)
    return out.select("_row.*", size.alias("payload_bytes"), F.col("sha256").alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keep_id")).alias("refers_to"))


def chunked(records: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows (record columns, chunk_no, last, chunk), in order; a revisit and an empty payload have one empty chunk."""
    stored_bytes = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    most = F.greatest(F.ceil(stored_bytes / chunk_bytes) - 1, F.lit(0)).cast("int")
    rows = records.withColumn("_most", most).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_most"))))
    chunk = F.when(F.col("record_type") == "response", F.substr("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return rows.withColumns({"chunk": chunk, "last": F.col("chunk_no") == F.col("_most")}).drop("payload", "_most")


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, ':'.join(map(str, parts)))}>"


def _head(r: dict, seq: str) -> bytes:
    """Header of a record and of the HTTP message in it."""
    lasting = r["record_type"] == "response" and r["payload_bytes"] >= SMALL
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n"
    block = len(http) + (r["payload_bytes"] if r["record_type"] == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {_record_id(r['page_id'], r['payload_digest']) if lasting else _record_id(seq)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if r["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(r['url'], safe=chr(37) + ''.join(chr(c) for c in range(33, 127)))}")
    if r["page_id"] is not None:
        lines.append(f"X-Page-Id: {r['page_id']}")
    if r["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(r['refers_to'], r['payload_digest'])}"]
        if r["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page-Id: {r['refers_to']}")
    lines += [f"WARC-Payload-Digest: sha256:{r['payload_digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {block}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_warc(chunks: DataFrame, folder: str) -> DataFrame:
    """Write the rows of chunked(), one archive a task; returns the splits (archive, start, end, records), written too."""
    ship(chunks.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        splits, out, press = [], None, None
        start = at = raw = records = total = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for r in batch.slice(k, 64).to_pylist():
                    out = out or files.open_output_stream(f"{top}/{name}", compression=None)
                    if r["chunk_no"] == 0:
                        press, total = zlib.compressobj(1, zlib.DEFLATED, 31), total + 1
                        at += out.write(press.compress(_head(r, f"{name}:{total}")))
                    at += out.write(press.compress(r["chunk"]))
                    raw += len(r["chunk"])
                    if r["last"]:
                        at += out.write(press.compress(b"\r\n\r\n") + press.flush())
                        records += 1
                        if raw >= SPLIT:
                            splits.append((f"{folder}/{name}", start, at, records))
                            start, raw, records = at, 0, 0
        if out:
            out.close()
            if records:
                splits.append((f"{folder}/{name}", start, at, records))
        columns = list(zip(*splits)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["archive", "start", "end", "records"])

    return stored(chunks.mapInArrow(write, "archive string, start long, end long, records long"), "splits")


class _Stream:
    """Decompressed bytes of the gzip members between two places of an archive, read in small pieces."""

    def __init__(self, source, size: int):
        self.source, self.left, self.raw, self.unpack, self.data = source, size, b"", None, bytearray()

    def more(self) -> bool:
        while True:
            if self.unpack is not None and self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, None
            if not self.raw:
                self.raw = self.source.read(min(1 << 16, self.left))
                self.left -= len(self.raw)
                if not self.raw:
                    return False
            self.unpack = self.unpack or zlib.decompressobj(31)
            got = self.unpack.decompress(self.raw, CHUNK)
            self.raw = self.unpack.unconsumed_tail
            if got:
                self.data += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (k := self.data.find(mark)) < 0:
            if not self.more():
                return None
        out = bytes(self.data[:k])
        del self.data[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) < n and self.more():
            pass
        out = bytes(self.data[:n])
        del self.data[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def _records(stream: _Stream, archive: str) -> Iterator[tuple]:
    number = lambda x: None if x is None else int(x)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        warc = _fields(head)
        http = _fields(first := stream.until(b"\r\n\r\n"))
        left, digest, seen, no = int(warc["content-length"]) - len(first) - 4, hashlib.sha256(), 0, 0
        known = archive, warc["warc-record-id"], number(warc.get("x-page-id")), warc.get("warc-target-uri"), warc["warc-type"], number(warc.get("x-refers-to-page-id"))
        declared = warc["warc-payload-digest"].removeprefix("sha256:")
        while True:
            chunk = stream.take(min(CHUNK, left))
            if len(chunk) < min(CHUNK, left):
                raise ValueError(f"{archive}: {known[1]} ends early")
            left, seen = left - len(chunk), seen + len(chunk)
            digest.update(chunk)
            if not left and known[4] == "response" and (seen != int(http["content-length"]) or digest.hexdigest() != declared):
                raise ValueError(f"{archive}: the payload of {known[1]} doesn't match its header")
            yield (*known, no, not left, chunk, seen, digest.hexdigest(), int(http["content-length"]), declared)
            no += 1
            if not left:
                break
        stream.take(4)


def read_warc(splits: DataFrame, payload: bool = True) -> DataFrame:
    """Chunk rows of all records (columns of RECORDS). payload=False leaves the bytes out once they are digested."""
    spark = splits.sparkSession
    ship(spark)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [kinds[x.split()[1]] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for r in batch.to_pylist():
                files, path = pafs.FileSystem.from_uri(r["archive"])
                with files.open_input_file(path) as f:
                    f.seek(r["start"])
                    for row in _records(_Stream(f, r["end"] - r["start"]), r["archive"]):
                        held += len(row[8])
                        rows.append(row if payload else (*row[:8], None, *row[9:]))
                        if len(rows) >= BATCH_ROWS or payload and held >= BATCH_BYTES:
                            yield batch_of()
                            rows, held = [], 0
        if rows:
            yield batch_of()

    # One task for each TASK_BYTES of archives, and no fewer than the cores that there are splits for.
    n, size = splits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).head()
    tasks = max(1, -(-size // TASK_BYTES), min(n, spark.sparkContext.defaultParallelism))
    return splits.repartition(tasks, "archive", "start").mapInArrow(read, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    splits = write_warc(chunked(with_revisits(pages)), shared_path(spark, "warc"))
    last = read_warc(splits, payload=False).where("last")
    # A revisit holds no payload: its length and digest are those that its headers declare.
    own = F.col("record_type") == "response"
    return last.select("page_id", F.when(own, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(own, F.col("sha256_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


OP3_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over same as first, row_number() over (partition by payload_digest order by page_id nulls last) as n
      from p window same as (partition by payload_digest))
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= {SMALL} and n > 1 then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {SMALL} and n > 1 then first end as refers_to
from f
"""
