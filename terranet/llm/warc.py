"""WARC archives written and read as a chunked record table.

A payload never exists as one Python object: it passes as rows (record, chunk
number, bytes) of at most CHUNK bytes.  The writer streams the rows of a record
into one gzip member of a .warc.gz file; the reader streams members back into
such rows, each with the SHA-256 of the payload up to and with its chunk.

Pages are read once, in a stage that only writes them again in row groups of
GROUP_BYTES: a reader holds a whole row group, however large, and next to the
sorted shuffle of the payloads, which takes all execution memory, that is too much.

Of the records with equal payloads of at least ``least`` bytes the one with the
smallest page_id is a response, the others are revisits of it without payload
(the HTTP header they carry tells its length).  A null html is an empty payload, a
null page_id is never revisited and gives a response, a null url has no target URI.
Rows that repeat a page_id give a record each; with equal payloads they have the
same type.

Tasks write files under names of their own and report them; only reported files
are read, so a repeated task does no harm.  The folder must be one that pyarrow
can write to (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from terranet.llm.tables import read
from terranet.plans.scratch import cut, scratch_path

CHUNK = 1 << 16
FILE_BYTES = 64 << 20
GROUP_BYTES = 16 << 20
LEAST_REVISIT = 100
# Fixed values of the WARC 1.1 format
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

CHUNKS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
          "chunk_no int, last boolean, chunk binary, digest_so_far string")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (fs.LocalFileSystem(), folder)


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme; one without is where Spark's own tables of that path are."""
    if urlsplit(folder).scheme:
        return folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()


def record_chunks(pages: DataFrame, least: int = LEAST_REVISIT, chunk: int = CHUNK) -> DataFrame:
    """Rows (page_id, url, record_type, refers_to, payload_digest, payload_bytes, chunk_no, chunk) in record order.

    Payloads are joined with their revisits without a shuffle where these are few enough for a broadcast.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"payload_digest": F.sha2("body", 256), "payload_bytes": F.octet_length("body").cast("long")})
    rows = cut(rows, "warc-payloads", "zstd", GROUP_BYTES)
    keys = rows.filter(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    firsts = keys.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"))
    revisits = cut(keys.join(firsts, "payload_digest").filter("page_id > refers_to").distinct(), "warc-revisits")
    rows = rows.join(revisits, ["page_id", "payload_digest"], "left")
    rows = rows.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    parts = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(F.col("payload_bytes") / chunk), F.lit(1))).otherwise(1).cast("int")
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), parts - 1)))
    piece = F.when(F.col("refers_to").isNull(), F.expr(f"substring(body, chunk_no * {chunk} + 1, {chunk})"))
    return rows.select("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "chunk_no", piece.alias("chunk"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    tail = name.strip("<>").rsplit(":", 1)[1]
    return None if tail == "none" else int(tail)


def _head(row: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    lines = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'])}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http;msgtype=response"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {_name(row['refers_to'])}", f"WARC-Profile: {_PROFILE}"]
    length = len(http) + (row["payload_bytes"] if row["record_type"] == "response" else 0)
    return _VERSION + "\r\n".join([*lines, f"Content-Length: {length}"]).encode() + _END + http


def _write(folder: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        task = TaskContext.get()
        out, name, files, size, member = None, "", 0, 0, None
        done: list[tuple[str, int, int]] = []
        records = 0

        def end_record() -> bytes:
            return b"" if member is None else member.compress(_END) + member.flush()

        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                data = b""
                if row["chunk_no"] == 0:
                    data = end_record()
                    if out is not None and size + len(data) >= most:
                        out.write(data)
                        out.close()
                        done.append((name, records, size + len(data)))
                        out, data, size, records = None, b"", 0, 0
                    if out is None:
                        leaf = f"{task.partitionId():06d}-{task.taskAttemptId()}-{files:05d}.warc.gz"
                        name = f"{folder}/{leaf}"
                        files += 1
                        out = store.open_output_stream(f"{root}/{leaf}", compression=None)
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data += member.compress(_head(row))
                    records += 1
                if row["chunk"]:
                    data += member.compress(row["chunk"])
                out.write(data)
                size += len(data)
        if out is not None:
            data = end_record()
            out.write(data)
            out.close()
            done.append((name, records, size + len(data)))
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())],
            ["file", "records", "bytes"])

    return run


def write_archives(chunks: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of ``record_chunks`` as .warc.gz files; returns the written list (file, records, bytes)."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return cut(chunks.mapInArrow(_write(folder, file_bytes), "file string, records long, bytes long"), "warc-files")


class _Stream:
    """Bytes of consecutive gzip members, read in pieces."""

    def __init__(self, source):
        self.source, self.inflate, self.raw, self.ready = source, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(1 << 18)
                if not self.raw:
                    return False
            data = self.inflate.decompress(self.raw, 1 << 18)
            self.raw = self.inflate.unconsumed_tail
            if data:
                self.ready += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and without ``mark``; None at the end of the file."""
        while (at := self.ready.find(mark)) < 0:
            if not self._more():
                return None
        found, self.ready = self.ready[:at], self.ready[at + len(mark):]
        return found

    def take(self, most: int) -> bytes:
        """``most`` bytes, fewer only at the end of the file."""
        while len(self.ready) < most and self._more():
            pass
        found, self.ready = self.ready[:most], self.ready[most:]
        return found


def _records(stream: _Stream, chunk: int) -> Iterator[tuple]:
    while (head := stream.until(_END)) is not None:
        lines = head.decode().lstrip("\r\n").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        url = fields.get("WARC-Target-URI")
        if url is not None:
            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        http = stream.until(_END)
        length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        stored = int(fields["Content-Length"]) - len(http) - len(_END)
        refers = fields.get("WARC-Refers-To")
        common = (_page(fields["WARC-Record-ID"]), url, fields["WARC-Type"], None if refers is None else _page(refers),
                  fields["WARC-Payload-Digest"].split(":")[1], length)
        digest, number, left = hashlib.sha256(), 0, stored
        while True:
            data = stream.take(min(chunk, left))
            left -= len(data)
            digest.update(data)
            if left and not data:
                raise ValueError("the archive ends inside a record")
            yield (*common, number, not left, data, digest.hexdigest())
            number += 1
            if not left:
                break
        stream.take(len(_END))


def _read(chunk: int, with_data: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = _store(name)
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as source:
                    for row in _records(_Stream(source), chunk):
                        rows.append(row if with_data else (*row[:8], None, row[9]))
                        if len(rows) >= (64 if with_data else 4096):
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the listed archives: a row per chunk, an empty payload has one.

    ``digest_so_far`` is the SHA-256 of the stored payload up to the row's end;
    ``chunk`` is null without ``with_data``.
    """
    listed = files.select("file")
    n = listed.count()
    # a task for each file, or for some sixteen of them where there are more than tasks at a time
    tasks = max(1, min(n, max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 16))))
    return listed.repartitionByRange(tasks, "file").mapInArrow(_read(chunk, with_data), CHUNKS)


def archived_pages(pages: DataFrame, least: int = LEAST_REVISIT, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back, one row per record.

    The digest and length of a response come from its stored payload, those of a
    revisit from its header.  Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, folder or scratch_path(spark, "warc"))
    files = write_archives(record_chunks(pages, least), folder)
    rows = read_archives(files, with_data=False).filter("last")
    return rows.select("page_id", "payload_bytes", F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(
        F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(read(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, min(page_id) AS low FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > low THEN low END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""
