import gzip
import hashlib
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from terranet.llm import warc as W
from terranet.plans.scratch import scratch_path

SCHEMA = "page_id long, url string, html string, chunk string, payload_bytes int, refers_to string"


def pages(spark):
    long = "<p>" + "é long " * 60_000 + "</p>"
    small = "x" * 99
    found = [(5, "http://a/\r\n%", long), (3, None, long), (9, "http://b", long), (1, "http://c", small), (2, "http://c", small), (4, "u", None),
             (6, "u", ""), (7, "u", "y" * 100), (8, "u", "y" * 100), (7, "u", "y" * 100), (None, "u", "y" * 100), (10, "u", "end\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame([(*r, "c", 1, "r") for r in found], SCHEMA), found


def test_round_trip_and_revisits(spark):
    frame, found = pages(spark)
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.archived_pages(frame).collect())
    first = {}
    for page, _, html in found:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page), page)
    want = []
    for page, _, html in found:
        body = (html or "").encode()
        refers = first.get(html) if page is not None and first.get(html, page) != page else None
        want.append((str(page), len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want)


def test_chunks_carry_running_digests_and_files_are_gzip(spark):
    frame, found = pages(spark)
    folder = scratch_path(spark, "warc-test")
    files = W.write_archives(W.record_chunks(frame, chunk=1000), folder, file_bytes=2000)
    names = [r["file"] for r in files.collect()]
    assert sum(r["records"] for r in files.collect()) == len(found) and len(names) > 1
    assert all(gzip.open(n).read(8) == b"WARC/1.1" for n in names if os.path.getsize(n))
    chunks = W.read_archives(files, chunk=700).filter("page_id = 3").orderBy("chunk_no").collect()
    body = found[1][2].encode()
    assert b"".join(r["chunk"] for r in chunks) == body
    for k, r in enumerate(chunks):
        assert r["digest_so_far"] == hashlib.sha256(body[:700 * (k + 1)]).hexdigest()
        assert len(r["chunk"]) <= 700 and r["last"] == (k == len(chunks) - 1)
    urls = {r["page_id"]: r["url"] for r in W.read_archives(files).collect()}
    assert urls[5] == "http://a/\r\n%" and urls[3] is None


def test_no_pages(spark):
    assert W.archived_pages(pages(spark)[0].limit(0)).count() == 0


def test_large_row_groups_are_read_once_and_apart_from_shuffles(spark, tmp_path):
    rng = random.Random(1)
    html = [rng.randbytes(20_000).hex() for _ in range(1000)]
    html[500:] = html[:500]
    pq.write_table(pa.table({"page_id": range(1000), "url": ["u"] * 1000, "html": html}), tmp_path / "pages.parquet", row_group_size=1000)
    chunks = W.record_chunks(spark.read.parquet(str(tmp_path / "pages.parquet")))
    read = chunks.inputFiles()
    assert not any(str(tmp_path) in f for f in read)
    sizes = []
    for f in (f for f in read if "warc-payloads" in f):
        found = pq.ParquetFile(f.removeprefix("file://")).metadata
        groups = [found.row_group(i) for i in range(found.num_row_groups)]
        sizes += [sum(g.column(k).total_compressed_size for k in range(g.num_columns)) for g in groups]
    assert len(sizes) > 1 and max(sizes) <= 1.2 * W.GROUP_BYTES
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in chunks.select("page_id", "record_type", "refers_to").collect()}
    assert got == {(k, "response", None) for k in range(500)} | {(k, "revisit", k - 500) for k in range(500, 1000)}


def test_payloads_move_only_if_revisits_are_many(spark):
    frame, _ = pages(spark)
    want = sorted(map(tuple, W.record_chunks(frame).collect()), key=str)
    assert "SortMergeJoin" not in W.record_chunks(frame)._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, W.record_chunks(frame).collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_folders_without_a_scheme_are_those_of_spark(spark, tmp_path):
    assert W._qualified(spark, f"{tmp_path}/a b") == f"file://{tmp_path}/a%20b" and W._qualified(spark, "hdfs://h/a") == "hdfs://h/a"
    frame, found = pages(spark)
    assert W.archived_pages(frame, folder=f"{tmp_path}/a b").count() == len(found)
    files = W.write_archives(W.record_chunks(frame), f"file:{tmp_path}/c%20d")
    assert all(r["file"].startswith(f"file:{tmp_path}/c%20d/") for r in files.collect()) and W.read_archives(files).filter("last").count() == len(found)
