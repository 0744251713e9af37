import base64
import gzip
import hashlib

import pyarrow.fs as fs
from llm_helpers import collected, order, prose
from pyspark.sql import functions as F

from spendlens.llm import warc
from spendlens.llm.common import new_folder
from spendlens.llm.warc import archive_round_trip, read_captures, write_archives

PAGES = (
    [(i, f"http://h{i % 7}.example.org/p{i}", f"<p>{prose(20, i)}</p>") for i in range(40)]
    + [(50, "http://a.org/x", None), (49, "http://b.org/y", ""), (60, None, "<p>no url</p>"), (61, "odd\turl \\ \n ünï", "é日本🙂\r\n\r\n\x00"), (62, "http://b.org/y", "big " * 50_000)]
    + [(70 + i, "https://hot.example/", "<hot>") for i in range(30)]
    + [(69, "https://hot.example/", "<hot>"), (None, "http://n.org/", "<hot>"), (None, "http://m.org/", "<only null ids>"), (None, "http://m.org/", "<only null ids>"), (90, "http://r.org", "<twice>"), (90, "http://r.org", "<twice>")]
)
SCHEMA = "page_id long, url string, html string, digest string, SHARD string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "s") for r in rows], SCHEMA)


def brute(rows, revisit_from=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        f = first.get(h or "")
        again = len(body) >= revisit_from and f is not None and i != f
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", f if again else None))
    return out


def read(df):
    return order(collected(df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")))


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    got = archive_round_trip(table(spark, PAGES))
    # the query asks for distinct captures; repeats come from the index
    assert read(got) == order(brute(PAGES))
    bodies = {(r["page_id"], r["payload"]) for r in got.where("record_type = 'response'").collect()}
    assert (61, "é日本🙂\r\n\r\n\x00".encode()) in {(i, bytes(p)) for i, p in bodies}


def test_small_payloads_are_no_revisits(spark):
    assert read(archive_round_trip(table(spark, PAGES), revisit_from=8)) == order(brute(PAGES, 8))


def test_files_are_gzip_members_and_lookups_hit_or_miss(spark):
    folder = new_folder(spark, "warc-test")
    rows = table(spark, PAGES).select("page_id", "url", "html")
    index = write_archives(rows, folder)
    names = [f.path for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(folder.removeprefix("file:")))]
    text = b"".join(gzip.open(n).read() for n in names if n.endswith(".warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == len(PAGES)
    asked = spark.createDataFrame([(3, "http://h3.example.org/p3"), (4, "http://h3.example.org/p3"), (3, "http://zzz/"), (77, "https://hot.example/")], "page_id long, url string")
    got = {r["page_id"]: r["refers_to"] for r in read_captures(index, asked).collect()}
    assert got == {3: None, 77: 69}


def test_repeated_captures_across_archive_cuts(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    hot = [(None, None, f"<p>{prose(15, i)}</p>") for i in range(40)] + [(7, "http://h3.example.org/p3", f"<i>{prose(9, 60 + i)}</i>") for i in range(25)]
    rows = PAGES + hot + [(5, "http://n.org/", "x"), (5, "http://n.org/", "x")] * 8
    assert read(archive_round_trip(table(spark, rows))) == order(brute(rows))
    # big ids beside nulls are kept apart
    rows = [(i, "http://a.org/", f"<p>{i}</p>") for i in ((1 << 60) + 1, (1 << 60) + 2, None)] * 3
    assert read(archive_round_trip(table(spark, rows))) == order(brute(rows))


def test_a_hot_key_is_written_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = table(spark, [(None, None, f"<p>{i}</p>") for i in range(400)]).select("page_id", "url", "html")
        tasks = warc.in_key_order(warc.with_roles(rows)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 300


def test_empty_table(spark):
    assert collected(archive_round_trip(table(spark, []))) == []
