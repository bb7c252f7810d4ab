import base64
import gzip
import hashlib
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG
from tidemark.llm import warc
from tidemark.llm.warc import read_warc, write_warc

PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, ""), (4, "http://a/\r\nX: y", None),
    (5, "http://é/5", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", LONG), (2, "again", "<p>one</p>"), (None, "n", "<p>one</p>"),
    (None, "n", "alone"), (None, "m", "alone"), (7, "u7", "x"),
]


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, payload string, id int")


@pytest.mark.parametrize("least, most, size", [(0, 500_000, 1 << 30), (2, 0, 100)])
def test_round_trip(spark, pages, tmp_path, monkeypatch, least, most, size):
    monkeypatch.setattr(warc, "MOST_BROADCAST_PAYLOADS", most)
    manifest = write_warc(pages, str(tmp_path / "w"), least_bytes=least, archive_bytes=size)
    got = read_warc(spark, manifest).collect()
    payloads = {sha1(t): (t or "").encode() for _, _, t in PAGES}
    want = []
    for key, _, text in PAGES:
        same = [k for k, _, t in PAGES if (t or "") == (text or "") and k is not None]
        top = max(same) if same and len((text or "").encode()) >= least else None
        refers = top if top is not None and key != top else None
        want.append((str(key or ""), len((text or "").encode()), sha1(text), "response" if refers is None else "revisit", str(refers or "")))
    name = lambda x: (x or "").removeprefix("urn:record:")
    have = [(name(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, name(r.refers_to)) for r in got]
    assert sorted(have) == sorted(want)
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payloads[r.payload_digest] for r in got)
    for row in manifest.collect():
        with open(row.archive, "rb") as file:
            data = file.read()
        assert len(data) == row.bytes and gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == row.records


def test_no_pages(spark, pages, tmp_path):
    manifest = write_warc(pages.limit(0), str(tmp_path / "w"))
    assert read_warc(spark, manifest).count() == 0


def damaged(spark, tmp_path, data):
    path = str(tmp_path / "x.warc.gz")
    with open(path, "wb") as file:
        file.write(data)
    return read_warc(spark, spark.createDataFrame(pd.DataFrame({"archive": [path]}))).collect()


def test_damage_is_found(spark, tmp_path):
    plain = warc._record("urn:record:1", "u", b"payload", warc._sha1(b"payload"), None, "1970-01-01T00:00:00Z")
    pack = lambda x: gzip.compress(x, mtime=0)
    assert damaged(spark, tmp_path, pack(plain) * 3)[2].payload_bytes == 7
    wrong = plain.replace(b"\r\n\r\npayload", b"\r\n\r\npayl0ad")
    for data in (pack(plain)[:-9], pack(wrong), pack(plain[:-1]), pack(plain + b"more"), pack(b"no headers"), b"plain text"):
        with pytest.raises(Exception, match="WarcError|zlib.error"):
            damaged(spark, tmp_path, data)


def test_members_over_many_reads():
    class Small:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            got, self.data = self.data[:3], self.data[3:]
            return got

    data = b"".join(gzip.compress(x, mtime=0) for x in (b"first" * 100, b"", b"second"))
    found = [(at, b"".join(pieces)) for at, pieces in warc._members(Small(data))]
    assert [x for _, x in found] == [b"first" * 100, b"", b"second"]
    assert [zlib.decompressobj(31).decompress(data[at:]) for at, _ in found] == [x for _, x in found]


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    """Adaptive execution must not gather the archives in one reader."""
    pages = spark.range(80).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat('x', 200) AS html").repartition(8)
    manifest = write_warc(pages, str(tmp_path / "many"))
    assert manifest.count() == 8
    readers = read_warc(spark, manifest).select(F.spark_partition_id().alias("task")).distinct().count()
    assert readers >= min(4, spark.sparkContext.defaultParallelism)
