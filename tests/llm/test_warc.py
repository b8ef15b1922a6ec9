"""The archive against hashlib, and its bytes against the pages."""

import base64
import hashlib

import pytest

from cohortspark.llm import runtime, warc
from cohortspark.llm.runtime import shared_dir
from cohortspark.llm.warc import read_archive, record_bytes, round_trip

PAGES = [
    (1, "http://a/x", "<p>é</p>", 0), (2, "http://a/y", "<p>é</p>", 0), (3, None, None, 1), (4, "http://b", "", 2),
    (5, "http://c", "only", 3), (2, "http://a/y", "<p>é</p>", 0), (None, "http://d", "z" * 100_000, 4),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload int")
    path = shared_dir(spark)
    got = round_trip(pages, path).collect()
    data = lambda h: (h or "").encode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), len(data(h)), base64.b32encode(hashlib.sha1(data(h)).digest()).decode()) for i, _, h, _ in PAGES
    )
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == [
        ("1", "revisit", 2), ("2", "response", None), ("2", "revisit", 2), ("3", "revisit", 4), ("4", "response", None),
        ("5", "response", None), ("None", "response", None),
    ]
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in read_archive(spark, path).collect():
        assert hashlib.sha256(r.payload).hexdigest() == r.payload_sha256
        assert bytes(r.header).startswith(b"WARC/1.1\r\n") and bytes(r.header).endswith(b"\r\n\r\n")


def test_records_as_bytes(spark, monkeypatch):
    """Rebuilt records against the format: lines, lengths, unique ids, references that exist; also with hot payloads."""
    monkeypatch.setattr(runtime, "HOT_ROWS", 2)
    rows = [*PAGES, *((100 + k, f"http://e/{k % 3}", "same", 5) for k in range(9)), (100, "http://e/9", "same", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    path = shared_dir(spark)
    got = round_trip(pages, path).where("page_id >= 100").collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == sorted([(100, "revisit", 108)] + [(100 + k, "revisit", 108) for k in range(8)] + [(108, "response", None)])
    ids, refers = [], []
    for r in record_bytes(read_archive(spark, path)).collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        assert version == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()
        assert body.endswith(b"\r\n\r\n") and len(body) - 4 == int(fields["Content-Length"])
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body[:-4]).digest()).decode()
        else:
            refers.append(fields["WARC-Refers-To"])
        ids.append(fields["WARC-Record-ID"])
    assert len(set(ids)) == len(ids) == len(rows) and set(refers) <= set(ids)


def test_cluster_that_changes(spark, monkeypatch):
    """Files are cut into other tasks from job to job: every record still finds its own payload."""
    rows = [(k, f"http://e/{k}", f"page {k % 20}" * (1 + k % 5), 5) for k in range(200)]
    pages = runtime.save(spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(9))
    jobs = iter(range(10**6))

    def changing(df):
        out = runtime.save(df)
        spark.conf.set("spark.sql.files.openCostInBytes", str((1, 10**9, 2_000)[next(jobs) % 3]))
        return out

    monkeypatch.setattr(warc, "save", changing)
    try:
        got = round_trip(pages, shared_dir(spark)).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    top = {}
    for k, _, h, _ in rows:
        top[h] = max(top.get(h, 0), k)
    assert {(r.page_id, r.payload_digest, r.refers_to) for r in got} == {
        (k, base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), None if top[h] == k else top[h]) for k, _, h, _ in rows
    }


def test_least(spark):
    pages = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string, payload int")
    assert {r.record_type for r in round_trip(pages, shared_dir(spark), least=1000).collect()} == {"response"}


def test_damage(spark):
    pages = spark.createDataFrame(PAGES[:2], "page_id long, url string, html string, payload int")
    path = shared_dir(spark)
    round_trip(pages, path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("payload_sha256", "cast('other' as binary) as payload")
    bad.write.mode("overwrite").parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    with pytest.raises(Exception, match="digest"):
        read_archive(spark, f"{path}-2").collect()
    assert round_trip(pages.limit(0), shared_dir(spark)).count() == 0
