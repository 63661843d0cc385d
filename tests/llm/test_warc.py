"""The archive held against a plain reading of its records, files written and read again, and its SQL."""

import base64
import gzip
import hashlib
from pathlib import Path

import duckdb
import pytest
from pyspark.errors import PySparkException

from prosemill.llm import warc as W

PAGES = "page_id long, url string, html string, sha256 string, payload string, size int, row long, first string"
ROWS = [
    (1, "http://a.example/", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"), (9, "http://c.example/é", "<p>same</p>"), (3, None, "<p>öther 日本</p>"), (4, "http://d/\r\nX: y", ""),
    (5, "u", None), (None, "u", "<p>same</p>"), (None, None, None), (6, "u", "long " * 40000), (7, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (8, "u", "\r\n\r\n"), (9, "again", "<p>same</p>"),
    (6, "u", "long " * 40000), *[(100 + i, "hot", "<hot>") for i in range(30)],
]


def frame(spark):
    return spark.createDataFrame([(*r, "s", "p", 1, 2, "f") for r in ROWS], PAGES).repartition(4)


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least):
    largest = {}
    for i, _, html in rows:
        body = html or ""
        largest[body] = max(largest.get(body, -1), -1 if i is None else i)
    out, taken = [], set()
    for i, _, html in rows:
        body = html or ""
        small = len(body.encode()) < least
        answer = small or ((-1 if i is None else i) == largest[body] and body not in taken)
        if answer and not small:
            taken.add(body)
        target = None if answer or largest[body] < 0 else largest[body]
        out.append((i, len(body.encode()), b32(html), "response" if answer else "revisit", target))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6])
def test_index_and_records(spark, tmp_path, least):
    path = f"file://{tmp_path}/a"
    W.archive_pages(frame(spark), path, min_bytes=least)
    got = W.index(spark, path)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(ROWS, least)
    assert W.payloads(spark, path).count() == len({h or "" for _, _, h in ROWS})
    urls = {r["page_id"]: r["url"] for r in got.collect()}
    assert urls[4] == "http://d/%0D%0AX: y" and urls[3] is None
    whole = {r["record_id"]: bytes(r["record"]) for r in W.records(spark, path).collect()}
    assert len(whole) == len(ROWS)
    for name, data in whole.items():
        ((read, before, payload),) = W.walk(data)
        assert read == name and before + (payload or b"") == data
        fields = dict(line.split(": ", 1) for line in data.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(data) - len(data.split(b"\r\n\r\n")[0]) - 4
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            assert b"WARC-Type: response" in whole[fields["WARC-Refers-To"]]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_and_back(spark, tmp_path, compression):
    first, second, files = (f"file://{tmp_path}/{x}" for x in "abf")
    W.archive_pages(frame(spark), first)
    W.export(W.records(spark, first), files, compression)
    W.archive_records(W.parse(spark, files), second)

    def whole(path):
        return sorted((r["record_id"], bytes(r["record"])) for r in W.records(spark, path).collect())

    assert whole(first) == whole(second)
    written = [p.read_bytes() for p in Path(tmp_path, "f").glob("part-*")]
    data = b"".join(gzip.decompress(x) if compression == "gzip" else x for x in written)
    assert sum(1 for _ in W.walk(data)) == len(ROWS)


def test_foreign_records(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe\x00raw"
    made = b"".join(
        b"WARC/1.0\r\nwarc-type: %s\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, i, len(block), block)
        for i, (kind, block) in enumerate([(b"warcinfo", b"software: x"), (b"response", body), (b"resource", b"\xff\xfe\x00raw"), (b"request", b"GET / HTTP/1.1\r\n\r\n"), (b"response", b"no header")])
    )
    Path(tmp_path, "x.warc").write_bytes(made)
    path = f"file://{tmp_path}/a"
    W.archive_records(W.parse(spark, f"file://{tmp_path}/x.warc"), path)
    rows = sorted((r["record_id"], bytes(r["record"])) for r in W.records(spark, path).collect())
    assert b"".join(x + b"\r\n\r\n" for _, x in rows) == made
    assert {bytes(r["payload"]) for r in W.payloads(spark, path).collect()} == {b"\xff\xfe\x00raw", b""}


def test_damage_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    W.archive_pages(frame(spark), path)
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "sha256 string, payload binary").write.mode("append").parquet(f"{path}/payloads")
    with pytest.raises(PySparkException, match="damaged"):
        W.index(spark, path).collect()


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    W.archive_pages(spark.createDataFrame([], PAGES), path)
    assert W.index(spark, path).collect() == [] == W.records(spark, path).collect()


def test_equal_to_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    got = W.op11_warc(spark, sf_dir)
    want = con.sql(W.ORACLE_SQL).select(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
