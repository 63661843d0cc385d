"""A content-addressed archive of WARC records: payloads once by strong digest, exact headers apart, records by joins.

An archive is a folder of two Parquet tables. ``payloads`` (sha256, payload) has each payload once; ``headers`` (record_id, header, sha256,
inline) has for every record its exact bytes before the payload and the payload's key; ``inline`` tells whether the
payload is part of the record, as it is in a response, or only referred to, as in a revisit.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm._shared import checkpoint_root, cut, table

MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
# The digits of Spark's and DuckDB's radix 32, and those of base32.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, header binary, payload binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 20 bits, four digits, at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def record_name(*parts: Column) -> Column:
    """A record id that depends on the values given."""
    h = F.sha2(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none for null. Control characters are percent-encoded, as they would end or break the line."""
    shown = value.cast("string")
    for code in (*range(32), 127):
        shown = F.replace(shown, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    safe = F.when(value.cast("string").rlike("[\\x00-\\x1F\\x7F]"), shown).otherwise(value.cast("string"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _header(kind: Column, page_id: Column, url: Column, record_id: Column, refers: Column, digest: Column, size: Column, date: str) -> Column:
    """The bytes of a record before its payload: its own header and the HTTP response's."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    length = F.octet_length(http) + F.when(kind == "response", size).otherwise(0)
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), _line("WARC-Refers-To", refers), _line("WARC-Profile", F.when(kind == "revisit", PROFILE)),
        _line("X-Page-ID", page_id), _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", length), F.lit("\r\n"), http,
    ).cast("binary")


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write one record for each row of ``pages`` to an archive at ``path``.

    Of rows with equal payloads of at least ``min_bytes`` the one with the largest id is the response and the others revisit it; of rows that
    repeat that id, one. Null ids are the smallest. Smaller payloads are all responses, but stored once as well. A null html is an empty
    payload, a null url or id leaves its line out; an empty table gives an empty archive; other columns are not read.

    Payloads are moved once, after each task has dropped its own repeats; who is the response is found on rows without them.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    keyed = rows.withColumn("sha256", F.sha2("payload", 256))
    slim = cut(
        keyed.select("page_id", "url", "sha256", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    firsts = slim.where(F.col("size") >= min_bytes).groupBy("sha256").agg(F.max(F.struct("page_id", "row")).alias("first"))
    known = slim.join(firsts, "sha256", "left")
    revisit = F.col("first").isNotNull() & (F.col("row") != F.col("first.row"))
    name, refers = record_name(F.col("page_id"), F.col("row")), F.when(revisit, record_name(F.col("first.page_id"), F.col("first.row")))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = _header(kind, F.col("page_id"), F.col("url"), name, refers, F.col("digest"), F.col("size"), date)
    known.select(name.alias("record_id"), header.alias("header"), "sha256", (~F.coalesce(revisit, F.lit(False))).alias("inline")).write.parquet(f"{path}/headers")
    _store(keyed.select("sha256", "payload"), path)


def archive_records(records: DataFrame, path: str) -> None:
    """Write records (record_id, header, payload), as ``parse`` gives them, to an archive; a null payload is none."""
    keyed = records.withColumn("sha256", F.sha2("payload", 256))
    keyed.select("record_id", "header", "sha256", F.col("payload").isNotNull().alias("inline")).write.parquet(f"{path}/headers")
    _store(keyed.where("payload is not null").select("sha256", "payload"), path)


def _store(payloads: DataFrame, path: str) -> None:
    """Each payload once."""
    payloads.groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; one that is not what its key says fails the query."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary")
    return stored.select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(wrong).alias("payload"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("record_id string, header binary, sha256 string, inline boolean").parquet(f"{path}/headers")


def named(header: Column, name: str) -> Column:
    """The value of a named field of a record's own header; null if it has none. Names are told apart without their case."""
    own = F.concat(F.substring_index(header.cast("string"), END, 1), F.lit("\r\n"))
    return F.nullif(F.regexp_extract(own, f"(?i)\r\n{name}:[ \\t]*([^\r\n]*)\r\n", 1), F.lit(""))


def index(spark: SparkSession, path: str) -> DataFrame:
    """What an archive holds, a row for each record: ``page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url``.

    Size and digest are those of the stored payload, found through the record's key; a record whose header states another digest fails the
    query. ``refers_to`` is the page_id of the record that a revisit names.
    """
    h = headers(spark, path).select(
        "record_id", "sha256", named(F.col("header"), "WARC-Type").alias("record_type"), named(F.col("header"), "X-Page-ID").cast("long").alias("page_id"),
        named(F.col("header"), "WARC-Refers-To").alias("refers"), named(F.col("header"), "WARC-Payload-Digest").alias("stated"),
        named(F.col("header"), "WARC-Target-URI").alias("url"),
    )
    h = cut(h)
    sizes = cut(payloads(spark, path).select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")))
    told = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    wrong = F.raise_error(F.concat(F.lit("another payload than stated: "), F.col("record_id"))).cast("string")
    checked = F.when((F.col("stated") == told) | F.col("stated").isNull() | F.col("payload_digest").isNull(), F.col("payload_digest")).otherwise(wrong)
    named_by = h.where("refers is not null").select(F.col("refers").alias("record_id")).distinct()
    targets = h.join(named_by, "record_id", "left_semi").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    return (
        h.join(sizes, "sha256", "left")
        .join(targets, "refers", "left")
        .select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", "record_id", "url")
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: ``record_id`` and ``record``, the exact bytes of header and payload, without the line ends after them."""
    rows = headers(spark, path).withColumn("key", F.when(F.col("inline"), F.col("sha256"))).join(
        payloads(spark, path).withColumnRenamed("sha256", "key"), "key", "left"
    )
    missing = F.raise_error(F.concat(F.lit("no payload for "), F.col("record_id"))).cast("binary")
    body = F.when(~F.col("inline"), F.lit(b"")).when(F.col("payload").isNotNull(), F.col("payload")).otherwise(missing)
    return rows.select("record_id", F.concat("header", body).alias("record"))


def export(found: DataFrame, path: str, compression: str = "none") -> None:
    """Write records as WARC files, each record with its two line ends; ``gzip`` packs whole files."""
    # The text writer puts the bytes of a string out as they are, whether they are UTF-8 or not.
    found.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def walk(data: bytes) -> Iterator[tuple[str | None, bytes, bytes | None]]:
    """(record id, bytes before the payload, payload) of each record of a WARC file.

    A record ends where its Content-Length says. The payload of a response is what follows the HTTP header, that of a
    resource its whole block; other records have none and keep their block in the header.
    """
    end, at = END.encode(), 0
    while (start := data.find(b"WARC/", at)) >= 0:
        body = data.index(end, start) + len(end)
        own = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in data[start:body].split(b"\r\n")[1:])}
        at = body + int(own.get(b"content-length", b"0"))
        kind, split = own.get(b"warc-type"), at
        if kind == b"resource":
            split = body
        elif kind == b"response":
            http = data.find(end, body, at)
            split = http + len(end) if http >= 0 else at
        name = own.get(b"warc-record-id")
        yield name and name.decode("utf-8", "replace"), data[start:split], data[split:at] if kind in (b"response", b"resource") else None


def parse(spark: SparkSession, path: str) -> DataFrame:
    """Records (record_id, header, payload) of WARC files, packed or not. A file is one row of Spark's reader, so under 2 GB."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("header", pa.binary()), ("payload", pa.binary())])
        for batch in it:
            for data in batch.column(0):
                raw = data.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for row in walk(raw):
                    rows.append(row)
                    size += len(row[1]) + len(row[2] or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, RECORD)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    archive_pages(table(spark, sf_dir, "pages"), path)
    return index(spark, path).drop("record_id", "url")


_B32 = f"translate(array_to_string(list_transform(range(8), lambda i: to_base(('0x' || substr(sha1(body), 5 * i + 1, 5))::BIGINT, 32, 4)), ''), '{DIGITS}', '{BASE32}')"
ORACLE_SQL = f"""SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> most THEN most END AS refers_to
FROM (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS most FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))"""
