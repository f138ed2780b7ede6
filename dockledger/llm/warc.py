"""WARC archives: writing captures, reading them back, and assembling their records into one row a capture.

A capture is a request, a response (or a revisit of an earlier response with the same payload) and a metadata record.
Requests and metadata name their response in WARC-Concurrent-To. Every record is a gzip member of its own, so a reader can
begin at any of them. Spark's text sink writes the files, so they go to any file system Spark knows, and a task that is run
again leaves no half file; a member's last byte, zero, is the sink's line end. Files are cut by their bytes.

Read are plain and compressed archives with any number of records a member, names of fields in any case with any blanks
around their values, continued lines, and several WARC-Concurrent-To of one record. A record that does not end where its
length says, or lacks its type, identifier or length, raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.common import stored

VERSION = "WARC/1.1"
#: Bytes of a file after which the next one begins.
FILE_BYTES = 32 << 20
#: The date of records; the pages do not carry one.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload) -> F.Column:
    """SHA-1 in upper-case base32: four times ten hex digits, each 40 bits or eight digits of base 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*parts) -> F.Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(fields: list[tuple], body) -> F.Column:
    """A record as text; fields that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines, length), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def captures_of(pages: DataFrame) -> DataFrame:
    """One row a page: row, page_id, uri, payload, digest, size and the first page with an equal payload.

    A null html is an empty payload. Of the pages with equal payloads the one with the smallest page_id is first (null
    last); of repeated rows an arbitrary but fixed one: pages are read twice and must come in the same order again, as those
    of a table do. Control characters and spaces of a url are written as %20.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("urn:x-none")), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col("page_id"), uri.alias("uri"), payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("same"),
    )
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("row")))
    firsts = rows.groupBy("same").agg(first.alias("first"))
    return rows.join(firsts, "same").select(
        "row", "page_id", "uri", "payload", "first", base32_sha1(F.col("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("size"),
    )


def write_archive(pages: DataFrame, path: str) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row of pages (page_id, url, html)."""
    captures = captures_of(pages)
    text = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("page_id", "row")}
    own = _uuid(F.lit("response"), text["page_id"], text["row"])
    first_id = F.coalesce(F.col("first.page_id").cast("string"), F.lit(""))
    original = _uuid(F.lit("response"), first_id, F.col("first.row").cast("string"))
    is_first = F.col("row") == F.col("first.row")
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("uri"))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size"))
    head = F.concat(head, F.lit("\r\n\r\n"))
    response = _record(
        [("WARC-Type", F.lit("response")), ("WARC-Record-ID", own), *common, digest, http],
        F.concat(head, F.col("payload")),
    )
    revisit = _record(
        [("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", own), *common, digest, ("WARC-Refers-To", original),
         ("WARC-Profile", F.lit(PROFILE)), http],
        head,
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid(F.lit("request"), text["page_id"], text["row"])),
         ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    known = F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n"))
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid(F.lit("metadata"), text["page_id"], text["row"])),
         ("WARC-Concurrent-To", own), *common, ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(known, F.lit("")),
    )
    records = captures.select(F.explode(F.array(request, F.when(is_first, response).otherwise(revisit), metadata)).alias("record"))
    members = records.mapInArrow(_members, "member binary, file int")
    # bytes pass a string column as they are
    members = members.select(F.col("member").cast("string").alias("value"), "file")
    members.write.partitionBy("file").option("lineSep", "\x00").text(path)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member less its last byte, with the number of the task's file it goes to."""
    file, size, held, out, files = 0, 0, 0, [], []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files, pa.int32())], ["member", "file"])

    for batch in batches:
        for record in batch.column(0):
            member = gzip.compress(record.as_py().encode(), 6, mtime=0)
            if member[-1]:  # of a record of 16 MB or more: an empty member ends with zero
                member += gzip.compress(b"", mtime=0)
            file, size = (file + 1, 0) if size >= FILE_BYTES else (file, size)
            size, held = size + len(member), held + len(member)
            out.append(member[:-1])
            files.append(file)
            if held > 1 << 21 or len(out) >= 2000:
                yield done()
                held, out, files = 0, [], []
    if out:
        yield done()


RECORD = {
    "record_id": pa.string(), "record_type": pa.string(), "concurrent_to": pa.list_(pa.string()), "refers_to": pa.string(),
    "uri": pa.string(), "date": pa.string(), "stated_digest": pa.string(), "page_id": pa.int64(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(),
}


def unpacked(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a plain archive, or of all members of a compressed one, piece by piece."""
    view = memoryview(data)
    if view[:2] != b"\x1f\x8b":
        yield from (bytes(view[i : i + step]) for i in range(0, len(view), step))
        return
    at, left, member = 0, b"", None
    while left or at < len(view):
        if not left:
            left, at = bytes(view[at : at + step]), at + step
        member = member or zlib.decompressobj(31)
        yield member.decompress(left)
        left = member.unused_data
        if member.eof:
            member = None
    if member:
        raise ValueError("the archive ends inside a member")


def fields_of(lines: list[str]) -> dict[str, list[str]]:
    """Values of named fields by name in lower case, in order; a line that begins with a blank continues the one before."""
    out: dict[str, list[str]] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name][-1] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out.setdefault(name, []).append(value.strip())
    return out


def parse(pieces: bytes | Iterable[bytes], with_payload: bool) -> Iterator[tuple]:
    """The records of an archive, found by their stated lengths alone, so payloads may hold anything."""
    pieces = iter([pieces] if isinstance(pieces, bytes) else pieces)
    data, at = bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        data.extend(piece or b"")
        return piece is not None

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if data:
                    raise ValueError(f"no record at byte {at}")
                return
        lines = data[:end].decode("utf-8").split("\r\n")
        fields = fields_of(lines[1:])
        one = lambda name: fields.get(name, [None])[0]
        if not lines[0].startswith("WARC/") or None in map(one, ("warc-type", "warc-record-id", "content-length")):
            raise ValueError(f"no record at byte {at}")
        stop = end + 4 + int(one("content-length"))
        while len(data) < stop + 4 and more():
            pass
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end after its {stop - end - 4} bytes")
        block = bytes(data[end + 4 : stop])
        del data[: stop + 4]
        at += stop + 4
        kind, payload, page = one("warc-type"), None, None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
        elif kind == "metadata":
            named = fields_of(block.decode("utf-8", "replace").split("\r\n")).get("page-id", [""])[0]
            page = int(named) if named.removeprefix("-").isdecimal() else None
        yield (
            one("warc-record-id"), kind, fields.get("warc-concurrent-to", []), one("warc-refers-to"),
            one("warc-target-uri"), one("warc-date"), (one("warc-payload-digest") or "").removeprefix("sha1:") or None, page,
            None if payload is None else len(payload),
            None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            *([payload] if with_payload else []),
        )


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record; of responses also size and digest as found in the archive, and the payload if asked for."""
    kinds = RECORD | ({"payload": pa.binary()} if with_payload else {})
    types = {pa.string(): T.StringType(), pa.int64(): T.LongType(), pa.binary(): T.BinaryType(), pa.list_(pa.string()): T.ArrayType(T.StringType())}
    schema = T.StructType([T.StructField(n, types[k]) for n, k in kinds.items()])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse(unpacked(content.as_py()), with_payload):
                    rows.append(row)
                    held += (row[8] or 0) if with_payload else 0
                    if len(rows) >= 10_000 or held > 1 << 24:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, kinds)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(apply, schema)


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: response (or revisit), request and metadata, joined by the identifiers they name.

    One pass over the records: each is grouped by the record it is concurrent to, or by itself; one that names several is
    in the capture of each. A capture has one row however many records it has: of several of a kind the one with the
    smallest identifier is shown, `n_request` and `n_metadata` tell their number, and `n_response` of repeated responses.
    Records whose response is not there keep their row, with a null response; other kinds of records have none.
    """
    kind = F.col("record_type")
    main = kind.isin("response", "revisit")
    parts = records.filter(main | kind.isin("request", "metadata"))
    own = F.when(main | (F.size("concurrent_to") == 0), F.array("record_id")).otherwise(F.array_distinct("concurrent_to"))
    parts = parts.select(F.explode(own).alias("_capture"), F.struct(*records.columns).alias("_record"))
    kind = F.col("_record.record_type")
    found = {"response": kind.isin("response", "revisit"), "request": kind == "request", "metadata": kind == "metadata"}
    grouped = parts.groupBy("_capture").agg(
        *[F.min(F.when(own, F.col("_record"))).alias(name) for name, own in found.items()],
        *[F.count_if(own).alias(f"n_{name}") for name, own in found.items()],
    )
    return grouped.withColumnRenamed("_capture", "record_id")


def resolved(captures: DataFrame) -> DataFrame:
    """One row a capture with the size and digest of the full payload; of revisits, those of what they refer to.

    Captures without a response have no payload and no row.
    """
    flat = stored(
        captures.filter(F.col("response").isNotNull()).select(
            "record_id", "response.record_type", "response.refers_to", "response.payload_bytes",
            "response.payload_digest", "response.stated_digest", "metadata.page_id", "response.uri",
            F.col("request").isNotNull().alias("has_request"),
        ),
        "transactions",
    )
    first = flat.filter(F.col("record_type") == "response")
    known = first.select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"),
        F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest"),
    )
    again = flat.filter(F.col("record_type") != "response").drop("payload_bytes", "payload_digest")
    again = again.join(known, "refers_to", "left")

    def row(size, digest, to) -> list:
        return ["page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", to.alias("refers_to"),
                "uri", "has_request", (F.col("stated_digest") == digest).alias("digest_agrees")]

    own = first.select(*row(F.col("payload_bytes"), F.col("payload_digest"), F.lit(None).cast("long")))
    return own.unionByName(again.select(*row(F.col("first_bytes"), F.col("first_digest"), F.col("first_page"))))


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (5 * (7 - j))) & 31 AS INTEGER) + 1, 1)"
ORACLE_SQL = rf"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
    regexp_replace(coalesce(url, 'urn:x-none'), '[\x00-\x20\x7F]', '%20', 'g') AS uri
  FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM payloads
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: list_transform(
    [struct_pack(v := CAST('0x' || substr(hex, CAST(k // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT), j := CAST(k % 8 AS INTEGER))],
    lambda x: {_DIGIT.replace("(v ", "(x.v ").replace(" j)", " x.j)")})[1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, uri, true AS has_request, true AS digest_agrees
FROM firsts
"""
