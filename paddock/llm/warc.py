"""WARC archives with revisits resolved by payload digest.

Only headers are shuffled by digest; they choose, for each payload, the record that stays a response.  Records
are strings that Spark's own text writer ends with the blank lines that end a WARC record, so archives are
committed like any other Spark output and a lost executor leaves no half-written file.  A task cuts its records into
files by their running size, so a file holds at most ``FILE_BYTES`` and one record more.  Reading parses whole
files by their Content-Length, members of gzip archives one after the other.  Payloads are bytes, whatever their encoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm.common import join_small, written

FILE_BYTES = 16_000_000  #: the size at which a file of an archive ends
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes, or of bytes: five hexadecimal digits make four characters."""
    digits = F.sha1(text)
    out = []
    for k in range(8):
        number = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(number, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)]
    return F.concat(*out)


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit("record"), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``digest``, ``payload_bytes``, ``record_type`` and ``refers_to`` to (page_id, url, html[, record_id, http]), where
    html is text or bytes.

    Of the records with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id (then record_id)
    is the response (all of them, if rows repeat it) and the others revisit it; records without either are responses,
    unless one with such a name has their payload.  ``refers_record`` names the response where it is one record.
    """
    payload = F.coalesce("html", F.lit("").cast(pages.schema["html"].dataType))
    http = F.col("http") if "http" in pages.columns else F.lit(None).cast("binary")
    name = F.col("record_id") if "record_id" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", "url", payload.alias("html"), http.alias("http"), name.alias("record_id"), base32_sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    headers = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "page_id", "record_id").agg(F.count(F.lit(1)).alias("n"))
    headers = headers.groupBy("digest").agg(F.max(F.struct("page_id", "record_id", "n")).alias("o"), F.sum("n").alias("all"))
    shared = written(headers.where(F.col("all") > 1).select("digest", F.col("o.page_id").alias("_page"), F.col("o.record_id").alias("_record"), F.col("o.n").alias("_n")), "warc-shared")
    typed = join_small(rows, shared, ["digest"], how="left")
    known = (F.col("payload_bytes") >= least_bytes) & (F.col("_page").isNotNull() | F.col("_record").isNotNull())
    first = F.col("page_id").eqNullSafe(F.col("_page")) & F.col("record_id").eqNullSafe(F.col("_record"))
    response_id = F.when(known & (F.col("_n") == 1), _record_id(F.col("_page"), F.col("_record"), F.col("digest")))
    revisits = F.coalesce(known & ~first, F.lit(False))
    typed = typed.withColumn("record_type", F.when(revisits, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisits, F.col("_page")))
    return typed.withColumn("refers_record", response_id).drop("_page", "_record", "_n", "record_id")


def records(rows: DataFrame, date: str | None = None) -> DataFrame:
    """(record): a WARC record for each row of :func:`resolved`, with fresh headers, without its closing blank lines.

    ``date`` (UTC, the time of writing if none is given) is every record's; record ids are unique.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    response = F.col("record_type") == "response"
    own = F.when(response, F.col("refers_record"))  # the name by which revisits refer to it
    unique = _record_id(F.col("page_id"), F.col("digest"), F.col("url"), F.monotonically_increasing_id())
    now = F.lit(date) if date else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    # a record that was read keeps its own HTTP header; bytes pass through strings unchanged
    http = F.coalesce(F.col("http").cast("string"), http)
    body = F.concat(http, F.when(response, F.col("html").cast("string")).otherwise(""))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.col("record_type"),
        F.lit("\r\n"),
        line("WARC-Record-ID", F.coalesce(own, unique)),
        line("WARC-Date", now),
        line("WARC-Target-URI", uri),
        line("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, "").otherwise(F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\n"), line("WARC-Refers-To", F.col("refers_record")))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    )
    return rows.select(F.concat(head, body).alias("record"))


def _numbered(file_bytes: int):
    """Adds to each record the number of its file in its task: a new one where the last is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = size = 0
        for batch in batches:
            numbers = []
            for n in pc.binary_length(batch.column(0)).to_pylist():
                if size and size + n > file_bytes:
                    number, size = number + 1, 0
                size += n + len(END)
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32())], ["record", "file"])

    return run


def _write(made: DataFrame, path: str, file_bytes: int, mode: str = "error") -> None:
    made.mapInArrow(_numbered(file_bytes), "record string, file int").write.mode(mode).option("lineSep", END).partitionBy("file").text(path)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for every row of (page_id, url, html[, record_id]), which may be null, as deduplicated archives."""
    _write(records(resolved(pages, least_bytes)), path, file_bytes)


READ = "page_id long, url string, record_type string, record_id string, refers_to_id string, digest string, told string, payload_bytes long, payload binary, http binary, raw binary"
CHUNK = 1 << 16


def members(data: bytes) -> Iterator[bytes]:
    """The members of a gzip archive, unpacked one at a time; other data as they are.  Raises where a member is cut off."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        made, parts = zlib.decompressobj(31), []
        while not made.eof:
            part = view[at : at + CHUNK]
            if not part:
                raise ValueError("the last member of a gzip archive is cut off")
            parts.append(made.decompress(part))
            at += len(part) - len(made.unused_data)
        yield b"".join(parts)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields (names in lower case), content, and both as they stand of each record of an archive; raises where it
    isn't one."""
    for part in members(data):
        at, view = 0, memoryview(part)
        while at < len(part):
            end = part.index(b"\r\n\r\n", at)
            version, *lines = part[at:end].decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
            first = end + 4
            last = first + int(fields["content-length"])
            if part[last : last + 4] != b"\r\n\r\n":
                raise ValueError(f"the record at byte {at} has no end at byte {last}")
            yield fields, bytes(view[first:last]), bytes(view[at:last])
            at = last + 4


def _digest(told: str | None) -> tuple[str | None, str | None]:
    """(SHA-1 in upper-case base32, any other digest as it stands) of what a record says of its payload."""
    name, _, value = (told or "").partition(":")
    if name.lower() == "sha1" and re.fullmatch("[A-Za-z2-7]{32}", value):
        return value.upper(), None
    if name.lower() == "sha1" and re.fullmatch("[0-9A-Fa-f]{40}", value):
        return base64.b32encode(bytes.fromhex(value)).decode(), None
    return None, told or None


def _read(keep_payload: bool, strict: bool):
    def rows_of(data: bytes):
        for fields, content, record in parsed(data):
            kind, payload, http = fields.get("warc-type"), None, None
            digest, told = _digest(fields.get("warc-payload-digest"))
            if kind == "response":
                http, blank, payload = content.partition(b"\r\n\r\n")
                http, said = http + blank, digest
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if strict and said not in (None, digest):
                    raise ValueError(f"payload of {fields.get('warc-record-id')} has another digest")
            page = fields.get("warc-page-id", "")
            whole = keep_payload and payload is not None
            named = int(page) if re.fullmatch(r"-?\d{1,18}", page) else None
            yield named, fields.get("warc-target-uri"), kind, fields.get("warc-record-id"), fields.get("warc-refers-to"), digest, told, None if payload is None else len(payload), payload if whole else None, http if whole else None, record if keep_payload and payload is None else None

    kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.binary()] * 3]
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for row in rows_of(data.as_py()):
                    held.append(row)
                    size += sum(len(x) for x in row[8:] if x) + 100
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False, strict: bool = True) -> DataFrame:
    """Records of archives, plain or gzip: (page_id, url, record_type, record_id, refers_to_id, digest, told, payload_bytes,
    payload, http, raw, html).

    ``digest`` is the SHA-1 of a response's payload (if ``strict``, one that the record itself gives otherwise raises), and
    of a revisit the SHA-1 that it gives; ``told`` is a digest of another kind, as it stands.  The bytes of responses'
    payloads, their HTTP headers, and the other records as they stand (``raw``) are null without ``keep_payload``;
    ``html`` is a payload that is UTF-8, as a string.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    read = files.mapInArrow(_read(keep_payload, strict), READ)
    return read.withColumn("html", F.when(F.is_valid_utf8("payload"), F.col("payload").cast("string")))


def resolve(read: DataFrame) -> DataFrame:
    """Joins revisits to the response of their digest: (page_id, url, digest, record_type, refers_to, payload_bytes, html,
    record_id, payload, http).

    A revisit names its payload by SHA-1 or by the other digest that a response has told of itself.  One whose response is
    in none of the archives keeps null there; records of other types are left out.
    """
    responses = read.where("record_type = 'response'")
    names = responses.select("page_id", "record_id", "payload_bytes", F.col("digest").alias("_sha1"), F.explode(F.array_compact(F.array("digest", "told"))).alias("_name"))
    originals = names.groupBy("_name").agg(F.max(F.struct("page_id", "record_id", "payload_bytes", "_sha1")).alias("o"))
    originals = written(originals.select("_name", F.col("o.page_id").alias("refers_to"), F.col("o.record_id").alias("_record"), "o.payload_bytes", F.col("o._sha1").alias("_sha1")), "warc-originals")
    revisits = read.where("record_type = 'revisit'").select("page_id", "url", "record_type", "record_id", "digest", F.coalesce("digest", "told").alias("_name"))
    revisits = join_small(revisits, originals, ["_name"], how="left").withColumn("digest", F.coalesce("_sha1", "digest"))
    # payloads travel to the revisits of their response alone; plain tables, so that the planner may split a frequent one
    bodies = responses.where("payload is not null").select(F.col("record_id").alias("_record"), "html", "payload", "http")
    told = written(revisits, "warc-revisits").join(written(bodies, "warc-bodies"), "_record", "left")
    shape = ["page_id", "url", "digest", "record_type", "refers_to", "payload_bytes", "html", "record_id", "payload", "http"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(shape).unionByName(told.select(shape))


def deduplicate(spark: SparkSession, source: str, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Reads archives, resolves their revisits and writes deduplicated archives with fresh headers.

    Payloads stay byte for byte what they are, with their HTTP headers, also where a record's own digest says otherwise.
    Revisits without a response in the archives and records of other types are written as they stand.
    """
    read = written(read_archives(spark, source, keep_payload=True, strict=False), "warc-read")
    whole = written(resolve(read), "warc-resolved")
    write_archives(whole.where("payload is not null").select("page_id", "url", F.col("payload").alias("html"), "http", "record_id"), path, least_bytes, file_bytes)
    lost = whole.where("payload is null").select("record_id").distinct()  # revisits of what isn't here
    kept = read.where("raw is not null and record_type <> 'revisit'").select(F.col("raw").cast("string").alias("record"))
    alone = read.where("record_type = 'revisit'").join(lost, "record_id", "left_semi").select(F.col("raw").cast("string").alias("record"))
    _write(kept.unionByName(alone), path, file_bytes, mode="append")
