"""Legacy web archives (ARC) to WARC.

An ARC file is a version block and then records of one header line, the declared number of bytes and a line feed. Version 1
header lines have five fields (address, IP, 14-digit date, type, length), version 2 ten (result code, checksum, redirect, offset and
file name between type and length). The parser goes by the version the file declares and by the declared lengths alone, so
payloads may hold anything, header-like lines too. Each ARC record becomes a WARC record: a name-based UUID of address, date and
block, the date in ISO form, the type by content (``response`` for HTTP messages, else ``resource``), SHA-256 digests of block and
payload. Records of equal payloads of ``least`` bytes or more become revisits of the one with the smallest key.

Files are written by Spark's text writer (gzip, one file per task, record after record) and read as whole files, so any store
Spark knows will do. A file holds one task's partition, which the partitioning bounds; records are parsed one at a time.
The archives are not given out to one task, nor is a group of equal payloads: a revisit is decided by one minimum per digest.

Pages: ``page_id`` travels as a header of the archived HTTP message. Null html is an empty payload, null or odd addresses
are written as ``urn:page``, blanks and line breaks in addresses as %-codes. Rows of null ids are records too (last in the order); of
equal ids and payloads one row is the response. Other columns are ignored; an empty table gives no record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Field names of the two versions' header lines.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
LEAST = 100
KEY_HEADER = "X-Page-Id"
WARC_VERSION = "WARC/1.1"
RECORD = "record_id string, type string, url string, ip string, date string, content_type string, http string, key long, payload binary, payload_digest string, block_digest string"


def header_line(version: int, url: str, ip: str, date: str, kind: str, length: int, code: int = 200, checksum: str = "-", location: str = "-", offset: int = 0, name: str = "-") -> str:
    fields = (url, ip, date, kind, str(length)) if version == 1 else (url, ip, date, kind, str(code), checksum, location, str(offset), name, str(length))
    return " ".join(fields)


def version_block(version: int, name: str, date: str) -> str:
    body = f"{version} 0 pages\n{' '.join(FIELDS[version])}\n"
    return header_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body.encode()), name=name) + "\n" + body


def safe_url(url: str | None) -> str:
    url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    return url or "urn:page"


def write_arc(pages: DataFrame, path: str, date: str = "20240131120000", versions: tuple[int, ...] = (1, 2), id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """Pages as ARC files below ``path``, one per task, the versions in turn."""

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        version, name, first = versions[task % len(versions)], f"pages-{task:06d}.arc", True
        for frame in frames:
            out = [version_block(version, name, date)] if first else []
            first = False
            for key, url, html in zip(frame["key"].array, frame["url"], frame["html"], strict=True):
                body = html.encode("utf-8", "surrogatepass")
                mark = "" if pd.isna(key) else f"{KEY_HEADER}: {int(key)}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n"
                checksum = hashlib.md5(body).hexdigest()
                out.append(header_line(version, safe_url(url), "192.0.2.1", date, "text/html", len(http) + len(body), checksum=checksum, name=name) + "\n" + http + html)
            yield pd.DataFrame({"value": out})

    rows = pages.select(F.col(id_column).cast("long").alias("key"), F.col(url_column).alias("url"), F.coalesce(F.col(html_column), F.lit("")).alias("html"))
    rows.mapInPandas(records, "value string").write.option("compression", "gzip").text(path)


def inflated(content: bytes) -> bytes:
    """A file's bytes; gzip files may have any number of members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def rejoined(parts: list[str], n: int) -> list[str]:
    """Fields of a header line with too many blanks: old writers left some in addresses and types, which IP and date stand between."""
    for k in range(1, len(parts) - n + 2):
        if re.fullmatch(r"[0-9a-fA-F.:]*[.:][0-9a-fA-F.:]*|-", parts[k]) and re.fullmatch(r"\d{4,14}", parts[k + 1]):
            behind = len(parts) - (n - 4)
            return [" ".join(parts[:k]), parts[k], parts[k + 1], " ".join(parts[k + 2 : behind]), *parts[behind:]]
    return parts


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields, block)`` of every record but the version block."""
    at, version = 0, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "surrogateescape")
        if not line:
            at = end + 1
            continue
        parts = line.split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"an ARC header line declares no length: {line[:80]}")
        size = int(parts[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError("an ARC record is shorter than declared")
        at = end + 1 + size
        if not version or line.startswith("filedesc://"):
            declared = block.split(b" ", 1)[0]
            version = int(declared) if declared.isdigit() else 0
            if version not in FIELDS:
                raise ValueError("an ARC file begins with a version block of version 1 or 2")
            continue
        names = FIELDS[version]
        if len(parts) > len(names):
            parts = rejoined(parts, len(names))
        if len(parts) != len(names):
            raise ValueError(f"an ARC header line of version {version} has {len(parts)} fields")
        yield dict(zip(names, parts, strict=True)), block


def iso_date(date: str) -> str:
    """14 digits to ISO 8601; shorter dates of old archives stand for their beginning."""
    d = date if len(date) >= 14 else date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header and payload; a block that is no HTTP message is payload as a whole."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, payload = block.partition(b"\r\n\r\n")
    return head + mark, payload


def http_field(http: str, name: str) -> str | None:
    m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$", http)
    return m[1] if m else None


def converted(fields: dict[str, str], block: bytes) -> tuple:
    """A row of ``RECORD`` from an ARC record."""
    http, payload = split_http(block)
    block_digest = hashlib.sha256(block).hexdigest()
    head = http.decode("utf-8", "surrogateescape")
    key = http_field(head, KEY_HEADER)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {fields['Archive-date']} {block_digest}")
    return (f"urn:uuid:{name}", "response" if http else "resource", fields["URL"], fields["IP-address"], iso_date(fields["Archive-date"]), fields["Content-type"], head,
            int(key) if key else None, payload, hashlib.sha256(payload).hexdigest(), block_digest)


def _frames(rows: Iterator[tuple], columns: list[str], key: str | None = None, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 500 + sum(len(x) for x in row if isinstance(x, bytes | str))
        if size >= most:
            yield pd.DataFrame(held, columns=columns).astype({key: "Int64"} if key else {})
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns).astype({key: "Int64"} if key else {})


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ARC files below ``path``, as WARC records (``RECORD``)."""
    columns = [c.split()[0] for c in RECORD.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                yield from _frames((converted(f, b) for f, b in parse_arc(inflated(content))), columns, "key")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD)


def with_revisits(records: DataFrame, least: int = LEAST) -> DataFrame:
    """Records of equal payloads: the one of smallest key (null last, then record id) is the original, others revisit it."""
    named = records.withColumn("_row", F.monotonically_increasing_id())
    order = (F.col("key").isNull().alias("none"), "key", "record_id", "_row")
    same = named.where((F.length("payload") >= least) & (F.col("type") == "response"))
    first = same.groupBy(F.col("payload_digest").alias("digest")).agg(F.min(F.struct(*order, "url", "date")).alias("o"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", *[F.col("o")[c].alias(f"first_{c}") for c in ("key", "record_id", "_row", "url", "date")])
    joined = named.join(first, (named["payload_digest"] == first["digest"]) & (F.length(named["payload"]) >= least) & (named["type"] == "response"), "left")
    revisit = F.col("digest").isNotNull() & (F.col("_row") != F.col("first__row"))
    return joined.select(*records.columns, revisit.alias("revisit"), *[F.when(revisit, F.col(f"first_{c}")).alias(f"refers_{c}") for c in ("key", "record_id", "url", "date")])


def write_warc(records: DataFrame, path: str) -> None:
    """Rows of ``with_revisits`` as WARC files, one per task. A revisit keeps the HTTP header and leaves the payload out."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                http = r.http.encode("utf-8", "surrogateescape")
                block = http if r.revisit else http + r.payload
                head = [WARC_VERSION, f"WARC-Type: {'revisit' if r.revisit else r.type}", f"WARC-Record-ID: <{r.record_id}>", f"WARC-Date: {r.date}", f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}",
                        f"WARC-Payload-Digest: sha256:{r.payload_digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest() if r.revisit else r.block_digest}"]
                if r.revisit:
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{r.refers_record_id}>", f"WARC-Refers-To-Target-URI: {r.refers_url}", f"WARC-Refers-To-Date: {r.refers_date}"]
                    if not pd.isna(r.refers_key):
                        head.append(f"X-Refers-To-Page: {int(r.refers_key)}")
                head += [f"Content-Type: {'application/http;msgtype=response' if http else r.content_type}", f"Content-Length: {len(block)}", "", ""]
                out.append("\r\n".join(head).encode("utf-8", "surrogateescape") + block)
            yield pd.DataFrame({"value": out})

    # Bytes go through as they are: the writer takes the string's bytes and ends every record with two line ends.
    records.mapInPandas(write, "value binary").select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields, block)`` of every record, by declared lengths."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError("a WARC record does not begin where the one before ends")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a WARC record is shorter than declared")
        yield fields, block
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, type, url, date, key, refers_to, refers_key, payload_bytes, payload_digest, payload`` of all records. Of a revisit the payload is null,
    its size that of the HTTP header; other payloads' digests are checked against the declared ones."""
    schema = "record_id string, type string, url string, date string, key long, refers_to string, refers_key long, payload_bytes long, payload_digest string, payload binary"
    columns = [c.split()[0] for c in schema.split(", ")]

    def row(fields: dict[str, str], block: bytes) -> tuple:
        http, payload = split_http(block)
        head = http.decode("utf-8", "surrogateescape")
        declared = fields["warc-payload-digest"].removeprefix("sha256:")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and hashlib.sha256(payload).hexdigest() != declared:
            raise ValueError(f"the payload of {fields['warc-record-id']} does not have its declared digest")
        size = int(http_field(head, "Content-Length") or 0) if revisit else len(payload)
        key, refers = http_field(head, KEY_HEADER), fields.get("x-refers-to-page")
        return (fields["warc-record-id"].strip("<>"), fields["warc-type"], fields["warc-target-uri"], fields["warc-date"], int(key) if key else None, fields.get("warc-refers-to", "").strip("<>") or None,
                int(refers) if refers else None, size, declared, None if revisit else payload)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                for out in _frames((row(f, b) for f, b in parse_warc(inflated(content))), columns, "key"):
                    yield out.astype({"refers_key": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, schema)
