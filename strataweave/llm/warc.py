"""Legacy archive converter: ARC in, WARC out.

``parse_arc`` reads an ARC file: its version block names the version, the version fixes the fields of each header line,
the last field declares the record's length, and the reader goes by that length alone. ``to_warc`` makes WARC records
of them: identifiers derived from what a record is (so a rerun makes the same ones), ISO timestamps, types, SHA-1 digests
of block and payload, and revisit records for payloads that another record carries. A record's block goes over byte for
byte: an HTTP message stays the response it was, with its own status and headers, and any other block (dns, ftp) is a
resource of the declared type. The IP address is kept, and a version block becomes a warcinfo record.

WARC files are written by Spark's text writer, whose line separator is the blank line pair that ends a record, so no task
writes to a path of its own. It writes bytes as they are. A file is one gzip member with records of about FILE_BYTES; the
writer cannot begin a member for each record, so readers go through a file from its start.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.common import bounded_batches, join_group_facts, materialize, new_path, pick

# Field names of an ARC header line by version.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
_NAMES = {"1": "URL IP-address Archive-date Content-type Archive-length", "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: Bytes of records an archive file holds before the next begins; a reader takes a file at a time.
FILE_BYTES = 8 << 20
#: Bytes of records a batch holds before the next begins, as well as a number of rows: blocks have no largest size.
BATCH_BYTES = 2 << 20
#: Rows Spark's Parquet reader holds at once here: with its own 4,096, pages of 1 MB take 4 GB.
READ_ROWS = 16
#: Row groups of converted records in compressed bytes, measured at every row: the writer holds a group in memory.
_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.check.estimate": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
ARCHIVE_DATE = "20240101000000"


def sha1_base32(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def write_arc(records: list[tuple[str, str, bytes]], version: str, name: str = "archive") -> bytes:
    """An ARC file of (url, mime, block) records. Spaces in a URL or type would shift the fields, so they are encoded."""
    head = f"{version} 0 origin\n{_NAMES[version]}\n".encode()
    out = [b"filedesc://%s.arc 0.0.0.0 %s text/plain" % (name.encode(), ARCHIVE_DATE.encode()), b" 200 - - 0 %s.arc" % name.encode() if version == "2" else b"", b" %d\n" % len(head), head, b"\n"]
    at = sum(map(len, out))
    for url, mime, block in records:
        url, mime = "%20".join(url.split()) or "-", "%20".join(mime.split()) or "-"
        middle = f" 200 {sha1_base32(block)} - {at} {name}.arc" if version == "2" else ""
        line = f"{url} 0.0.0.0 {ARCHIVE_DATE} {mime}{middle} {len(block)}\n".encode()
        out += [line, block, b"\n"]
        at += len(line) + len(block) + 1
    return b"".join(out)


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an ARC file, its version block first (with the version as a field).

    Raises ValueError on a first line that is no version block, a header line with too few fields, a length that is no
    number, or a file that ends inside a block.
    """
    at, version = 0, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        parts = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"no declared length at byte {at}")
        block = content[end + 1 : end + 1 + int(parts[-1])]
        if len(block) < int(parts[-1]):
            raise ValueError(f"the record at byte {at} ends early")
        at = end + 1 + len(block)
        if version is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("no version block")
            version = block[:1].decode("ascii", "replace")
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
            yield {"url": parts[0], "ip": parts[1] if len(parts) > 1 else "", "date": parts[2] if len(parts) > 2 else "", "mime": "text/plain", "version": version}, block
            continue
        names = ARC_FIELDS[version]
        if len(parts) < len(names):
            raise ValueError(f"{len(parts)} fields for {len(names)} at byte {end}")
        # A URL with spaces leaves more parts than fields: the surplus belongs to it.
        extra = len(parts) - len(names)
        yield dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]], strict=True)) | {"version": version}, block


def http_block(payload: bytes, page_id: int | None, mime: str = "text/html; charset=utf-8") -> bytes:
    page = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\n%sContent-Length: %d\r\n\r\n%s" % (mime.encode(), page, len(payload), payload)


def split_http(block: bytes) -> tuple[dict[str, str], int]:
    """(header fields in lower case, bytes of the head): lines end in CR LF or LF, the first empty one ends the head.

    A block that is no HTTP message has neither; one without an empty line is all head.
    """
    if block[:5] != b"HTTP/":
        return {}, 0
    ends = [(at, at + len(mark)) for mark in (b"\r\n\r\n", b"\n\n", b"\n\r\n") if (at := block.find(mark)) >= 0]
    head, after = min(ends, default=(len(block), len(block)))
    lines = block[:head].decode("utf-8", "replace").splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, after


def record_id(url: str, date: str, digest: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page_id}')}>"


def iso_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, url: str, date: str, block: bytes, own_id: str, mime: str, more: list[tuple[str, str]]) -> bytes:
    """One record without the blank lines that end it."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", iso_date(date))]
    fields += [("WARC-Target-URI", url)] if kind != "warcinfo" else []
    fields += [("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), *more, ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record; blocks are taken by their declared length."""
    at = 0
    while at < len(content):
        if content[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at : at + 5] != b"WARC/":
            raise ValueError(f"no record header at byte {at}")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4 + int(fields["content-length"])
        if at > len(content):
            raise ValueError("the last record ends early")
        yield fields, content[end + 4 : at]


def _to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, turn = [], 0, None
    for b in batches:
        for page, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").cast(pa.binary()).to_pylist(), strict=True):
            turn = (page or 0) if turn is None else turn
            block = http_block(html or b"", page)
            held.append((url or "-", "text/html", block))
            size += len(block)
            if size >= FILE_BYTES:
                content = write_arc(held, "12"[turn % 2])
                held, size, turn = [], 0, turn + 1
                yield _one(content)
    if held:
        yield _one(write_arc(held, "12"[turn % 2]))


def _one(content: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """ARC files (content binary) of about FILE_BYTES, versions 1 and 2 in turn: one record per row, repeated rows too.

    Null url "-", null html an empty payload, null page_id no X-Page-Id. An empty table gives no file. Columns besides
    page_id, url and html are not read.
    """
    return _page_rows(pages).mapInArrow(_to_arc, "content binary")


def _page_rows(pages: DataFrame) -> DataFrame:
    bounded_batches(pages.sparkSession)
    return pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), "url", "html")


_CONVERTED = "kind string, page_id long, url string, ip string, date string, mime string, block binary, head int, payload_bytes long, payload_digest string, same binary"


def _kinds(schema: str) -> tuple[list[str], list[pa.DataType]]:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return list(names), [types[k] for k in kinds]


def _batches(rows: Iterator[tuple], schema: str, most: int = 200) -> Iterator[pa.RecordBatch]:
    """Batches of ``most`` rows, or fewer as soon as they hold BATCH_BYTES: one row's bytes over that at most."""
    names, kinds = _kinds(schema)
    held: list[tuple] = []
    size = 0

    def taken() -> pa.RecordBatch:
        nonlocal held, size
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
        held, size = [], 0
        return batch

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) == most or size >= BATCH_BYTES:
            yield taken()
    if held:
        yield taken()


def _from_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for content in b.column("content"):
                for i, (fields, block) in enumerate(parse_arc(content.as_py())):
                    http, head = split_http(block)
                    payload = block[head:]
                    kind = "warcinfo" if i == 0 else "response" if http or head else "resource"
                    page = http.get("x-page-id", "")
                    yield kind, int(page) if page.removeprefix("-").isdigit() else None, fields["url"], fields["ip"], fields["date"], fields["mime"], block, head, len(payload), sha1_base32(payload), hashlib.sha256(payload).digest()

    yield from _batches(rows(), _CONVERTED)


def _through_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to ARC files to records in one worker: as rows between two, each file would be copied several times in the JVM."""
    return _from_arc(_to_arc(batches))


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside read few rows at once, whatever the length of their pages and blocks."""
    bounded_batches(spark)
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(READ_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC files under ``path`` as rows with a binary column ``content``."""
    return spark.read.format("binaryFile").load(path).select("content")


_WRITTEN = "value binary, part int"


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        size = 0
        for b in batches:
            for r in b.to_pylist():
                own, block, kind, mime = record_id(r["url"], r["date"], r["payload_digest"], r["page_id"]), r["block"], r["kind"], "application/http; msgtype=response"
                more = [("WARC-Payload-Digest", f"sha1:{r['payload_digest']}")]
                if r["ip"] and r["ip"] not in ("0.0.0.0", "-"):
                    more.append(("WARC-IP-Address", r["ip"]))
                if kind == "warcinfo":
                    more, mime = [("WARC-Filename", r["url"].removeprefix("filedesc://"))], "application/warc-fields"
                    block = b"software: ARC converter\r\nformat: WARC file version 1.1\r\nsource-format: ARC file version %s\r\n" % block[:1]
                elif kind == "resource":
                    mime = r["mime"]
                if r["revisit"]:
                    more += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["to_url"], r["to_date"], r["payload_digest"], r["to_page"]))]
                    # Not a field of the standard: what the head's own Content-Length may not say.
                    more.append(("X-Payload-Length", str(len(block) - r["head"])))
                    kind, block = "revisit", block[: r["head"]]
                record = warc_record(kind, r["url"], r["date"], block, own, mime, more)
                yield record, size // FILE_BYTES
                size += len(record)

    yield from _batches(rows(), _WRITTEN, 50)


def convert(archives: DataFrame, path: str, least_bytes: int = 0) -> None:
    """ARC files (binary ``content``) to gzip WARC files under ``path``, in folders of one file per task.

    Of records with equal payloads of at least ``least_bytes``, the one with the largest page id (null last, then url and
    date) is written whole and the others revisit it; smaller payloads are all written whole. Records equal in page id, url
    and date as well are one capture written twice, all of them whole. A payload's copies are settled on narrow rows; a
    group of copies, however large, meets in no task. An archive that cannot be parsed raises ValueError.
    """
    with _few_rows(archives.sparkSession):
        _write(archives.mapInArrow(_from_arc, _CONVERTED), path, least_bytes)


def _write(converted: DataFrame, path: str, least_bytes: int) -> None:
    rows = materialize(converted, "warc-rows", **_GROUPS)
    keyed = (F.col("kind") != "warcinfo") & (F.col("payload_bytes") >= least_bytes)
    narrow = rows.filter(keyed).select("same", "page_id", "url", "date")
    order = F.struct(F.coalesce("page_id", F.lit(-(2**63))), "url", "date")
    heads = narrow.groupBy("same").agg(F.count("*").alias("copies"), F.max_by(F.struct("page_id", "url", "date"), order).alias("to"))
    heads = materialize(heads.filter("copies > 1").select("same", "copies", F.col("to.page_id").alias("to_page"), F.col("to.url").alias("to_url"), F.col("to.date").alias("to_date")), "warc-heads")
    # A payload under ``least_bytes`` or a version block has no key, hence no other copy.
    rows = rows.withColumn("same", F.when(keyed, F.col("same")))
    met = join_group_facts(rows, heads, "same", "copies", rows.count())
    is_head = F.col("page_id").eqNullSafe(F.col("to_page")) & (F.col("url") == F.col("to_url")) & (F.col("date") == F.col("to_date"))
    met = met.withColumn("revisit", F.col("copies").isNotNull() & ~F.coalesce(is_head, F.lit(False)))
    records = met.drop("same", "copies").mapInArrow(_to_warc, _WRITTEN).select(F.col("value").cast("string").alias("value"), "part")
    records.write.partitionBy("part").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, own string, refers string"


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    def rows() -> Iterator[tuple]:
        for b in batches:
            for content in b.column("content"):
                raw = content.as_py()
                for fields, block in parse_warc(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, head = split_http(block)
                    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), len(block) - head
                    if kind == "revisit":
                        size = int(fields["x-payload-length"])
                    elif sha1_base32(block[head:]) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its record")
                    page = http.get("x-page-id", "")
                    yield int(page) if page.removeprefix("-").isdigit() else None, size, digest, kind, fields["warc-record-id"], fields.get("warc-refers-to")

    yield from _batches(rows(), _READ, 2000)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record but warcinfo; digests of payloads that are there are checked."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    rows = materialize(files.mapInArrow(_from_warc, _READ), "warc-read")
    revisited = rows.filter("refers is not null").groupBy("refers").agg(F.count("*").alias("copies"))
    # Records written twice share an identifier and a page: one of them stands for it.
    heads = rows.filter("refers is null").groupBy("own").agg(F.first("page_id", ignorenulls=True).alias("refers_to"))
    heads = materialize(revisited.join(heads, F.col("refers") == F.col("own")).select("refers", "copies", "refers_to"), "warc-targets")
    out = join_group_facts(rows, heads, "refers", "copies", rows.count())
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages through ARC to WARC files and back: one row per input row, from the files.

    Null html is an empty payload, and empty payloads are copies of each other. Null url is "-". Rows equal in page_id,
    url and html are one capture written twice: all of them are the response. An empty table gives an empty result.
    Columns besides page_id, url and html are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    with _few_rows(spark):
        _write(_page_rows(pages).mapInArrow(_through_arc, _CONVERTED), path, 0)
    return read_warc(spark, path)
