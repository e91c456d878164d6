"""WARC archives: written from a table, and read back by a reader that salvages what damage leaves.

Records are built as columns, packed as a gzip member each, and written by Spark's text
writer as the bytes they are. That writer wants something between rows: an empty
gzip member, which readers of gzip pass over. Unpacked, it is the two line ends that
close a record, and files are plain WARC/1.1.
The reader takes files whole (archives are written in files of a bounded size), plain or as
gzip members. It checks every record: version line, headers, length, closing line ends, and
digest. Where a check fails it looks for the next member or version line that starts a
valid record, goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogdiff.llm.common import spread_join, written

# The format's version line, line ends and gzip's first bytes.
VERSION = "WARC/1.1"
END, CLOSE = "\r\n", "\r\n\r\n"
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
RECORD = re.compile(rb"\r\nWARC/1\.[01]\r\n")
RECORD_START = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\d{1,15}")

# A gzip member that holds nothing.
NOTHING = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
# Payloads below this are never told apart by digest; bytes of an archive file that are aimed at.
SMALLEST, FILE_BYTES = 1000, 16 << 20
# Bytes of a row of packed members; a longer one is followed by rows without any, so that rows count bytes.
ROW_BYTES = 1 << 20
# Slots that payloads are looked up by.
SLOTS = 1 << 20

RECORD_SCHEMA = (
    "kind string, file string, start bigint, stop bigint, reason string, record_type string, record_id string, "
    "refers_to string, uri string, payload_digest string, payload_bytes bigint, payload binary"
)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def revisits(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """``page_id, url, html, digest, bytes, keeper`` of every row of ``pages``.

    ``keeper`` is the largest page_id with that payload where the payload has ``smallest``
    bytes and another page has it; it is NULL for the keeper itself, and rows that repeat its page_id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"))
    large = written(rows.where(F.col("bytes") >= smallest).select("page_id", "digest"), "digests")
    keepers = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    keepers = written(keepers, "keepers")
    # Pages are looked up by slot first, in a table of 2^20 at most: those of no keeper's slot, and small ones, are not shuffled.
    slot = F.expr(f"int(pmod(xxhash64(digest), {SLOTS}))")
    slots = F.broadcast(keepers.select(slot.alias("slot")).distinct())
    rows = rows.withColumn("slot", F.when(F.col("bytes") >= smallest, slot))
    alone = rows.join(slots, "slot", "left_anti").drop("slot").withColumn("keeper", F.lit(None).cast(pages.schema["page_id"].dataType))
    some = rows.join(slots, "slot", "left_semi").drop("slot")
    joined = spread_join(some, keepers, "digest", "n", "left").drop("n")
    other = ~F.col("keeper").eqNullSafe(F.col("page_id"))
    return alone.unionByName(joined.withColumn("keeper", F.when(other, F.col("keeper"))))


def write_archives(
    pages: DataFrame, path: str, smallest: int = SMALLEST, file_bytes: int = FILE_BYTES,
    date: str = "2024-01-01T00:00:00Z", packed: bool = True, row_bytes: int = ROW_BYTES,
) -> None:
    """Write a record for every row of ``pages (page_id, url, html)`` to the new folder ``path``.

    A page whose payload an other page of larger page_id has becomes a revisit without payload.
    A NULL page_id is written as ``null``, a NULL url as ``about:blank#``, and a url of other than printable ASCII, white
    space too, whole and percent-coded behind that. A file holds ``file_bytes`` and at most one record more, whatever the order of
    pages; unpacked ones hold as many records as fit if each were the longest. An empty table writes an empty folder, rows that
    repeat are records of their own, and other columns are not read.
    """
    rows = revisits(pages, smallest)
    url = F.coalesce("url", F.lit(""))
    url = F.when(url.rlike(r"^[\x21-\x7e]+\z"), url).otherwise(F.concat(F.lit("about:blank#"), F.url_encode(url)))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("keeper").isNotNull()
    head = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(CLOSE))
    block = F.when(again, F.lit("")).otherwise(F.concat(head, F.coalesce("html", F.lit(""))))
    record = F.concat(
        F.lit(VERSION + END),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", name(F.col("page_id"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, _header("WARC-Refers-To", name(F.col("keeper")))).otherwise(""),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + END)).otherwise(""),
        # A field of our own: what a revisit's payload would have had.
        _header("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response" + END),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )
    out, between = rows.select(record.alias("value")), CLOSE
    if packed:
        # The bytes pass as a text, which Spark neither checks nor changes.
        out = out.mapInArrow(lambda batches: _pack(batches, row_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
        between, per_file = NOTHING.decode("latin-1"), max(1, file_bytes // row_bytes)
    else:
        longest = pages.agg(F.max(F.coalesce(F.octet_length("html"), F.lit(0)) + 3 * F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0]
        per_file = max(1, file_bytes // (1_000 + (longest or 0)))
    out = out.write.option("encoding", "ISO-8859-1" if packed else "UTF-8").option("maxRecordsPerFile", per_file)
    out.option("lineSep", between).text(path)


def _pack(batches: Iterator[pa.RecordBatch], row_bytes: int) -> Iterator[pa.RecordBatch]:
    """Members one behind the other in rows of ``row_bytes``; a longer row is followed by as many empty members as it stands for."""
    close, held, size = CLOSE.encode(), [], 0

    def row() -> pa.RecordBatch:
        whole = [b"".join(held), *[NOTHING] * (size // row_bytes - 1)]
        return pa.RecordBatch.from_arrays([pa.array(whole, pa.binary())], ["value"])

    for batch in batches:
        for record in batch.column(0):
            held.append(gzip.compress(record.as_py().encode() + close, mtime=0))
            size += len(held[-1])
            if size >= row_bytes:
                yield row()
                held, size = [], 0
    if held:
        yield row()


def _parse(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The plain record at ``at``: its fields, where it ends, and what is wrong if it is none."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        return None, at, "no version line"
    close = data.find(b"\r\n\r\n", at, at + 65_536)
    if close < 0:
        # Long headers end anywhere in the member, in plain files before the next version line.
        following = RECORD.search(data, at)
        close = data.find(b"\r\n\r\n", at, following.start() + 2 if following else len(data))
    if close < 0:
        return None, at, "headers do not end"
    fields: dict[str, str] = {}
    for line in data[at:close].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None, at, "bad header line"
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not LENGTH.fullmatch(length.encode()):
        return None, at, "no content length"
    if "warc-type" not in fields or "warc-record-id" not in fields:
        return None, at, "a required header is missing"
    if not re.fullmatch(r"<[^<>\s]+>", fields["warc-record-id"]):
        return None, at, "record id is not in angle brackets"
    begin = close + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "record does not end where its length says"
    block = data[begin:end]
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    digest = fields.get("warc-payload-digest", "")
    if fields["warc-type"] != "revisit" and digest.startswith("sha1:"):
        if hashlib.sha1(payload).hexdigest() != digest[5:].lower():
            return None, at, "payload does not have its digest"
    return fields | {"payload": payload}, end + 4, ""


def _inflated(data: bytes, at: int, step: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds, as far as it can be had; where it ends, and what is wrong with it."""
    inflate, parts, fed, reason = zlib.decompressobj(31), [], at, ""
    try:
        while not inflate.eof and fed < len(data):
            parts.append(inflate.decompress(data[fed : fed + step]))
            fed = min(fed + step, len(data))
    except zlib.error:
        reason = "gzip member is damaged"
    if not reason and not inflate.eof:
        reason = "gzip member is cut short"
    return b"".join(parts), fed - len(inflate.unused_data), reason


def _member(data: bytes, at: int) -> tuple[list[dict], int, str, bool]:
    """The records in the gzip member at ``at``, where it ends, what is wrong, and whether its end is known."""
    plain, stop, reason = _inflated(data, at, 65_536)
    if reason == "gzip member is damaged":
        # Again in small steps: bytes before the damage are lost by the step that meets it.
        plain = _inflated(data, at, 64)[0]
    records, wrong = [], ""
    for _, _, fields, why in _walk(plain, RECORD_START, False):
        if fields is None:
            wrong = wrong or why
        else:
            records.append(fields)
    return records, stop, reason or wrong, not reason


def _walk(data: bytes, start: re.Pattern, members: bool) -> Iterator[tuple[int, int, dict | None, str]]:
    """Records from the start on; where a check fails, from the next place that ``start`` fits, with the bytes between as a gap."""
    at, lost, why = 0, None, ""
    while at < len(data):
        known = True
        if members and data[at : at + 2] == b"\x1f\x8b":
            found, stop, reason, known = _member(data, at)
        else:
            fields, stop, reason = _parse(data, at)
            found = [] if fields is None else [fields]
        good = known and (not reason or bool(found))
        if lost is not None and (found or good):
            yield lost, at, None, why
            lost = None
        if known:
            for fields in found:
                yield at, stop, fields, ""
        if good:
            if reason:
                # Some of the member's records are whole, and some of its bytes are none.
                yield at, stop, None, reason
            at = stop
            continue
        following = start.search(data, at + 1)
        behind = following.start() if following else len(data)
        if not known:
            for fields in found:
                yield at, behind, fields, ""
        if lost is None:
            lost, why = at, reason
        at = behind
    if lost is not None:
        yield lost, len(data), None, why


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """``(start, stop, fields, reason)`` of records and, without fields, of the gaps between them; empty members are neither.

    A member of several records, or one whose end is cut off or damaged, gives the records that are whole in what
    can be inflated, with the bytes of the member; what else is in it is a gap of these bytes.
    """
    return _walk(data, START, True)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of the archives in a folder; ``kind`` is ``record`` or ``gap``.

    A file is read by one task, in memory, as archives of many gzip members have to be; keep files to
    a size that allows it, as ``write_archives`` does. An empty file has no rows. A gap
    has the file, its first byte, the one behind it, and the first check that failed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for start, stop, fields, reason in salvage(data.as_py()):
                    rows.append(_row(file, start, stop, fields, reason))
                    size += stop - start
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORD_SCHEMA)


def _row(file: str, start: int, stop: int, fields: dict | None, reason: str) -> tuple:
    if fields is None:
        return ("gap", file, start, stop, reason, *[None] * 7)
    length = fields.get("x-payload-length", "")
    size = int(length) if fields["warc-type"] == "revisit" and length.isdigit() else len(fields["payload"])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:").lower() or hashlib.sha1(fields["payload"]).hexdigest()
    return (
        "record", file, start, stop, None, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"),
        fields.get("warc-target-uri"), digest, size, fields["payload"],
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()] * 6 + [pa.int64(), pa.binary()]
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def page_number(name: Column) -> Column:
    """The page_id in a record's name; NULL for the name of a page without one."""
    digits = F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(digits != "", digits.cast("bigint"))
