"""Legacy ARC archives to WARC records, plain WARC files by Spark's own writer, and reading them back.

ARC files open with a version block whose second line names the version and whose third line the fields of the header
lines; a header line ends in the declared length of the payload that follows. Version 1 has five fields, version 2 ten.
A WARC record is built from them: an identifier and digests from the content, an ISO date from the 14 digits, a type.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, in_batches, materialise

#: Payloads under so many bytes are never stored as revisits.
REVISIT_BYTES = 100
#: Records in a file at most, half as many for each doubling of their payload above ``SMALL`` bytes, so that a file has some
#: 128 MB, a single larger record aside; and copies of one record that are dealt out together.
FILE_RECORDS, SMALL, RUN = 4000, 32_000, 1000
# fixed values: the two header layouts of the format and the profile name of revisit records
FIELDS = {
    b"1": ("url", "ip", "date", "type", "length"),
    b"2": ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record after the version block; a gzip file, of one member or one a record, is inflated first."""
    if content[:2] == b"\x1f\x8b":
        content = b"".join(inflated(content))
    at, names = 0, None
    while at < len(content):
        if content[at] == 0x0A:  # separators between records
            at += 1
            continue
        end = content.index(b"\n", at)
        parts = content[at:end].rstrip(b"\r").split(b" ")
        size, at = int(parts[-1]), end + 1
        block = content[at : at + size]
        if len(block) != size:
            raise ValueError("a record is shorter than its declared length")
        at += size
        if names is None:
            if not parts[0].startswith(b"filedesc:"):
                raise ValueError("no version block")
            version = block.split(b"\n", 1)[0].split(b" ")[0]
            names = FIELDS.get(version)
            if names is None:
                raise ValueError(f"unknown version {version!r}")
            continue
        yield dict(zip(names, (p.decode("utf-8", "replace") for p in _fields(parts, len(names))))), block


def _fields(parts: list[bytes], many: int) -> list[bytes]:
    """A header line's fields: URLs and content types may hold spaces, so they are what is left of the address before the date and right of the date."""
    after = many - 4  # fields that follow the content type
    for at in range(len(parts) - after - 2, 1, -1):
        if parts[at].isdigit() and 4 <= len(parts[at]) <= 14 and any(c in parts[at - 1] for c in b".:-"):
            middle = b" ".join(parts[at + 1 : len(parts) - after])
            return [b" ".join(parts[: at - 1]), parts[at - 1], parts[at], middle, *parts[len(parts) - after :]]
    raise ValueError(f"no address and date among {len(parts)} header fields")


def iso_date(digits: str) -> str:
    """The 14 digits of an ARC date, or their first 8 or 12, as a WARC date."""
    d = (digits + "00000101000000"[len(digits) :]) if len(digits) < 14 else digits
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20200101000000") -> DataFrame:
    """(id, content binary): each row as an ARC file of one record, version 1 for even ids and 2 for odd ones."""
    url = F.coalesce(F.regexp_replace(F.col(url_col), r"[\x00-\x20]", "%20"), F.lit(""))
    url = F.when(url == "", "urn:none").otherwise(url)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    size = F.octet_length(payload).cast("string")
    ident = F.col(id_col).cast("long")
    old = F.lit("1 0 fieldquarry\nURL IP-address Archive-date Content-type Archive-length\n")
    new = F.lit("2 0 fieldquarry\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n")

    def version_block(text, fields: str):
        return F.concat(F.lit(f"filedesc://pages.arc 0.0.0.0 {date} text/plain {fields}"), F.octet_length(text).cast("string"), F.lit("\n"), text, F.lit("\n"))

    one = F.concat(version_block(old, ""), url, F.lit(f" 0.0.0.0 {date} text/html "), size, F.lit("\n"), payload, F.lit("\n"))
    two = F.concat(version_block(new, "200 - - 0 pages.arc "), url, F.lit(f" 0.0.0.0 {date} text/html 200 - - 0 pages.arc "), size, F.lit("\n"), payload, F.lit("\n"))
    return pages.select(ident.alias("id"), F.when(F.coalesce(ident, F.lit(0)) % 2 == 0, one).otherwise(two).cast("binary").alias("content"))


def convert(arcs: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """One row per ARC record: id (of its row), record_id, url, date, content_type, payload, payload_bytes, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "record_id", "url", "date", "content_type", "payload", "payload_bytes", "digest"]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows: list[list] = [[] for _ in names]
                for ident, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for head, payload in arc_records(content or b""):
                        digest = hashlib.sha256(payload).hexdigest()
                        record = uuid.uuid5(uuid.NAMESPACE_URL, f"{ident} {head['url']} {head['date']} {digest}")
                        for column, value in zip(rows, (ident, f"<urn:uuid:{record}>", head["url"], iso_date(head["date"]), head["type"], payload, len(payload), digest)):
                            column.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    rows = arcs.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("content"))
    return in_batches(rows, run, "id long, record_id string, url string, date string, content_type string, payload binary, payload_bytes long, digest string")


def _numbered(records: DataFrame, keys: DataFrame) -> DataFrame:
    """``records`` with ``copy``: 0, and for equal records (one id, url, date and payload) a number of their own each.

    Equal records are counted and stored once, then dealt out again in runs of ``RUN``, so no task takes a hot one's copies.
    """
    repeats = materialise(keys.groupBy("record_id").agg(F.count("*").alias("n")).filter("n > 1"), "warc-repeats")
    if repeats.isEmpty():  # then no record is looked at twice
        return records.withColumn("copy", F.lit(0).cast("long"))
    alone = records.join(repeats, "record_id", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    once = records.join(repeats, "record_id").groupBy("record_id").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in records.columns if c != "record_id"])
    runs = once.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))).repartition("record_id", "run")
    copies = runs.withColumn("copy", F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("n")) - 1)))
    first, more = F.col("copy") == 0, F.md5(F.concat_ws(" ", "record_id", "copy"))
    own = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(more, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))
    copies = copies.withColumn("record_id", F.when(first, F.col("record_id")).otherwise(own))
    return alone.unionByName(copies.select(alone.columns))


def write_warc(records: DataFrame, out: str) -> None:
    """Write converted records as WARC files; of equal payloads of ``REVISIT_BYTES`` or more, only the smallest id's is stored.

    Rows without an id come after all ids. A record is one value of the text writer and the blank lines after it its
    line separator, so Spark commits the files, and a lost executor's are written again.
    """
    keys = materialise(records.select("digest", "id", "record_id", "payload_bytes"), "warc-keys")
    prints = keys.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    firsts = prints.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "record_id")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    firsts = materialise(firsts.select(F.col("digest").alias("d"), F.col("f.id").alias("first"), F.col("f.record_id").alias("first_record")), "warc-firsts")
    again = F.col("first_record").isNotNull() & (F.col("payload_bytes") >= REVISIT_BYTES) & ~(F.col("record_id") == F.col("first_record"))
    joined = _numbered(records, keys).join(firsts, F.col("digest") == F.col("d"), "left").withColumn("again", again)
    line = lambda name, value: F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("again"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("first_record")))).otherwise(""),
        F.when(F.col("again") & F.col("first").isNotNull(), line("X-Refers-To-Page", F.col("first"))).otherwise(""),
        F.when(F.col("id").isNotNull(), line("X-Page", F.col("id"))).otherwise(""),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.when(F.col("again"), F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit("\r\n"),
    )
    body = F.when(F.col("again"), F.lit("")).otherwise(F.col("payload").cast("string"))
    # a file is read as one value again: larger records go to files of fewer
    level = lambda size: F.when(size <= SMALL, 0).otherwise(F.ceil(F.log2(size / SMALL)).cast("int"))
    levels = [r.l for r in keys.select(level(F.col("payload_bytes")).alias("l")).distinct().orderBy("l").collect()] or [0]
    for one in levels:  # at most 17: a payload has less than 2 GiB
        own = joined.filter(level(F.col("payload_bytes")) == one) if len(levels) > 1 else joined
        values = own.select(F.concat(head, body).alias("value"))
        values.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "none").option("maxRecordsPerFile", max(1, FILE_RECORDS >> one)).text(out)


def inflated(content: bytes | memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, plain or of any number of gzip members, some at a time."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), step):
            yield bytes(view[at : at + step])
        return
    at = 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof:
            given = bytes(view[at : at + step])
            if not given:
                raise ValueError("a gzip member is cut off")
            at += len(given)
            while given and not member.eof:
                yield member.decompress(given, step)
                given = member.unconsumed_tail
            at -= len(member.unused_data)


def warc_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared lengths."""
    held = bytearray()

    def fill(enough) -> bool:
        while not enough():
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(lambda: len(held.lstrip(b"\r\n")) >= 5):
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no record at {bytes(held[:20])!r}")
        if not fill(lambda: b"\r\n\r\n" in held):
            raise ValueError("a header is cut off")
        end = held.index(b"\r\n\r\n") + 4
        lines = bytes(held[: end - 4]).split(b"\r\n")[1:]
        head = {k.decode().strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
        size = int(head["content-length"])
        if not fill(lambda: len(held) >= end + size):
            raise ValueError("a record is shorter than its declared length")
        yield head, bytes(held[end : end + size])
        del held[: end + size]
    if held.strip(b"\r\n"):
        raise ValueError(f"no record at {bytes(held[:20])!r}")


def _payload(head: dict[str, str], block: bytes) -> bytes:
    """The block without the HTTP header that it may begin with."""
    if head.get("content-type", "").replace(" ", "").lower().startswith("application/http") and block.startswith(b"HTTP/"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _agrees(told: str, payload: bytes) -> bool:
    """Whether a digest field is the payload's; algorithms other than SHA-256 and SHA-1 are not looked at."""
    kind, _, value = told.partition(":")
    if kind.lower() not in ("sha256", "sha1"):
        return True
    own = hashlib.new(kind.lower(), payload)
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """One row per record of the files: page_id, record_type, refers_to, payload_bytes, payload_digest, record_id, url, date, payload (null for revisits).

    Files are plain or gzip, of one member or one for each record. A response's size and SHA-256 are taken from its
    payload, without an HTTP header if there is one, and the digest field must agree. Page ids come from this writer's
    own fields and are null in other archives, as is the size of a revisit's payload there; its digest is what the
    field tells. A cut-off record is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "record_id", "url", "date", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in warc_records(inflated(content.as_buffer())):
                    told, kind = head.get("warc-payload-digest", ""), head.get("warc-type", "")
                    payload = None if kind == "revisit" else _payload(head, block)
                    if payload is None:
                        size, digest = head.get("x-payload-length"), told.partition(":")[2]
                        size = size and int(size)
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if not _agrees(told, payload):
                            raise ValueError(f"record {head.get('warc-record-id')} does not match its digest")
                    page, first = head.get("x-page"), head.get("x-refers-to-page")
                    rows.append((page and int(page), kind, first and int(first), size, digest, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), payload))
                    held += len(block)
                    if len(rows) == 500 or held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(out).filter("length > 0").select("content")
    return in_batches(files, run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, url string, date string, payload binary")


def archive(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Pages as legacy archives, converted, written as WARC files and read back.

    Null html is an empty payload and a null or blank url ``urn:none``. Equal rows are records of their own, each with
    an identifier of its own, of which one is the response. A page without an id keeps a record without one; it is the
    response of its payload only where no page with an id holds it. Other columns are ignored. An empty table gives an
    empty result.
    """
    out = out or fresh_path(pages.sparkSession, "warc")
    write_warc(convert(to_arc(pages)), out)
    return read_warc(pages.sparkSession, out)
