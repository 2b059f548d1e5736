"""Token-id files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id and a bitmap that marks the
ids that go on; level k + 1 holds the next chunk of just those. A rank directory over each bitmap (ones before every
512 bits) says where an id's next chunk lies, so token i is found level by level without decoding anything else.

One record (all integers little-endian)::

    "DAC1" | u32 bytes that follow | u64 documents D | u64 tokens N | u32 levels
    i64 document id x D | u8 1 where that id is null x D | u64 first token x (D + 1)
    per level: u64 chunks M | M chunk bytes | ceil(M / 8) bitmap bytes, lowest bit first | u32 ones before each 512 bits

Spark's text writer commits the files: a record is one value, and the line feed after it isn't part of it. Files are
numbered by partition, and within one from its first record on, so ids ascend from file to file and within each. A
record is closed once it holds about ``RECORD`` tokens, a file once it holds ``RECORDS`` records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, in_batches, slices
from .hashed import SLICE, library_table

MAGIC, BLOCK = b"DAC1", 512
RECORD, RECORDS = 1_000_000, 64
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def write_record(docs: list[int | None], packed: list[bytes]) -> bytes:
    """A record of documents and their packed 32-bit ids."""
    firsts = np.cumsum([0] + [len(p) // 4 for p in packed]).astype("<u8")
    ids = np.frombuffer(b"".join(packed), "<u4")
    levels = []
    while True:
        going = ids > 255
        bitmap = np.packbits(going, bitorder="little")
        ones = np.add.reduceat(_BITS[bitmap], np.arange(0, len(bitmap), BLOCK // 8), dtype=np.uint32) if len(bitmap) else np.empty(0, np.uint32)
        before = np.cumsum(np.append(np.uint32(0), ones), dtype="<u4")
        levels += [struct.pack("<Q", len(ids)), ids.astype(np.uint8).tobytes(), bitmap.tobytes(), before.tobytes()]
        ids = ids[going] >> 8
        if not len(ids):
            break
    body = b"".join([
        struct.pack("<QQI", len(docs), int(firsts[-1]), len(levels) // 4), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], np.uint8).tobytes(), firsts.tobytes(), *levels,
    ])
    return MAGIC + struct.pack("<I", len(body)) + body


class Record:
    """Random access to one record's tokens."""

    def __init__(self, body: memoryview):
        n, self.tokens, levels = struct.unpack_from("<QQI", body, 0)
        at = 20
        self.docs = np.frombuffer(body, "<i8", n, at)
        self.nulls = np.frombuffer(body, np.uint8, n, at + 8 * n)
        self.firsts = np.frombuffer(body, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        self.levels = []
        for _ in range(levels):
            (m,) = struct.unpack_from("<Q", body, at)
            at += 8
            size = -(-m // 8)
            marks = -(-m // BLOCK) + 1
            self.levels.append((np.frombuffer(body, np.uint8, m, at), np.frombuffer(body, np.uint8, size, at + m), np.frombuffer(body, "<u4", marks, at + m + size)))
            at += m + size + 4 * marks

    def access(self, i: np.ndarray) -> np.ndarray:
        """Ids at the positions ``i``, in any order."""
        at = np.asarray(i, np.int64)
        out = np.zeros(len(at), np.uint32)
        live = np.arange(len(at))
        for k, (chunks, bitmap, before) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            on = (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live, at = live[on], at[on]
            if not len(at):
                break
            block = at // BLOCK
            rank = before[block].astype(np.int64)
            byte = block * (BLOCK // 8)
            for _ in range(BLOCK // 8):
                inside = byte < at >> 3
                if not inside.any():
                    break
                rank += np.where(inside, _BITS[bitmap[np.minimum(byte, len(bitmap) - 1)]], 0)
                byte += 1
            rest = bitmap[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)
            at = rank + _BITS[rest]
        return out

    def run(self, a: int, b: int) -> np.ndarray:
        """Ids of the positions a to b - 1: one rank at the start of each level, then the chunks in order."""
        out = np.zeros(b - a, np.uint32)
        live = np.arange(b - a)
        for k, (chunks, bitmap, before) in enumerate(self.levels):
            out[live] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * k)
            start = a // BLOCK * (BLOCK // 8)
            bits = np.unpackbits(bitmap[start : -(-b // 8)], bitorder="little")
            skip = a - 8 * start
            rank = int(before[a // BLOCK]) + int(bits[:skip].sum())
            on = bits[skip : skip + b - a].astype(bool)
            live = live[on]
            a, b = rank, rank + len(live)
            if a == b:
                break
        return out


def records(content: bytes) -> Iterator[Record]:
    """The records of one file."""
    view, at = memoryview(content), 0
    while at < len(view):
        if bytes(view[at : at + 4]) != MAGIC:
            raise ValueError(f"no record at byte {at}")
        (size,) = struct.unpack_from("<I", view, at + 4)
        yield Record(view[at + 8 : at + 8 + size])
        at += 8 + size + 1


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write record files under ``out`` in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_table(path, words=True)
        end = np.array([end_id], "<u4").tobytes()
        held: list[int | None] = []
        packed: list[bytes] = []
        room = RECORD
        schema = pa.schema([("value", pa.binary())])
        for batch in slices(batches, "text", SLICE):
            ids, offsets = encoder.encode(batch.column(1))
            flat = memoryview(ids.astype("<u4").tobytes())
            bounds = (4 * offsets).tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                held.append(doc)
                packed.append(bytes(flat[a:b]) + end)
                room -= (b - a) // 4 + 1
                if room <= 0:
                    yield pa.RecordBatch.from_arrays([pa.array([write_record(held, packed)], pa.binary())], schema=schema)
                    held, packed, room = [], [], RECORD
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_record(held, packed)], pa.binary())], schema=schema)

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    # rows without an id, or of one id, may be many: where they stand deals them out
    order = [F.col("id").asc_nulls_last(), F.col("row")]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("id", "text")
    values = in_batches(dealt, run, "value binary").select(F.col("value").cast("string"))
    values.write.option("compression", "none").option("maxRecordsPerFile", RECORDS).text(out)


def read_tokens(spark, out: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files, ``start`` counting the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                at = 0
                for record in records(content.as_buffer()):
                    bounds = record.firsts.tolist()
                    crc = [zlib.crc32(record.run(a, b).astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:])]
                    ids = pa.array(record.docs.astype(np.int64), mask=record.nulls.astype(bool))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(crc)), ids, pa.array(record.firsts[:-1] + at), pa.array(np.diff(record.firsts)), pa.array(crc, pa.int64())], names=["file", "id", "at", "n_tokens", "ids_crc32"]
                    )
                    at += record.tokens

    files = spark.read.format("binaryFile").load(out).filter("length > 0").select("path", "content")
    rows = in_batches(files, run, "file string, id long, at long, n_tokens long, ids_crc32 long")
    # one row for each file; names hold the numbers of the partition and of the file in it
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    order = Window.orderBy(number(r"part-(\d+)-[^/]*$"), number(r"-c(\d+)[^/]*$")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return rows.join(starts, "file").select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = 1, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and read them back: (id, start, n_tokens, ids_crc32).

    Null or empty texts are the end id alone. Null ids come last; rows with equal ids stay together in no fixed order.
    Other columns are ignored. An empty table gives an empty result.
    """
    out = out or fresh_path(docs.sparkSession, "dac")
    write_tokens(docs, out, path, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, out, id_col)
