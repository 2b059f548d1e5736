"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``size`` tokens; only the histogram of piece lengths, at most ``size`` numbers,
comes to the driver. Lengths are placed longest first; each goes to the pack pattern with the most room left, and a
pattern's count says how many packs look like it. Patterns are then joined back to pieces by rank within a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, materialise, slices
from .hashed import SLICE, library_table

#: Pieces of one length that are ranked in one group on average, at most, and at least where tasks are idle.
RUN, SHORT = 50_000, 500
_SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long"


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, longest first; number of packs) so that each length is used as often as the histogram says."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # the keys of ``room``, ascending

    def put(lengths: tuple[int, ...], count: int) -> None:
        left = size - sum(lengths)
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            if not rooms or rooms[-1] < length:
                put((length,), todo)
                break
            most = rooms[-1]
            lengths, count = room[most].pop()
            if not room[most]:
                del room[most]
                del rooms[bisect_left(rooms, most)]
            used = min(count, todo)
            todo -= used
            put((*lengths, length), used)
            if used < count:
                put(lengths, count - used)
    return [p for left in rooms for p in room[left]]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): which pieces of a length go where."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, count in found:
        offset = 0
        for length in lengths:
            first = used.get(length, 0)
            used[length] = first + count
            out.append((length, first, first + count, sequence, offset))
            offset += length
        sequence += count
    return out


def cut_pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut every ``size`` tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_table(path, words=False)
        for batch in slices(batches, "text", SLICE):
            rows: list[list] = [[], [], [], [], []]
            ids, offsets = encoder.encode(batch.column(1))
            packed = memoryview(ids.astype("<u4").tobytes())
            bounds = (4 * offsets).tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                whole = bytes(packed[a:b]) + end
                n = len(whole) // 4
                for at in range(0, n, size):
                    piece = whole[4 * at : 4 * (at + size)]
                    for column, value in zip(rows, (doc, at, len(piece) // 4, zlib.crc32(piece), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return in_batches(docs.select("id", "text"), run, _SCHEMA)


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and ``end_id`` (null or empty text: the end id alone). Sequences are numbered from 0 and
    filled gaplessly from offset 0. Null and repeated ids are packed like any row; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # equal rows are told apart by where they stand, which is written with them
    pieces = materialise(cut_pieces(rows, path, size, end_id).withColumn("row", F.monotonically_increasing_id()), "pk-pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # both tables have a few rows for each length at most, which are ``size``, not for each document
    places = F.broadcast(spark.createDataFrame(slots(patterns(histogram, size)), "length long, first long, after long, sequence long, offset long"))
    # a frequent length is ranked in runs: short ones, for all tasks, while these are few, and then of ``RUN`` pieces
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = F.broadcast(spark.createDataFrame([(k, max(-(-n // RUN), min(-(-n // SHORT), tasks))) for k, n in histogram.items()], "length long, salts long"))
    salted = pieces.join(many, "length").withColumn("salt", F.pmod(F.xxhash64("row"), "salts")).drop("salts")
    # one row for each length and run of pieces of it
    counts = materialise(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pk-counts")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("k"))
    placed = ranked.join(places, (ranked.length == places.length) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    return placed.select(
        F.col("id").alias(id_col), "start", ranked.length.alias("length"), "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("offset")
    )
