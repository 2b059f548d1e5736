"""Byte-level BPE by rank files.

A piece's merges are chosen by a segment tree over its byte positions: leaf i holds the rank of the pair that starts
there, inner nodes the smallest (rank, position) below them, so the root is the leftmost minimum. A merge updates the
three leaves whose pair changed, each along one path to the root: n bytes take O(n log n) steps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices
from .hashed import SLICE, ChunkTable, cut_spaces

#: Chunks that a worker's table keeps, and distinct pieces that it remembers before it starts anew.
REMEMBERED, REMEMBERED_PIECES = 1_000_000, 200_000
_NONE = 1 << 62


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: always merge the leftmost pair of the lowest rank, until no pair has one."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(n - 1, 1).bit_length()
    shift = size.bit_length()
    mask = (1 << shift) - 1
    end = list(range(1, n + 1))  # where the part that starts at i ends
    before = list(range(-1, n - 1))  # where the part before it starts
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def update(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:
                return
            tree[k] = a
            k >>= 1

    while tree[1] != _NONE:
        i = tree[1] & mask
        j = end[i]
        stop = end[i] = end[j]
        if stop < n:
            before[stop] = i
            rank = get(piece[i : end[stop]])
            update(i, _NONE if rank is None else rank << shift | i)
        else:
            update(i, _NONE)
        update(j, _NONE)
        h = before[i]
        if h >= 0:
            rank = get(piece[h:stop])
            update(h, _NONE if rank is None else rank << shift | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


@lru_cache(maxsize=2)
def pattern_table(path: str, pattern: str) -> ChunkTable:
    """A worker's table of chunks, each encoded piece by piece as ``pattern`` splits it; pieces are remembered too."""
    import regex

    ranks, split, known = load_ranks(path), regex.compile(pattern).findall, {}

    def encode_all(chunks: list[str]) -> list[np.ndarray]:
        if len(known) > REMEMBERED_PIECES:
            known.clear()
        out = []
        for chunk in chunks:
            ids: list[int] = []
            for piece in split(chunk):
                own = known.get(piece)
                if own is None:
                    own = known[piece] = merge_piece(piece.encode("utf-8"), ranks)
                ids += own
            out.append(np.array(ids, np.uint32))
        return out

    return ChunkTable(cut_spaces, encode_all, remembered=REMEMBERED)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids`` array<int>) of each row's whole text by a rank file, each match of ``pattern`` on its own, no special tokens.

    A null or empty text gives an empty array; ids may be null or repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pattern_table(path, pattern)
        for batch in slices(batches, "text", SLICE):
            ids, offsets = table.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` (binary), in place of a column of that name: the bytes that the ids stand for; a null array gives null, an unknown id is an error."""
    tokens = tokens.drop(out_col)
    names = tokens.columns
    kind = tokens.select("*", F.lit(b"").alias(out_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        of: list = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            of[rank] = token
        def bytes_of(ids: list[int]) -> bytes:
            if ids and not 0 <= min(ids) <= max(ids) < len(of):
                raise ValueError("an id that the vocabulary has not")
            return b"".join([of[i] for i in ids])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [None if ids is None else bytes_of(ids.values.to_numpy(zero_copy_only=False).tolist()) for ids in part.column(names.index(ids_col))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*names, out_col])

    return in_batches(tokens, run, kind)
