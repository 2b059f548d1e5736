"""The prefix trie of conversations, by adaptive radix trees over sorted blocks of keys.

A turn's id is 16 bytes of the SHA-256 of its role and text, so a conversation is a key of fixed-width ids and its prefixes
are the key's at turn-aligned depths. Keys are range-partitioned by themselves and the conversation's id, so thousands of
copies of one conversation, or a first turn that a third share, go to as many tasks as others. A task builds a tree of
each block of its keys. Nodes that are no prefix of the block's first or last key have all their members in it: they are
emitted. The others, on these two paths, become two records of what the block adds to them; records of all blocks are
sorted and cut into blocks again, until one block is left. Each level is a written table and divides the number of
records by at least half of ``LEAST``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_batches, materialise
from .radix import Node, Tree

#: Bytes of a turn's id; bytes of a block's keys and their arrays, and records that a block holds at least.
WIDTH, BLOCK_BYTES, LEAST = 16, 32 << 20, 64

_RECORD = "key binary, conv_id long, sizes array<long>, n array<long>, first array<long>, kids array<long>, leaves array<long>, saved array<long>"
_OUT = f"kind int, depth long, parent_conv_id long, parent_link string, link string, ref binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, {_RECORD}"
_PA = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_COLUMNS = [tuple(c.split()) for c in _OUT.split(", ")]
NODE, PATH, ENDS, EDGE = range(4)


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of the role's length, the role and the text."""
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", F.char_length(role).cast("string"), role, text).cast("binary"), 256), 1, 2 * WIDTH))


def rebuilt(turns: DataFrame, group: int, longest: int) -> DataFrame:
    """(conv_id, key, sizes) of every conversation as rebuilt: the start of its group's first, then its own turns.

    Conversation c takes the first h turns of conversation c - c % ``group`` (none if it is absent) and its own after the
    first h, h = crc32(c in decimals) % ``longest``. Turns are in order of ``turn``, null first, ties by role and text, null
    ones empty; rows without a conversation take no part.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("t"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("r"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("x"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("t").asc_nulls_first(), "r", "x"))
    own = own.filter("conv_id is not null").select("conv_id", F.struct(place.alias("place"), turn_id(F.col("r"), F.col("x")).alias("id"), F.octet_length("x").cast("long").alias("size")).alias("turn"))
    own = materialise(own.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")), "turns")
    base = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest).alias("start"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    all_ = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left").withColumn("h", h)
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.coalesce(F.slice("start", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns")))
    ids = F.aggregate("turns", F.lit("").cast("binary"), lambda key, turn: F.concat(key, turn["id"]))
    return all_.select("conv_id", turns.alias("turns")).select("conv_id", ids.alias("key"), F.transform("turns", lambda turn: turn["size"]).alias("sizes"))


class _Open:
    """A turn-aligned node while its subtree is read."""

    __slots__ = ("depth", "rep", "low", "high", "n", "first", "kids", "leaves", "saved", "ends", "waiting", "name")

    def __init__(self, depth: int, rep: int, low: bool, high: bool):
        self.depth, self.rep, self.low, self.high = depth, rep, low, high
        self.n = self.kids = self.leaves = self.saved = 0
        self.first, self.ends, self.waiting, self.name = None, [], [], None


def _nodes(records: list[dict], tag: str, whole: bool, upper: bool) -> Iterator[dict]:
    """Rows of a block's nodes, and of what it adds to nodes it shares with other blocks (none if it is the ``whole``).

    ``upper``: the records are of earlier blocks' paths, so conversations' ends are counted already.
    """
    tree = Tree()
    for i, r in enumerate(records):
        tree.insert(r["key"], i)
    lo, hi = records[0]["key"], records[-1]["key"]
    low_path: dict[int, _Open] = {}
    high_path: dict[int, _Open] = {}

    def name(v: _Open) -> bytes:
        if v.name is None:
            v.name = hashlib.sha256(records[v.rep]["key"][: WIDTH * v.depth]).digest()[:WIDTH]
        return v.name

    def ends_of(v: _Open) -> str:
        return ",".join(map(str, sorted(v.ends)))

    def close(v: _Open, parent: _Open | None) -> Iterator[dict]:
        shared = not whole and (v.low or v.high)
        if shared:
            (low_path if v.low else high_path)[v.depth] = v
            yield {"kind": EDGE, "ref": name(v), "link": tag + name(v).hex()}
            if v.ends:
                yield {"kind": ENDS, "ref": name(v), "conv_id": min(v.ends), "ends": ends_of(v)}
        else:
            size = records[v.rep]["sizes"][v.depth - 1] if v.depth else 0
            v.leaves += v.kids == 0
            v.saved += (v.n - 1) * size
            row = {"kind": NODE, "conv_id": v.first, "depth": v.depth, "n_convs": v.n, "n_children": v.kids, "n_leaves": v.leaves, "saved_tokens": v.saved}
            row |= {"ref": name(v)} if upper else {"ends": hashlib.sha256(ends_of(v).encode()).hexdigest()}
            if parent is None:
                yield row
            else:
                parent.waiting.append(row)
                parent.n, parent.kids, parent.leaves, parent.saved = parent.n + v.n, parent.kids + 1, parent.leaves + v.leaves, parent.saved + v.saved
                parent.first = v.first if parent.first is None else min(parent.first, v.first)
        for row in v.waiting:
            yield row | ({"parent_link": tag + name(v).hex()} if shared else {"parent_conv_id": v.first})
        v.waiting = []

    stack = [_Open(0, 0, True, True)]

    def enter(node: Node, end: int) -> int:
        """Open the turn-aligned depths that ``node``, whose path ends at byte ``end``, reaches; returns how many."""
        key, opened = records[node.any]["key"], 0
        for depth in range((end - len(node.path)) // WIDTH + 1, end // WIDTH + 1):
            a, b = WIDTH * (depth - 1), WIDTH * depth
            up, own = stack[-1], key[a:b]
            stack.append(_Open(depth, node.any, up.low and own == lo[a:b], up.high and own == hi[a:b]))
            opened += 1
        for i in node.ends:
            r = records[i]
            for at, v in enumerate(stack) if r["n"] is not None else [(0, stack[-1])]:
                n, first, kids, leaves, saved = (r[c][at] for c in ("n", "first", "kids", "leaves", "saved")) if r["n"] is not None else (1, r["conv_id"], 0, 0, 0)
                v.n, v.kids, v.leaves, v.saved = v.n + n, v.kids + kids, v.leaves + leaves, v.saved + saved
                if first is not None:
                    v.first = first if v.first is None else min(v.first, first)
            if not upper:
                stack[-1].ends.append(r["conv_id"])
        return opened

    # an explicit stack of (node's children left, depths opened): tries may be deep
    walk = []
    node, end = tree.root, 0
    opened = enter(node, 0)
    walk.append((iter(node.children.items() if node.children else ()), opened, 0))
    while walk:
        children, opened, end = walk[-1]
        step = next(children, None)
        if step is not None:
            node = step[1]
            end += len(node.path)
            opened = enter(node, end)
            walk.append((iter(node.children.items() if node.children else ()), opened, end))
            continue
        walk.pop()
        for _ in range(opened):
            v = stack.pop()
            yield from close(v, stack[-1])
    yield from close(stack[0], None)

    for path, key, at in ((low_path, lo, 0), (high_path, hi, -1)):
        if path:
            # what both paths share is the low one's; the high one adds nothing there
            steps = [path.get(d) for d in range(len(key) // WIDTH + 1)]
            of = lambda c: [0 if v is None else getattr(v, c) for v in steps]
            yield {"kind": PATH, "key": key, "sizes": records[at]["sizes"][: len(steps) - 1], "n": of("n"), "first": [v and v.first for v in steps]} | {c: of(c) for c in ("kids", "leaves", "saved")}


def _level(rows: DataFrame, number: int, whole: bool, least: int, block_bytes: int) -> DataFrame:
    """One level's output, written: rows of ``_OUT`` from sorted blocks of each partition."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                size += len(r["key"]) + 8 * len(r["sizes"]) * (6 if number else 1) + 200
                if not whole and size >= block_bytes and len(held) >= least:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _PA[t]) for c, t in _COLUMNS], [c for c, _ in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for at, records in enumerate(blocks(batches)):
            out, size = [], 0
            for row in _nodes(records, f"{number}.{part}.{at}.", whole, number > 0):
                out.append(row)
                size += 100 + 48 * len(row.get("n") or ()) + len(row.get("ends") or "")
                if len(out) >= 10_000 or size > 4 << 20:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

    return materialise(in_batches(rows, run, _OUT), "trie")


def _sorted_blocks(rows: DataFrame, parts: int | None) -> DataFrame:
    spread = rows.repartitionByRange(*([parts] if parts else []), "key", "conv_id")
    return spread.sortWithinPartitions("key", "conv_id")


def _one_block(rows: DataFrame) -> DataFrame:
    return rows.coalesce(1).sortWithinPartitions("key", "conv_id")


def prefix_trie(keys: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Nodes of the trie of (conv_id, key, sizes): key of 16-byte turn ids, sizes the turns' bytes.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each distinct
    prefix of ``depth`` turns, the empty one included: its smallest member, the parent's, its members and children, the
    childless nodes of its subtree, the subtree's bytes that sharing saves, and the SHA-256 of the ids, in ascending
    order and joined by commas, of the conversations that end there. Equal keys are members of one node; conversations
    without turns are members of the root; a conversation's key must fit a row (2 GiB: 10^8 turns). No rows, no nodes.
    """
    blank = [F.lit(None).cast("array<long>").alias(c) for c in ("n", "first", "kids", "leaves", "saved")]
    rows, number, levels, parts, before, least = keys.select("key", "conv_id", "sizes", *blank), 0, [], None, None, max(least, 8)
    while True:
        out = _level(_sorted_blocks(rows, parts), number, False, least, block_bytes)
        levels.append(out)
        rows = out.filter(F.col("kind") == PATH).select("key", "conv_id", "sizes", "n", "first", "kids", "leaves", "saved")
        left = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("key") * 4), F.lit(0)).alias("size")).first()
        number += 1
        # one block is left, and with it every node; so it is where partitions are too many for records to become fewer
        if left.rows <= 2 * least or left.size + 200 * left.rows <= block_bytes or (before and 2 * left.rows > before):
            levels.append(_level(_one_block(rows), number, True, least, block_bytes))
            break
        before = left.rows
        parts = -(-left.rows // (4 * least))
    everything = levels[0]
    for out in levels[1:]:
        everything = everything.unionByName(out)
    nodes = everything.filter(F.col("kind") == NODE)
    # nodes closed above the first level have a name; each block that shares one is told its smallest member
    closed = nodes.filter("ref is not null")
    told = everything.filter(F.col("kind") == EDGE).select("ref", "link").join(closed.select("ref", F.col("conv_id").alias("up")), "ref").select(F.col("link").alias("parent_link"), "up")
    nodes = nodes.join(told, "parent_link", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    hashes = _joined_hashes(everything.filter(F.col("kind") == ENDS).select("ref", "conv_id", "ends"))
    empty = hashlib.sha256(b"").hexdigest()
    nodes = nodes.join(hashes, "ref", "left").withColumn("ends_sha256", F.coalesce("ends", "joined", F.lit(empty)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _joined_hashes(pieces: DataFrame) -> DataFrame:
    """(ref, joined): the SHA-256 of each node's pieces of ids, which blocks gave, in order: a running hash, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running, refs, sums = None, None, [], []
        for batch in batches:
            for ref, ends in zip(batch.column("ref").to_pylist(), batch.column("ends").to_pylist()):
                if ref != at:
                    if at is not None:
                        refs.append(at)
                        sums.append(running.hexdigest())
                    at, running = ref, hashlib.sha256(ends.encode())
                else:
                    running.update(b"," + ends.encode())
        if at is not None:
            refs.append(at)
            sums.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(refs, pa.binary()), pa.array(sums, pa.string())], ["ref", "joined"])

    return in_batches(pieces.repartition("ref").sortWithinPartitions("ref", "conv_id"), run, "ref binary, joined string")
