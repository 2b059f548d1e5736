"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

The sketch of a set has ``bins`` coordinates. In round i every element is thrown into one bin by a hash of its own for
that round, with a value that is larger in every later round; a bin keeps the smallest value it saw. Rounds go on until
all bins are full: after ``bins`` random rounds, round ``bins + j`` throws every element into bin j, so every coordinate
fills whatever the set's size, and equal coordinates estimate the Jaccard similarity with the concentration of
independent draws. Bands of ``rows`` coordinates are bucket keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, materialise, slices
from .components import components

WORDS = 5
BANDS, ROWS = 32, 6
#: Members compared with one copy of a hub text in one group of the verification.
GROUP = 32

_U = np.uint64
_FULL = _U(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_BASE = _U(0x2545F4914F6CDD1D)
_PLACE = mix(np.arange(1, WORDS + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its five-word shingles; with fewer words one hash of them all; none without words."""
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    none = np.empty(0, _U)
    if first == last:
        return [none] * n
    data = np.frombuffer(text.buffers()[2], np.uint8)[first:last]
    offsets = offsets - first
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return [none] * n
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(int(starts[0]), len(data)) - np.repeat(starts, lengths)
    words = np.add.reduceat(_BYTE[data[int(starts[0]) :]] * _powers(int(lengths.max()))[place], starts - starts[0])
    words = mix(words)
    bounds = np.searchsorted(starts, offsets)
    windows = np.zeros(max(len(words) - WORDS + 1, 0), _U)
    for k in range(WORDS):
        windows += words[k : k + len(windows)] * _PLACE[k]
    windows = mix(windows)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            sets.append(np.unique(windows[a : b - WORDS + 1]))
        elif b > a:
            sets.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a)))
        else:
            sets.append(none)
    return sets


def sketches(sets: list[np.ndarray], bins: int, seed: int = 0) -> np.ndarray:
    """One row of ``bins`` coordinates for each set that isn't empty."""
    n = len(sets)
    out = np.full(n * bins, _FULL, _U)
    live = np.arange(n)
    for turn in range(2 * bins):
        if not len(live):
            break
        sizes = np.array([len(sets[i]) for i in live])
        flat = np.concatenate([sets[i] for i in live])
        h = mix(flat + mix(np.array([turn + 1], _U) * _U(0x9E3779B97F4A7C15) + _U(seed)))
        into = h % _U(bins) if turn < bins else np.full(len(h), turn - bins, _U)
        value = (_U(turn) << _U(50)) | (mix(h) >> _U(14))
        np.minimum.at(out, np.repeat(live * bins, sizes) + into.astype(np.int64), value)
        live = live[(out.reshape(n, bins)[live] == _FULL).any(axis=1)]
    return out.reshape(n, bins)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each band of ``rows`` coordinates; the band's number is part of it."""
    n, bins = sketch.shape
    bands = bins // rows
    parts = mix(sketch[:, : bands * rows].reshape(n, bands, rows))
    key = np.zeros((n, bands), _U)
    for k in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return mix(key + np.arange(1, bands + 1, dtype=_U) * _U(0xD1B54A32D192ED03)).view(np.int64)


def _signed(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("keys", pa.list_(pa.int64()))])
        for batch in slices(batches, "text", 4 << 20):
            ids = batch.column(0)
            sets = shingle_sets(batch.column(1))
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            keys: list = [[]] * len(sets)
            prints: list = [b"none%d" % (i or 0) if i is not None else b"none" for i in ids.to_pylist()]
            if len(some):
                kept = [sets[i] for i in some]
                for i, own, row in zip(some.tolist(), kept, band_keys(sketches(kept, bands * rows), rows)):
                    keys[i] = row
                    prints[i] = mix(np.array([own.sum(dtype=_U), mix(own).sum(dtype=_U) + _U(len(own))], _U)).tobytes()
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, print, keys) of (id, text): set size, fingerprint of the whole set, band keys."""
    return in_batches(docs.select("id", "text"), _signed(bands, rows), "id long, n long, print binary, keys array<long>")


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in slices(batches, "text", 4 << 20):
            a, b = [], []
            sets = shingle_sets(batch.column(3))
            for at, part, doc, mine in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sets):
                if doc == at:
                    hub, own = (at, part), mine
                elif hub == (at, part):
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if both and 100 * both >= percent * (len(own) + len(mine) - both):
                        a.append(doc)
                        b.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` (rep, hub) whose full shingle sets are similar enough.

    Texts travel to their hub; a hub with many partners goes out once for each ``GROUP`` of them, so no task holds a hot hub's whole group.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"))
    hubs = materialise(parts, "dd-hubs")
    members = pairs.join(hubs, "hub").select(F.col("rep").alias("id"), "hub", F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.lit(1).alias("many"))
    roles = members.unionByName(hubs.select(F.col("hub").alias("id"), "hub", F.lit(0).cast("long").alias("part"), F.col("parts").alias("many")))
    texts = docs.select("id", "text").join(roles, "id")
    copies = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).otherwise(F.array("part"))
    dealt = texts.select("hub", F.explode(copies).alias("part"), "id", "text")
    dealt = dealt.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))
    return in_batches(dealt, _verified(percent), "a long, b long")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        sets = shingle_sets(batch.column(1))
        ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "shingles"])


def _rare_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n, at, first): each text's rarest shingles and their places, so many that a linked text shares one.

    Of linked sets of n <= m shingles, 2 percent n / (100 + percent) of the smaller and percent m / 100 of the larger
    are shared at least. So in one common order, one of the first n - ceil(2 percent n / (100 + percent)) + 1 of the
    smaller (``first``) is among the first m - ceil(percent m / 100) + 1 of the larger. In the order of rareness among
    these texts, passages that many of them share come last.
    """
    sets = materialise(in_batches(texts.select("id", "text"), _shingled, "id long, shingles array<long>"), "dd-sets")
    flat = sets.select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key"))
    often = materialise(flat.groupBy("key").agg(F.count("*").alias("df")), "dd-often")
    ranked = flat.join(often, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("by"))
    n = F.col("n")
    rare = F.slice("by", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))
    rows = ranked.select(F.posexplode(rare).alias("at", "x"), F.col("id").alias("rep"), "n").filter("x.df > 1")
    return materialise(rows.select("x.key", "rep", "n", "at", (F.col("at") <= n - F.ceil(n * (2 * percent) / (100 + percent))).alias("first")), "dd-rare")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their present component, of the buckets that hold more than one and a member yet to be compared."""
    named = members.drop("label").join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = materialise(named, "dd-named")
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("first").alias("more")).filter("lo < hi and more").select("key")
    return materialise(named.join(materialise(mixed, "dd-mixed"), "key"), "dd-members")


def _star(members: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Compare each bucket's first member with the others; the confirmed edges, and those others."""
    hubs = members.groupBy("key").agg(F.min(F.struct("rep", "n", "label")).alias("h"), F.count("*").alias("m")).filter("m > 1")
    hubs = materialise(hubs.select("key", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.label").alias("hub_label")), "dd-buckets")
    rest = materialise(members.join(hubs, "key").filter("rep <> hub"), "dd-rest")
    near = (F.col("label") != F.col("hub_label")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    pairs = materialise(rest.filter(near).select("rep", "hub").distinct(), "dd-pairs")
    return materialise(verify(pairs, docs, percent), "dd-edges"), rest.select("key", "rep", "n", "label", F.lit(True).alias("first"))


def _stars(members: DataFrame, docs: DataFrame, percent: int, hubs_each: int) -> tuple[DataFrame, DataFrame]:
    """Compare up to ``hubs_each`` first members of each bucket with those of other components that are not smaller; the confirmed edges, and the members, these hubs no longer first.

    If this is the rarest shingle of two linked texts, what follows it in either holds all they share, so its places
    and the sizes rule out most pairs within the join.
    """
    turn = F.row_number().over(Window.partitionBy("key").orderBy("n", "rep"))
    hubs = members.filter("first").withColumn("turn", turn).filter(F.col("turn") <= hubs_each)
    hubs = materialise(hubs.select(F.col("key").alias("hub_key"), F.col("rep").alias("hub"), F.col("n").alias("hub_n"), F.col("at").alias("hub_at"), F.col("label").alias("hub_label")), "dd-buckets")
    shared = F.least(F.col("n") - F.col("at"), F.col("hub_n") - F.col("hub_at"))
    near = (
        (F.col("key") == F.col("hub_key"))
        & (F.col("label") != F.col("hub_label"))
        & (F.col("n") >= F.col("hub_n"))
        & (100 * F.col("hub_n") >= percent * F.col("n"))
        & ((100 + percent) * shared >= percent * (F.col("n") + F.col("hub_n")))
    )
    pairs = members.join(hubs, near).select(F.greatest("rep", "hub").alias("rep"), F.least("rep", "hub").alias("hub")).distinct()
    edges = materialise(verify(materialise(pairs, "dd-pairs"), docs, percent), "dd-edges")
    gone = hubs.select(F.col("hub_key").alias("key"), F.col("hub").alias("rep"), F.lit(True).alias("done"))
    return edges, members.join(gone, ["key", "rep"], "left").withColumn("first", F.col("first") & F.col("done").isNull()).drop("done")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``class_id``, ``component_id`` and ``kept``.

    Documents are linked if 100 * intersection >= percent * union of their five-word shingle sets (A-Z lower-cased;
    words are runs without ASCII white space; a text of one to four words is one shingle). Documents with equal sets
    form a class named by its smallest id; sketches of class representatives are banded, each bucket's first member is
    compared with the others on full sets, and the texts of buckets that still hold several components meet again by
    their rarest shingles, which linked texts cannot fail to share, until no such bucket is left. Links join into components named by their smallest id; ``kept`` marks that
    document. No pair of a bucket is listed beyond those with its hub.

    Null or empty texts, and texts of white space alone, have no shingles and stay alone. A null id stays alone with a
    null component and is kept. Repeated ids count as one document for links, and each row returns. Other columns are
    ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(signatures(docs), "dd-signed")
    classes = signed.filter("n > 0 and id is not null").groupBy("print").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min_by("keys", "id").alias("keys"))
    classes = materialise(classes, "dd-classes")
    members = classes.select(F.explode("keys").alias("key"), "rep", "n", F.col("rep").alias("label"))
    edges, rest = _star(members, docs, percent)
    found = [edges]
    labels = components(edges)
    open_ = _open(rest, labels)
    if not open_.isEmpty():
        again = materialise(open_.select(F.col("rep").alias("id")).distinct(), "dd-again")
        texts = materialise(docs.join(again, "id", "left_semi").dropDuplicates(["id"]), "dd-texts")
        open_, hubs_each = _open(_rare_shingles(texts, percent), labels), 64
        while not open_.isEmpty():
            edges, rest = _stars(open_, texts, percent, hubs_each)
            if not edges.isEmpty():
                found.append(edges)
                labels = components(reduce(DataFrame.unionByName, found))
            open_, hubs_each = _open(rest, labels), 16 * hubs_each
    named = classes.select("print", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left")
    named = materialise(named.select("print", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id")), "dd-final")
    out = signed.select("id", "n", "print").join(named, "print", "left")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(alone, F.lit(True)).otherwise(F.col("id") == F.col("component_id")), F.lit(True)).alias("kept"),
    )
