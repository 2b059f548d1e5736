"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, features of ``BLOCK`` of them being held at once. A passage's features (byte classes, hashed byte pairs, word
statistics) go through a learned layer; gated attention, tanh times sigmoid of two more layers, weighs the passages
against each other; the weighted representation gives the document's score. All of it is learned from document labels,
on a bounded sample on the driver; every document is scored, whole, on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices
from .hashed import buffers

PASSAGE = 512
#: Labelled ids that a model is fitted on at most, each by all passages of its text, and passages of all of them together.
TRAIN_DOCS, TRAIN_PASSAGES = 6000, 100_000
#: Passages whose features are held at once.
BLOCK = 1024
PAIRS, HIDDEN, GATE = 128, 24, 12

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[32], _CLASS[10], _CLASS[128:] = 4, 5, 6
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_MARKS] = np.arange(7, 7 + len(_MARKS))
CLASSES = 7 + len(_MARKS)
DIM = CLASSES + PAIRS + 6
_SPELL = np.random.default_rng(1).integers(1, 2**62, 256)


def passages(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each passage begins and the last one ends, number of passages of each text); an empty text is one empty passage."""
    data, offsets = buffers(text)
    many = np.maximum(1, -(-np.diff(offsets) // PASSAGE))
    first = np.cumsum(many) - many
    inside = np.arange(int(many.sum())) - np.repeat(first, many)
    return data, np.append(np.repeat(offsets[:-1], many) + PASSAGE * inside, len(data)), many


def passage_features(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One row of features for each passage data[edges[i]:edges[i + 1]]; a passage's features depend on its own bytes alone."""
    total = len(edges) - 1
    sizes = np.diff(edges)
    data = data[edges[0] : edges[-1]]
    at = np.repeat(np.arange(total), sizes)
    length = np.maximum(sizes, 1)
    kinds = np.bincount(at * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES)
    wide = data.astype(np.int64)
    pair = (wide[:-1] * 31 + wide[1:] * 17 + (wide[:-1] ^ wide[1:])) % PAIRS
    same = at[:-1] == at[1:]
    pairs = np.bincount(at[:-1][same] * PAIRS + pair[same], minlength=total * PAIRS).reshape(total, PAIRS)
    inside = (data != 32) & (data != 10)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | ~same
    starts = np.flatnonzero(begins)
    extra = np.zeros((total, 6))
    count = np.ones(total)
    if len(starts):
        words = np.add.reduceat(np.where(inside, _SPELL[data], 0), starts)
        where = at[starts]
        count = np.maximum(np.bincount(where, minlength=total), 1)
        for k, lag in enumerate((1, 2, 3)):
            again = np.zeros(len(words))
            again[lag:] = (words[lag:] == words[:-lag]) & (where[lag:] == where[:-lag])
            extra[:, k] = np.bincount(where, again, minlength=total) / count
        by = np.lexsort((words, where))
        fresh = np.ones(len(words))
        fresh[1:] = (words[by][1:] != words[by][:-1]) | (where[by][1:] != where[by][:-1])
        extra[:, 3] = np.bincount(where[by], fresh, minlength=total) / count
    extra[:, 4] = np.log1p(sizes / count)
    extra[:, 5] = np.log1p(sizes)
    shares = np.sqrt(np.hstack([kinds, pairs]) / length[:, None])
    return np.hstack([shares, extra]).astype(np.float32)


def feature_blocks(data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first passage, features) of ``BLOCK`` passages at a time, so memory doesn't grow with a text."""
    for at in range(0, len(edges) - 1, BLOCK):
        yield at, passage_features(data, edges[at : at + BLOCK + 1])


class Model:
    """The learned layers; ``p`` maps names to arrays and is small and of fixed size."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def encode(self, x: np.ndarray):
        """Of each passage: standardised features, representation, the two gates, and the logarithm of its weight."""
        p = self.p
        x = (x - p["mean"]) / p["sd"]
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return x, h, t, g, (t * g) @ p["w"]

    def pool(self, h: np.ndarray, e: np.ndarray, many: np.ndarray):
        """Of each bag: its score, and what the gradient needs."""
        first = np.cumsum(many) - many
        bag = np.repeat(np.arange(len(many)), many)
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["d"], -30, 30))), bag, first, a, z

    def forward(self, x: np.ndarray, many: np.ndarray):
        x, h, t, g, e = self.encode(x)
        score, bag, first, a, z = self.pool(h, e, many)
        return score, (x, bag, first, h, t, g, a, z)

    def scores(self, text: pa.Array) -> np.ndarray:
        """The score of each whole text."""
        data, edges, many = passages(text)
        parts = [self.encode(x.astype(np.float64)) for _, x in feature_blocks(data, edges)]
        return self.pool(np.concatenate([p[1] for p in parts]), np.concatenate([p[4] for p in parts]), many)[0]

    def gradient(self, x: np.ndarray, many: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (x, bag, first, h, t, g, a, z) = self.forward(x, many)
        out = (score - label) / len(label)
        dz = out[:, None] * p["c"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ out, "d": out.sum()}


def fit(x: np.ndarray, many: np.ndarray, label: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4) -> Model:
    """Adam over batches of bags in a fixed order; without two kinds of labels, a constant score of their smoothed share."""
    rng = np.random.default_rng(7)
    share = (label.sum() + 1) / (len(label) + 2)
    p = {
        "mean": x.mean(axis=0) if len(x) else np.zeros(DIM), "sd": x.std(axis=0) + 1e-2 if len(x) else np.ones(DIM),
        "W": rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.array(np.log(share / (1 - share))),
    }
    model = Model(p)
    if len(label) == 0 or label.min() == label.max():
        return model
    first = np.cumsum(np.append(0, many))
    learnt = [k for k in p if k not in ("mean", "sd")]
    m, v, step = {k: 0.0 for k in learnt}, {k: 0.0 for k in learnt}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
            step += 1
            for k, g in model.gradient(x[rows].astype(np.float64), many[own], label[own]).items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> Model:
    """A model of at most ``train_docs`` labelled ids, those first by a hash of the id (ties: the smaller id), by all passages of their texts.

    In that order an id is left out if its rows would bring the passages of all above ``train_passages``: the bound is on
    labelled rows, every text is learnt from whole. Labels other than 0 and 1, and null ids, don't count; of an id with
    several labels the larger counts; equal rows are learnt from each.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    marked = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(train_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE)).cast("long")
    # both broadcasts are bounded by ``train_docs``
    sizes = rows.select("id", size.alias("n")).join(F.broadcast(marked), "id").groupBy("id", "label").agg(F.sum("n").alias("n")).select("id", "label", "n", F.xxhash64("id").alias("h")).collect()
    taken, left = [], train_passages
    for one in sorted(sizes, key=lambda r: (r.h, r.id)):
        if one.n <= left:
            taken.append((one.id, one.label))
            left -= one.n
    chosen = docs.sparkSession.createDataFrame(taken, "id long, label int")
    rows = rows.join(F.broadcast(chosen), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, edges, many = passages(batch.column(2))
            x = np.concatenate([part for _, part in feature_blocks(data, edges)])
            ends = np.cumsum(many)
            packed = [x[b - k : b].tobytes() for b, k in zip(ends.tolist(), many.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "label", "x"])

    got = in_batches(rows, run, "id long, label int, x binary").toArrow()
    order = np.lexsort((got["label"].to_numpy(), [hash_of(v) for v in got["x"]], got["id"].to_numpy()))
    many = np.array([len(got["x"][int(i)].as_buffer()) // (4 * DIM) for i in order], np.int64)
    x = np.empty((int(many.sum()), DIM), np.float32)
    at = 0
    for i, k in zip(order.tolist(), many.tolist()):
        x[at : at + k] = np.frombuffer(got["x"][i].as_buffer(), np.float32).reshape(k, DIM)
        at += k
    return fit(x, many, got["label"].to_numpy()[order].astype(np.float64))


def hash_of(value: pa.Scalar) -> int:
    """What orders equal ids, so that a fit doesn't depend on the order in which rows arrive."""
    return zlib.crc32(value.as_buffer())


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (double, 0 to 1) of every whole text.

    Null and empty texts are one empty passage. All rows and other columns stay; a column called ``score_col`` is
    replaced. An empty table gives an empty result.
    """
    docs = docs.drop(score_col)
    names, at = docs.columns, docs.columns.index(text_col)
    own = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*own).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    kind = plain.select("*", F.lit(0.0).alias("s")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"c{at}", 4 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(at)), pa.float64())], names=[*own, "s"])

    return in_batches(plain, run, kind).toDF(*names, score_col)
