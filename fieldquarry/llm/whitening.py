"""Whitening of embeddings by a weighted multiplicity covariance.

Equal integer vectors become one with their number as its weight, so a vector that a third of all rows share is one row
of every product. Weighted sums, then products of centred blocks, are added up by partitions; only a matrix of the
dimension's square is met by the driver, which takes its eigenvectors. Each distinct vector is whitened once, in a written
table, whose weighted covariance gives the measured error; rows then take their vector's result. Vectors that more than
one in ``HOT`` rows share are fewer than ``HOT``, so these are broadcast and no other key of the join is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, materialise

#: Vectors that at least one in so many rows share are joined apart; at most so many exist.
HOT = 1000
#: Eigenvalues of at most this share of the largest are rounding.
RANK = 1e-11


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def integers(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, d, x array<long>) of rows whose vector has d finite components only: floor(scale * c) + shift, null where that is beyond 2**60."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("size(v) > 0")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # Spark may look at x before it drops a row, so x must be safe for any c
    x = F.transform("v", lambda c: F.when(F.abs(c) < 2.0**60 / scale, F.floor(c * scale) + shift))
    return rows.filter(~F.coalesce(bad, F.lit(True))).select("id", F.size("v").alias("d"), x.alias("x"))


def summed(df: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``block``'s (rows, width) matrices over all batches of a frame: one partial sum a task, added row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = block(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = in_batches(df, run, "i int, row array<double>")

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"i": group["i"][:1], "row": pa.array([np.array(group["row"].to_pylist()).sum(axis=0)], pa.list_(pa.float64()))})

    rows = {r.i: r.row for r in parts.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()}
    return np.array([rows[i] for i in range(len(rows))]).reshape(len(rows), width)


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and leading component.

    Components of vectors become x = floor(scale * c) + shift. Rows whose vector is null, empty or holds null or
    non-finite entries take no part, nor those of another dimension than the most frequent (of several, the smallest);
    null and repeated ids are rows like others, other columns are ignored, and a table without usable rows gives none. The fit
    is over all n rows left, divisor n. ``deviation`` is the exact sum of (n*x - S)^2 over dimensions (S: sums), an error
    where it passes 64 bits. Components are numbered by falling eigenvalue, the largest entry of each positive; those whose
    variance is rounding only (equal vectors, or fewer rows than components) are left out. ``identity_error`` is
    measured on the whitened vectors.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, scale, shift, id_col, vector_col)
    sized = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    schema = f"`{id_col}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sized is None:
        return spark.createDataFrame([], schema)
    d, n = sized.d, sized.n
    rows = rows.filter(F.col("d") == d)
    distinct = materialise(rows.groupBy("x").agg(F.count("*").alias("w")), "vectors")
    sums = distinct.select("w", F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("w").cast("decimal(38,0)") * F.col("c")).alias("s"), F.max(F.abs("c")).alias("most"), F.max(F.col("c").isNull()).alias("beyond")).collect()
    if any(r.beyond for r in sums):
        raise OverflowError("components pass 60 bits")
    exact = {r.i: int(r.s) for r in sums}
    if n * max(int(r.most) for r in sums) >= 2**62:
        raise OverflowError("sums of components pass 64 bits")
    total = np.array([exact[i] for i in range(d)], np.int64)

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        """n*x - S, exact."""
        return _matrix(batch, "x") * n - total

    def products(batch: pa.RecordBatch) -> np.ndarray:
        c = centred(batch) / n
        return (c * batch.column("w").to_numpy()[:, None]).T @ c

    v = summed(distinct, products, d) / n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:components] > max(values[0] * RANK, 0.0)).sum())
    if not kept:
        return spark.createDataFrame([], schema)
    values, axes, trace = values[:kept], axes[:, :kept], float(np.trace(v))
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    project = axes / np.sqrt(values)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = centred(batch)
            if d * float(np.abs(c).max()) ** 2 >= 2.0**62:
                squares = [sum(int(a) ** 2 for a in row) for row in c]
                if max(squares) >= 2**63:
                    raise OverflowError("a deviation passes 64 bits")
            else:
                squares = (c * c).sum(axis=1)
            y = (c / n) @ project
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("w"), pa.array(squares, pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], ["x", "w", "deviation", "y"])

    white = materialise(in_batches(distinct, each, "x array<long>, w long, deviation long, y array<double>"), "white")

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        y, w = _matrix(batch, "y"), batch.column("w").to_numpy()[:, None]
        return np.vstack([(y * w).T @ y, (y * w).sum(axis=0)])

    moments = summed(white, spread, kept) / n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(kept)).max())

    hot = F.broadcast(white.filter(F.col("w") * HOT > n).select("x", "deviation", "y"))
    cold = white.filter(F.col("w") * HOT <= n).select("x", "deviation", "y")
    met = rows.join(hot, "x").unionByName(rows.join(hot.select("x"), "x", "left_anti").join(cold, "x"))
    share = F.array(*[F.lit(float(e) / trace) for e in values])
    out = met.select("id", "deviation", F.posexplode("y").alias("c", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("c") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
