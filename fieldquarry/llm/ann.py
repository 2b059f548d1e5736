"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Vectors of a tile become int8 by a scale of their own. The integer product of two of them, times both scales, misses
the true product by at most |e_a| |b| + |a'| |e_b| (e: what rounding took from a vector, a': its rounded form), so each
distance has a lower and an upper bound. Pairs whose lower bound exceeds the query's k-th upper bound cannot be among
its k nearest; the others are computed in double precision and go through a heap of size k for each query.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from .blocks import block_search, usable


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm of what rounding took) of each row."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def int8_tile(k: int):
    def prepare(ids: np.ndarray, x: np.ndarray):
        """The codes of a tile, made once for all its queries."""
        xc, xs, xe = quantise(x)
        xn, n = np.linalg.norm(x, axis=1), len(x)
        # sums of products of int8 are exact in single precision up to 1,040 dimensions
        exact = np.float32 if x.shape[1] <= 1040 else np.float64
        codes = xc.astype(exact).T
        top = np.abs(x).max()

        def tile(q_ids: np.ndarray, q: np.ndarray, held: np.ndarray):
            most = max(top, np.abs(q).max())
            if not 1e-100 < most < 1e100:
                # squares would leave the range of doubles: a power of two scales without rounding
                unit = 2.0 ** np.floor(np.log2(most))
                found = int8_tile(k)(ids, x / unit)(q_ids, q / unit, held / unit)
                return found[0], found[1], found[2] * unit
            qc, qs, qe = quantise(q)
            m, qn = len(q), np.linalg.norm(q, axis=1)
            product = (qc.astype(exact) @ codes).astype(np.float64) * qs[:, None] * xs[None, :]
            error = qe[:, None] * xn[None, :] + (qn + qe)[:, None] * xe[None, :]
            middle = qn[:, None] ** 2 + xn[None, :] ** 2 - 2 * product
            slack = 2 * error + 1e-9 * (qn[:, None] + xn[None, :]) ** 2
            own = q_ids[:, None] == ids[None, :]
            upper = np.where(own, np.inf, middle + slack)
            bar = np.partition(upper, k - 1, axis=1)[:, k - 1] if n > k else np.full(m, np.inf)
            bar = np.minimum(bar, held**2 * (1 + 1e-9))
            asked, cand = np.nonzero((middle - slack <= bar[:, None]) & ~own)
            score = np.concatenate([np.sqrt(((q[asked[a : a + 65536]] - x[cand[a : a + 65536]]) ** 2).sum(axis=1)) for a in range(0, len(asked), 65536)] or [np.empty(0)])
            out_q, out_v, out_s = [], [], []
            ends = np.searchsorted(asked, np.arange(m + 1))
            for i in range(m):
                a, b = ends[i], ends[i + 1]
                for s, v in heapq.nsmallest(k, zip(score[a:b].tolist(), ids[cand[a:b]].tolist())):
                    out_q.append(q_ids[i])
                    out_v.append(v)
                    out_s.append(s)
            return np.array(out_q, np.int64), np.array(out_v, np.int64), np.array(out_s, np.float64)

        return tile

    return prepare


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score double): each query's k smallest Euclidean distances, in double precision.

    ``is_query`` is a condition over ``id``, a column or SQL. All rows but the query's own are candidates, ties go to the smaller
    id, and all candidates return where there are fewer than k: the bounds make the search exact. Rows with a null id,
    or a vector that is null, empty, zero or holds null or non-finite components, take no part; other columns are
    ignored. Of several rows with one id that of the smallest vector counts; equal vectors of different ids are candidates
    each, at distance 0. Vectors of another dimension than the query's are not its candidates. A table without queries or
    without candidates gives no rows.
    """
    return block_search(usable(vectors, id_col, vector_col, zero=False), is_query, k, int8_tile(k), "double", ascending=True)
