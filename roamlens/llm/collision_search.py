"""Nearest neighbours by collision-counting hashing.

Every vector is projected on random orthonormal directions; each direction keeps its
projections as a sorted array.  Around a query's own projection a window opens in
every array; virtual rehashing widens all windows by a factor until enough vectors
lie in the windows of at least a threshold of directions.  Those vectors are verified
with the exact inner product.

Largest inner products become smallest distances by one more coordinate that lifts
all vectors to the same length, so vectors of any norm can be searched.

The table is dealt into segments, each with its own arrays, and the queries into
blocks; a task holds one segment and one block, both of bounded size.  Equal vectors
of a segment are one entry with their smallest ids, so a vector that a third of the
rows share neither fills the windows nor a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.llm.common import materialise

NEIGHBOURS = 20
#: Directions, the share of them a candidate must collide in, and the share of a
#: segment that must be candidates before its windows stop growing.
DIRECTIONS = 64
THRESHOLD = 0.56
CANDIDATES = 0.4
#: First half-width of a window, against the spread of the projections, and its growth.
WIDTH, GROWTH = 0.85, 1.1
SEED = 4021
#: Rows of a segment: this share of the table within these bounds.  Queries of a block:
#: the table is copied, and its arrays built, once for each block, so blocks are large.
SEGMENT_SHARE, SEGMENT_ROWS, BLOCK_ROWS = 8, (4_096, 65_536), 16_384


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def directions(dim: int, m: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    """``m`` random directions, orthonormal in runs of ``dim``, scaled to unit variance."""
    rng, out = np.random.default_rng(seed), []
    while sum(map(len, out)) < m:
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q.T)
    return np.concatenate(out)[:m] * np.sqrt(dim)


class Segment:
    """Sorted projections of some vectors, by direction."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, axes: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, entry = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        entry = entry.ravel()
        self.vectors = vectors[first]
        # The k + 1 smallest ids of each distinct vector.
        by = np.argsort(entry, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(entry[by], entry[by])
        near = rank <= k
        self.ids = np.split(ids[by][near], np.flatnonzero(np.diff(entry[by][near])) + 1)
        norm2 = (self.vectors ** 2).sum(1)
        lift = np.sqrt(np.maximum(top * top - norm2, 0.0))
        self.axes, self.k, self.top = axes, k, top
        place = np.concatenate((self.vectors, lift[:, None]), 1) @ axes.T
        self.order = np.argsort(place, axis=0, kind="stable").T.astype(np.intp).copy()
        self.unit = float(np.sqrt((place ** 2).mean())) or 1.0
        # All sorted arrays in one, each moved above the one before.
        step = 4 * np.abs(place).max() + 8 * self.unit
        self.shift = step * np.arange(len(axes))
        self.sorted = (np.take_along_axis(place, self.order.T, 0).T + self.shift[:, None]).ravel()

    def candidates(self, query: np.ndarray, threshold: int, enough: int) -> np.ndarray:
        """Entries that collide with the query in ``threshold`` directions, the windows
        being widened until there are ``enough`` of them."""
        n, m = len(self.vectors), len(self.axes)
        if enough >= n:
            return np.arange(n)
        # A query's length changes no order: the longest one tells vectors apart best.
        at = np.append(query * (self.top / np.sqrt((query ** 2).sum())), 0.0) @ self.axes.T + self.shift
        own = n * np.arange(m)
        flat, width, counts = self.order.ravel(), WIDTH * self.unit, np.zeros(n, np.int64)
        lo = hi = np.clip(np.searchsorted(self.sorted, at), own, own + n)
        while True:
            new_lo = np.maximum(np.searchsorted(self.sorted, at - width), own)
            new_hi = np.minimum(np.searchsorted(self.sorted, at + width, "right"), own + n)
            parts = [flat[a:b] for a, b in zip(new_lo, lo) if a < b] + [flat[a:b] for a, b in zip(hi, new_hi) if a < b]
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=n)
            found = np.flatnonzero(counts >= threshold)
            if len(found) >= enough or (new_hi - new_lo).min() == n:
                return found
            lo, hi, width = new_lo, new_hi, width * GROWTH

    def search(self, query: np.ndarray, threshold: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k + 1 best verified rows, best first."""
        found = self.candidates(query, threshold, max(self.k + 1, int(np.ceil(share * len(self.vectors)))))
        close = self.vectors[found] @ query
        if len(found) > self.k + 1:  # those that rounding may still put among the best
            slack = 1e-9 * self.top * float(np.sqrt((query ** 2).sum()))
            found = found[close >= np.partition(close, -self.k - 1)[-self.k - 1] - slack]
        # Row by row in one order of summation: equal vectors get equal products everywhere.
        score = (self.vectors[found] * query).sum(1)
        ids = np.concatenate([self.ids[e] for e in found])
        score = np.repeat(score, [len(self.ids[e]) for e in found])
        best = np.lexsort((ids, -score))[:self.k + 1]
        return ids[best], score[best]


def search_group(key, rows, queries, top: float, axes: np.ndarray, k: int, threshold: float, share: float):
    """All queries of a block against a segment: query_id, vec_id, score."""
    import pyarrow as pa

    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        def matrix(t):
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.astype(float).reshape(t.num_rows, -1)

        segment = Segment(rows.column("id").to_numpy(), matrix(rows), top, axes, k)
        ids = queries.column("id").to_numpy()
        distinct, first, of = np.unique(matrix(queries), axis=0, return_index=True, return_inverse=True)
        least = int(np.ceil(threshold * len(axes)))
        found = [segment.search(q, least, share) for q in distinct]
        for q, e in zip(ids, of.ravel()):
            i, s = found[e]
            other = i != q
            out.append((np.full(int(other.sum()), q), i[other], s[other]))
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                     "score": pa.array(cols[2], pa.float64())})


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding",
            m: int = DIRECTIONS, threshold: float = THRESHOLD, share: float = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each
    row for which ``is_query`` holds, ties to the smaller id.

    Rows with a null id, an unusable vector or another length than most take no part;
    rows with the query's own id are no candidates, repeated ids are single rows of
    the result (of an id asked for with several vectors the smallest asks); other
    columns are not read."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"),
                          F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = materialise(rows.withColumn("norm", norm).withColumn("dim", F.size("v")), "vectors")
    dim = (rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("nq"), F.max("norm").alias("top"))
           .orderBy(F.desc("n"), "dim").first())
    empty = "query_id long, rank int, vec_id long, score double"
    if dim is None:
        return vectors.sparkSession.createDataFrame([], empty)
    size, top = dim["dim"], float(dim["top"])
    axes = directions(size + 1, min(m, 4 * (size + 1)))
    in_segment = min(max(dim["n"] // SEGMENT_SHARE, SEGMENT_ROWS[0]), SEGMENT_ROWS[1])
    segments, blocks = max(1, -(-dim["n"] // in_segment)), max(1, -(-dim["nq"] // BLOCK_ROWS))
    rows = rows.filter(F.col("dim") == size)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    data = rows.select("id", "v", F.pmod(F.xxhash64("id", "norm"), F.lit(segments)).alias("segment"), every(blocks).alias("block"))
    asked = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select("id", "v", F.pmod(F.xxhash64(F.lit(SEED), F.col("id")), F.lit(blocks)).alias("block"),
                         every(segments).alias("segment"))
    fn = lambda key, a, b: search_group(key, a, b, top, axes, k, threshold, share)
    found = data.groupBy("segment", "block").cogroup(asked.groupBy("segment", "block")).applyInArrow(
        fn, "query_id long, vec_id long, score double")
    # At most k + 1 rows of each segment for each query.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
