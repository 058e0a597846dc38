"""Sums of word vectors over blocks of documents.

A join of every (document, word) pair with its word's vector shuffles a vector for each
pair.  Here the documents go to blocks of about ``BLOCK`` tokens, and a block gets what is
known of each of its distinct words once; the sums are taken there, a bounded run of
pairs at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.session import ship_package

#: Tokens of a block, and pairs that are multiplied at once.
BLOCK, AT_ONCE = 1 << 22, 1 << 17


def ends(lists) -> np.ndarray:
    """Offsets of the lists of an Arrow array in its flattened values."""
    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)


def runs(rows: pa.Array, upto: np.ndarray, size: int):
    """``rows`` in slices of about ``size``, or one row; ``upto`` is what stands before each row and after the last."""
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + size, "right")) - 1)
        yield rows.slice(lo, hi - lo)
        lo = hi


def one(column) -> pa.Array:
    """A table's column as one array."""
    return column.combine_chunks() if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def counted(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, by ``a``, and how often each comes."""
    pair, n = np.unique(a * max(n_b, 1) + b, return_counts=True)
    return pair // max(n_b, 1), pair % max(n_b, 1), n


def weighted_sums(to: np.ndarray, row: np.ndarray, weight: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``weight * vectors[row]`` for each ``to`` (ascending) below ``n``."""
    out = np.zeros((n, vectors.shape[1]))
    for at in range(0, len(to), AT_ONCE):
        t = to[at:at + AT_ONCE]
        starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        out[t[starts]] += np.add.reduceat(vectors[row[at:at + AT_ONCE]] * weight[at:at + AT_ONCE, None], starts)
    return out


def by_block(docs: DataFrame, words: str, facts: Callable[[DataFrame], DataFrame], fn: Callable, schema: str, size: int = BLOCK) -> DataFrame:
    """``fn(documents, facts)`` (Arrow tables) for each block of ``docs``, of about ``size`` tokens.  ``facts`` turns
    the distinct (``__b``, ``word``) of all blocks into rows with what is known of the word."""
    ship_package(docs.sparkSession)
    some = docs.filter(F.size(words) > 0)
    n = some.agg(F.greatest(F.ceil(F.sum(F.size(words)) / size).cast("long"), F.lit(1).cast("long"))).scalar()
    some = some.withColumn("__b", F.pmod(F.xxhash64(*docs.columns), n))
    need = some.select("__b", F.explode(words).alias("word")).filter("word IS NOT NULL").distinct()
    known = facts(need).withColumnRenamed("__b", "__f")  # a name of its own: both sides come from the documents
    return some.groupBy("__b").cogroup(known.groupBy("__f")).applyInArrow(fn, schema)
