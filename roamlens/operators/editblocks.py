"""Edit distances over blocks of texts: exact, for texts so alike
that no index key tells them apart.

Queries and choices are dealt to blocks, and every pair of blocks is one group of a
cogroup: a group's size is bounded, whatever the tables hold.  In a group the choices are
walked as a trie, so a prefix that several share is compared once, and each step moves the
whole column of the edit matrix as bits of one word (Myers 1999; longer patterns take
several words), for many queries and all nodes of a depth at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.session import ship_package

#: Texts that are walked as one trie, and pairs of a node and a query that are moved on at once.
TRIE_TEXTS, AT_ONCE = 4096, 1 << 18


# ------------------------------------------------------------------ the distances
def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins (one entry more)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def _trie(texts: list[str]) -> tuple[np.ndarray, list]:
    """The letters of ascending distinct texts, and for each depth: the letter of each
    node, its parent's place, the texts that end there and their nodes."""
    flat, at = _codes(texts)
    letters, code = np.unique(flat, return_inverse=True)
    size, levels = np.diff(at), []
    active, node, differs = np.flatnonzero(size > 0), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    differs[:1] = True
    depth = 0
    while len(active):
        here = code[at[active] + depth]
        # a text parts from the one before it where their letters differ or that one has ended
        new = differs[active]
        new[0] = True
        new[1:] |= (here[1:] != here[:-1]) | (active[1:] != active[:-1] + 1)
        differs[active] = new
        parent, starts = node[active], np.flatnonzero(new)
        node[active] = np.cumsum(new) - 1
        ended = active[size[active] == depth + 1]
        levels.append((here[starts], parent[starts], ended, node[ended]))
        active, depth = active[size[active] > depth + 1], depth + 1
    return letters, levels


def _walk(patterns: list[str], letters: np.ndarray, levels: list, n: int, kind: type) -> np.ndarray:
    """Distances of the ``n`` texts of a trie (rows) and patterns of as many words."""
    bits, k = np.dtype(kind).itemsize * 8, len(patterns)
    flat, at = _codes(patterns)
    size = np.diff(at)
    words = int(-(-size.max() // bits))
    of = np.repeat(np.arange(k), size)
    place = np.arange(len(flat)) - at[of]
    found = np.minimum(np.searchsorted(letters, flat), len(letters) - 1)
    known = letters[found] == flat
    match = np.zeros((words, len(letters), k), kind)
    np.bitwise_or.at(match, (place[known] // bits, found[known], of[known]), np.left_shift(kind(1), (place[known] % bits).astype(kind)))
    one, last = kind(1), ((size - 1) % bits).astype(kind)
    up, down = [np.full((1, k), ~kind(0), kind) for _ in range(words)], [np.zeros((1, k), kind) for _ in range(words)]
    score, out = size[None].astype(np.int32), np.empty((n, k), np.int32)
    for letter, parent, ended, node in levels:
        score = score[parent]
        rise, fall = one, None  # the first row of the matrix grows by one for each letter
        for w in range(words):
            eq, pv, mv = match[w][letter], up[w][parent], down[w][parent]
            xv = eq | mv
            if fall is not None:
                eq |= fall
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if w == words - 1:
                score += ((ph >> last) & one).astype(np.int32)
                score -= ((mh >> last) & one).astype(np.int32)
            carry = (ph >> kind(bits - 1), mh >> kind(bits - 1)) if w < words - 1 else None
            ph <<= one
            ph |= rise
            mh <<= one
            if fall is not None:
                mh |= fall
            np.bitwise_or(xv, ph, out=pv)
            np.invert(pv, out=pv)
            pv |= mh
            up[w], down[w] = pv, ph & xv
            if carry:
                rise, fall = carry
        out[ended] = score[node]
    return out


def distances(patterns: list[str], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edit distances of all pairs, a bounded number at a time: places of some patterns,
    and a matrix with a row for each text and a column for each of these.  No text is empty."""
    if not patterns or not texts:
        return
    distinct, back = np.unique(np.array(texts, object), return_inverse=True)
    parts = [(a, _trie(distinct[a:a + TRIE_TEXTS].tolist())) for a in range(0, len(distinct), TRIE_TEXTS)]
    size = np.fromiter(map(len, patterns), np.int64, len(patterns))
    order, kinds = np.argsort(size, kind="stable"), np.where(size <= 32, 0, -(-size // 64))
    step = max(1, AT_ONCE // min(len(distinct), TRIE_TEXTS))
    for k in np.unique(kinds):
        same = order[kinds[order] == k]
        for a in range(0, len(same), step):
            some = same[a:a + step]
            names = [patterns[i] for i in some]
            d = np.concatenate([_walk(names, *trie, min(TRIE_TEXTS, len(distinct) - b), np.uint64 if k else np.uint32) for b, trie in parts])
            yield some, d if len(distinct) == len(texts) and (back[1:] > back[:-1]).all() else d[back]


def scores(distance: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """The similarity of ``functions.similarity``: 100 less the share of edits, half up."""
    return np.floor(100.0 * (1.0 - distance / longer) + 0.5).astype(np.int32)


# ------------------------------------------------------------------ one group
def _strings(column) -> list[str]:
    return column.to_pylist()


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _result(q: pa.Table, c: pa.Table, out: list[str], found: list[tuple]) -> pa.Table:
    """The rows of (query, choice, score) places, with the columns ``out``."""
    i, j, s = (np.concatenate([f[x] for f in found] or [np.zeros(0, np.int64)]) for x in range(3))
    have = {**{n: q[n] for n in q.column_names}, **{n: c[n] for n in c.column_names}}
    at = {**{n: i for n in q.column_names}, **{n: j for n in c.column_names}}
    cols = [pa.array(s, pa.int32()) if n == "score" else have[n].take(pa.array(at[n], pa.int64())) for n in out]
    return pa.Table.from_arrays(cols, names=out)


def _nearest(limit: int, threshold: int, out: list[str]) -> Callable:
    """The ``limit`` best choices of each list for each query of a group."""
    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.take(pc.sort_indices(c, [("__list", "ascending"), ("ord", "ascending")], null_placement="at_end" if limit == 1 else "at_start"))
        lists = c["__list"].to_numpy()
        cut = [*np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))] if len(lists) else []
        texts, patterns, found = _strings(c["__cn"]), _strings(q["__qn"]), []
        size, longest = _lengths(texts), _lengths(patterns)
        for some, d in distances(patterns, texts):
            got = scores(d, np.maximum(size[:, None], longest[some][None]))
            for a, b in zip(cut, [*cut[1:], len(lists)]):
                part = got[a:b]
                if limit <= 8:
                    for _ in range(min(limit, b - a)):  # the first of the best comes first in the order
                        at = part.argmax(0)
                        s = part[at, np.arange(len(some))].copy()
                        part[at, np.arange(len(some))] = -1
                        ok = s > threshold
                        found.append((some[ok], at[ok] + a, s[ok]))
                else:
                    at = np.argsort(-part, axis=0, kind="stable")[:limit]
                    s = np.take_along_axis(part, at, 0)
                    ok = s > threshold
                    found.append((np.broadcast_to(some, s.shape)[ok], at[ok] + a, s[ok]))
        return _result(q, c, out, found)
    return best


def _windows(short: list[str], long_: list[str], longer_only: bool, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(short, long, score) of the pairs whose best window scores above the threshold."""
    sizes, room = _lengths(short), _lengths(long_)
    for n in np.unique(sizes):
        mine, theirs = np.flatnonzero(sizes == n), np.flatnonzero(room > n if longer_only else room >= n)
        place: dict[str, int] = {}
        flat = [place.setdefault(long_[j][a:a + n], len(place)) for j in theirs for a in range(room[j] - n + 1)]
        starts = np.concatenate(([0], np.cumsum(room[theirs] - n + 1)))[:-1]
        score = scores(np.arange(n + 1), np.full(n + 1, n))
        for some, d in distances([short[i] for i in mine], list(place)):
            got = score[np.minimum.reduceat(d[flat], starts, axis=0)]
            j, i = np.nonzero(got > threshold)
            yield mine[some[i]], theirs[j], got[j, i]


def _partial(threshold: int, out: list[str]) -> Callable:
    """All pairs of a group whose best window scores above the threshold."""
    def above(q: pa.Table, c: pa.Table) -> pa.Table:
        a, b = _strings(q["__qn"]), _strings(c["__cn"])
        found = [*_windows(a, b, False, threshold)] + [(i, j, s) for j, i, s in _windows(b, a, True, threshold)]
        return _result(q, c, out, found)
    return above


# ------------------------------------------------------------------ the groups
def _by_blocks(qn: DataFrame, cn: DataFrame, queries: int, choices: int, fn: Callable, schema: str) -> DataFrame:
    """``fn`` (of two Arrow tables) for every pair of a block of queries and one of choices."""
    ship_package(qn.sparkSession)
    nq, nc = -(-max(qn.count(), 1) // queries), -(-max(cn.count(), 1) // choices)
    # a number given here is kept: the groups are small in bytes, but not in work
    parts = min(max(nq * nc, int(qn.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 10_000)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = qn.withColumn("__qa", block("__qn", nq)).withColumn("__qb", every(nc)).repartition(parts, "__qa", "__qb")
    right = cn.withColumn("__cb", block("__cn", nc)).withColumn("__ca", every(nq)).repartition(parts, "__ca", "__cb")
    return left.groupBy("__qa", "__qb").cogroup(right.groupBy("__ca", "__cb")).applyInArrow(fn, schema)


def _schema(*columns) -> tuple[list[str], str]:
    fields = [*columns]
    return [n for n, _ in fields] + ["score"], ", ".join([*(f"`{n}` {t}" for n, t in fields), "score int"])


def _typed(df: DataFrame, leave: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema if f.name not in leave]


def nearest(qn: DataFrame, cn: DataFrame, limit: int, threshold: int) -> DataFrame:
    """Of all prepared pairs (``simjoin.prepare``): for each query, and each block and list
    (``__list``) of choices, the ``limit`` best by score and ``ord``, above the threshold.
    The columns of both but the prepared ones, and ``score``."""
    out, schema = _schema(*_typed(qn, ("__qn", "__qt")), *_typed(cn, ("__cn", "__ct")))
    rows = max(1024, min(4096, -(-qn.count() // 64)))
    return _by_blocks(qn.drop("__qt"), cn.drop("__ct"), rows, 16_384, _nearest(limit, threshold, out), schema)


def partial(qn: DataFrame, cn: DataFrame, threshold: int) -> DataFrame:
    """All prepared pairs whose best window scores above the threshold, with the score.
    A group returns at most all its pairs."""
    out, schema = _schema(*_typed(qn, ("__qn", "__qt")), *_typed(cn, ("__cn", "__ct")))
    return _by_blocks(qn.drop("__qt"), cn.drop("__ct"), 1024, 2048, _partial(threshold, out), schema)
