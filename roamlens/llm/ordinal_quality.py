"""Quality by ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 poor text, 1 good text with abuse in it, 2 good text.  One
weight vector over hashed text features is shared by all grades, and ordered
thresholds cut its score: ``P(grade <= k) = sigmoid(t_k - w.x)``.  A document gets
its expected grade and the tail probability ``P(grade >= 2)`` for selection.

The model is fitted in one task on a bounded sample of labelled rows (FTRL, whose
L1 term leaves rare words without weight); every document is scored in its own row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import Words, sequence_hash, text_chunks, utf8

GRADES = 3
#: Labelled rows that the model is fitted on, at most (those of smallest id hash).
MAX_LABELLED = 20_000
#: Hash buckets of words and of shapes (a power of two each).
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 18, 1 << 12
N_FEATURES = WORD_BUCKETS + SHAPE_BUCKETS + 1
#: Weight of shares (of shapes, of repeated words) against the presence of a word.
SHARE = 6.0
MIN_TAIL = 0.5
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 3.0, 0.1, 4

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Shape of a byte: capital, other letter, digit, or itself.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 1, 2, 2, 3


def grade(quality: Column, toxic: Column) -> Column:
    """The grade of a label: 0 poor, 1 good but abusive, 2 good; null if not rated."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat feature numbers and values, each text's first place, and its word count.

    A word (run of letters, lower-cased) counts by presence; shapes of the
    white-space words (runs of capitals, letters, digits or one sign) and words equal
    to the one before count by their share."""
    n = len(texts)
    w = Words(texts, lower=True, space=_NOT_LETTER)
    word = (w.hash & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
    raw = Words(texts)
    size = np.diff(raw.first)
    # Shapes: equal neighbours inside a word become one.
    kind = _SHAPE[raw.data]
    inside = np.zeros(len(raw.data) + 1, np.int8)
    inside[raw.start] += 1
    inside[raw.end] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    first = np.zeros(len(raw.data), bool)
    first[raw.start] = True
    new = inside & (first | np.concatenate(([True], kind[1:] != kind[:-1])))
    place = np.cumsum(new) - 1
    start = place[raw.start]
    length = np.diff(np.concatenate((start, [int(new.sum())])))
    shape = WORD_BUCKETS + (sequence_hash(kind[new] + np.uint64(1), start, length) & np.uint64(SHAPE_BUCKETS - 1)).astype(np.int64)
    again = np.zeros(len(raw), bool)
    again[1:] = (raw.hash[1:] == raw.hash[:-1]) & (raw.doc[1:] == raw.doc[:-1])
    each = SHARE / np.maximum(size, 1)
    doc = np.concatenate((w.doc, raw.doc, raw.doc[again]))
    number = np.concatenate((word, shape, np.full(int(again.sum()), N_FEATURES - 1)))
    value = np.concatenate((np.ones(len(w)), each[raw.doc], each[raw.doc[again]]))
    key, at = np.unique(doc * N_FEATURES + number, return_inverse=True)
    total = np.bincount(at, value, len(key))
    number = key % N_FEATURES
    total[number < WORD_BUCKETS] = 1.0
    return number, total, np.searchsorted(key, np.arange(n + 1) * N_FEATURES), size


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds from (grade, numbers, values) rows."""
    z, n = np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    cuts = np.array([-2.0, -1.0])  # the first threshold, and the gaps to the next ones
    cut_sum = np.ones(len(cuts))

    def weights(i):
        shrunk = np.sign(z[i]) * L1 - z[i]
        return np.where(np.abs(z[i]) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for j in order.permutation(len(samples)):
            y, number, value = samples[j]
            w = weights(number)
            s = float(w @ value)
            t = np.concatenate(([-np.inf], np.cumsum(np.concatenate((cuts[:1], np.exp(cuts[1:])))), [np.inf]))
            hi, lo = _sigmoid(t[y + 1] - s), _sigmoid(t[y] - s)
            p = max(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            g = (d_hi - d_lo) * value  # of the loss by the weights
            sigma = (np.sqrt(n[number] + g * g) - np.sqrt(n[number])) / ALPHA
            z[number] += g - sigma * w
            n[number] += g * g
            d_t = np.zeros(len(t))
            d_t[y + 1] -= d_hi
            d_t[y] += d_lo
            inner = d_t[1:-1]
            d_cut = np.array([inner[k:].sum() for k in range(len(cuts))])
            d_cut[1:] *= np.exp(cuts[1:])
            cut_sum += d_cut * d_cut
            cuts -= 0.5 * d_cut / np.sqrt(cut_sum)
    return weights(np.arange(N_FEATURES)), np.cumsum(np.concatenate((cuts[:1], np.exp(cuts[1:]))))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, grade of at most ``most`` rated documents.  A document with
    several ratings counts with the lowest; repeated ids with their first text."""
    rated = labels.select("doc_id", grade(labels["quality"], labels["toxic"]).alias("grade")).filter(
        "grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``most`` rows of two numbers
    return rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the labelled sample, in one task; the weights have a fixed size."""
    import pyarrow as pa

    def vectors(it):
        for b in it:
            for at, part in text_chunks(utf8(b.column(1))):
                number, value, first, _ = features(part)
                rows = [(number[x:y].astype("<i4").tobytes(), value[x:y].astype("<f4").tobytes()) for x, y in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), b.column(2).slice(at, len(part)),
                     pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                    ["doc_id", "grade", "number", "value"])

    def learn(it):
        rows = sorted(r for b in it for r in zip(*(c.to_pylist() for c in b.columns)))
        if not rows:
            return
        samples = [(y, np.frombuffer(n, "<i4"), np.frombuffer(v, "<f4").astype(float)) for _, y, n, v in rows]
        weights, cuts = fit(samples)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()]), pa.array([cuts.astype("<f8").tobytes()])],
                                         ["weights", "cuts"])

    rows = labelled(docs, labels, most).select("doc_id", "text", "grade")
    found = rows.mapInArrow(vectors, "doc_id long, grade int, number binary, value binary")
    model = found.repartition(1).mapInArrow(learn, "weights binary, cuts binary").first()
    if model is None:
        return np.zeros(N_FEATURES), np.array([-2.0, -1.6])
    return np.frombuffer(model["weights"], "<f4").astype(float), np.frombuffer(model["cuts"], "<f8")


def score_texts(texts: list[bytes], weights: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade >= 2) of each text (0 and 0 without words)."""
    number, value, first, size = features(texts)
    s = np.add.reduceat(np.concatenate((weights[number] * value, [0.0])), first[:-1]) if len(texts) else np.zeros(0)
    above = 1 - _sigmoid(cuts[:, None] - np.where(np.diff(first) > 0, s, 0.0)[None, :])
    return np.where(size > 0, above.sum(0), 0.0), np.where(size > 0, above[-1], 0.0)


def quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", least: float = MIN_TAIL,
            out: tuple[str, str, str] = ("expected_grade", "p_good", "kept")) -> DataFrame:
    """``docs`` with three columns more (equal names are replaced): the expected
    grade, ``P(grade >= 2)`` and whether that is ``least`` or more.

    A text without a word (null, empty) has grade 0 and goes."""
    import pyarrow as pa

    weights, cuts = model
    src = docs.select(*[c for c in docs.columns if c not in out])
    place = src.columns.index(text_col)

    def batches(it):
        for b in it:
            for at, part in text_chunks(utf8(b.column(place))):
                expected, tail = score_texts(part, weights, cuts)
                rows = b.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(expected), pa.array(tail), pa.array(tail >= least)],
                                                 [*b.schema.names, *out])

    from pyspark.sql import types as T

    added = [T.StructField(c, k) for c, k in zip(out, (T.DoubleType(), T.DoubleType(), T.BooleanType()))]
    return src.mapInArrow(batches, T.StructType([*src.schema.fields, *added]))
