"""Linear classifiers over more features than the driver should hold.

MLlib's fits keep some twenty numbers for each feature on the driver and several in each
task.  Their descent starts at zero, so every vector it makes is a sum of (scaled, centred)
training rows.  Here such a vector is one weight for each row, beside its products with all
rows, which is all that the loss, the inner products and the line search ask for.  A new
gradient's products take one pass over the entries: they lie in blocks of features, and a
task answers with a number for each row.  The driver's memory follows the rows alone."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.operators.blocks import ends, one
from roamlens.session import cut_lineage, ship_package

#: Features up to which MLlib's own fit is taken: its driver then holds some 20 MB for each.
MOST_FEATURES = 1 << 17
#: Entries of a block, and numbers that the tasks of a pass answer with in all.
BLOCK, ANSWERS = 1 << 20, 1 << 24


def fits(estimator) -> bool:
    """Whether ``accuracies`` knows the estimator: logistic regression without a penalty by
    absolute values, or the linear SVM, with intercept, on scaled features."""
    if not isinstance(estimator, (LogisticRegression, LinearSVC)):
        return False
    plain = estimator.getFitIntercept() and estimator.getStandardization() and not estimator.isDefined("weightCol")
    if isinstance(estimator, LinearSVC):
        return plain and estimator.getThreshold() == 0
    return plain and estimator.getThreshold() == 0.5 and estimator.getFamily() in ("auto", "binomial") and (
        not estimator.getRegParam() or not estimator.getElasticNetParam())


def width(rows: DataFrame, features: str = "features") -> int:
    """The number of features, from the first row; 0 without rows."""
    raw = F.unwrap_udt(features)
    first = rows.select(F.coalesce(raw["size"], F.size(raw["values"]))).first()
    return first[0] if first else 0


def _numbers(column) -> np.ndarray:
    return one(column).to_numpy(zero_copy_only=False)


def _dealt(starts: np.ndarray, blocks: int):
    """The entries of a batch of rows, a row for each block they fall into."""
    def deal(batches):
        for x in batches:
            place, lists = x["place"].to_numpy(), x["indices"]
            row = np.repeat(starts[place >> 33] + (place & (1 << 33) - 1), np.diff(ends(lists))).astype("<i4")
            at, value = lists.flatten().to_numpy().astype("<i4"), x["values"].flatten().to_numpy(zero_copy_only=False).astype("<f8")
            order = np.argsort(at % blocks, kind="stable")
            row, at, value = row[order], at[order], value[order]
            met, first = np.unique(at % blocks, return_index=True)
            cut = [slice(*c) for c in zip(first, [*first[1:], len(at)])]
            yield pa.RecordBatch.from_arrays([
                pa.array(met.astype(np.int32)), pa.array([row[c].tobytes() for c in cut], pa.binary()), pa.array([at[c].tobytes() for c in cut], pa.binary()),
                pa.array([None if (value[c] == 1).all() else value[c].tobytes() for c in cut], pa.binary())], ["b", "row", "at", "value"])
    return deal


def _block(n: int):
    """A block's entries by feature: their rows and values, where a feature begins, and the
    mean and scale of its values in the first ``n`` rows."""
    def block(parts: pa.Table) -> pa.Table:
        rows = [np.frombuffer(r, "<i4") for r in one(parts["row"]).to_pylist()]
        value = np.concatenate([np.ones(len(r)) if v is None else np.frombuffer(v, "<f8") for r, v in zip(rows, one(parts["value"]).to_pylist())])
        row, at = np.concatenate(rows), np.concatenate([np.frombuffer(a, "<i4") for a in one(parts["at"]).to_pylist()])
        order = np.lexsort((row, at))
        row, at, value = row[order], at[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        known = row < n
        count = np.add.reduceat(known, first, dtype=float)
        mean = np.add.reduceat(np.where(known, value, 0), first) / n
        off = np.where(known, value - np.repeat(mean, np.diff(np.append(first, len(at)))), 0)
        spread = np.add.reduceat(off * off, first) + (n - count) * mean * mean
        with np.errstate(divide="ignore"):
            scale = np.where(spread > 1e-20 * n * mean * mean, 1 / np.sqrt(spread / max(n - 1, 1)), 0)
        kept = [None if (value == 1).all() else value.astype("<f8").tobytes()]
        binary = [row.tobytes(), first.astype("<i4").tobytes(), mean.astype("<f8").tobytes(), scale.astype("<f8").tobytes()]
        return pa.table([pa.array([x], pa.binary()) for x in binary] + [pa.array(kept, pa.binary())], ["row", "first", "mean", "scale", "value"])
    return block


def _products(sent, rows: int):
    """The products of all rows with sums of the rows: one for each of the (broadcast) weights."""
    def products(blocks):
        out = np.zeros((len(sent.value), rows))
        for block in blocks:
            row, first, mean, scale, value = (None if x is None else np.frombuffer(x, kind) for x, kind in zip(block, ("<i4", "<i4", "<f8", "<f8", "<f8")))
            n = np.diff(np.append(first, len(row)))
            for v, total in zip(sent.value, out):
                met = v[row] if value is None else v[row] * value
                z = scale * scale * (np.add.reduceat(met, first) - mean * v.sum())
                back = np.repeat(z, n)
                total += np.bincount(row, back if value is None else back * value, rows) - mean @ z
        yield out
    return products


class _Failed(Exception):
    """A line search that found no step."""


def _strong_wolfe(phi: Callable, start: tuple[float, float], turn: int, length: float, steepness: float) -> float:
    """A step that lowers the value enough and flattens the slope, as MLlib's L-BFGS takes it."""
    value, slope = start
    low, t = (0.0, value, slope), 1 / length if turn == 0 else 1.0

    def between(left, right):
        d1 = left[2] + right[2] - 3 * (left[1] - right[1]) / (left[0] - right[0])
        d2 = np.sqrt(d1 * d1 - left[2] * right[2])
        step = right[0] - left[0]
        return float(np.clip(right[0] - step * (right[2] + d2 - d1) / (right[2] - left[2] + 2 * d2), left[0] + 0.1 * step, left[0] + 0.9 * step))

    def zoom(low, high):
        for _ in range(10):
            c = phi(between(*sorted((low, high))))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
            elif abs(c[2]) <= 0.9 * abs(slope):
                return c[0]
            else:
                low, high = c, low if c[2] * (high[0] - low[0]) >= 0 else high
        raise _Failed

    for i in range(10):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or i and c[1] >= low[1]:
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Failed


def _backtracking(phi: Callable, start: tuple[float, float], turn: int, length: float, steepness: float) -> float:
    """The step of MLlib's search for the hinge loss, whose slope jumps."""
    value, slope = start
    t = 0.5 / steepness if turn == 0 else 1.0
    for _ in range(20):
        _, at, now = phi(t)
        if not at <= value + 1e-4 * t * slope:
            t *= 0.1 if turn == 0 else 0.5
        elif now < 0.9 * slope:
            t *= 2.1
        elif now > -0.9 * slope:
            t *= 0.1 if turn == 0 else 0.5
        else:
            return t
        if not 1e-10 <= t <= 1e10:
            break
    raise _Failed


def _descend(loss: Callable, x: np.ndarray, n: int, penalty: float, turns: int, tolerance: float, search: Callable):
    """L-BFGS.  A vector is two rows: the weights of the training rows and the products with
    all rows, each with the intercept as its last number.  A generator: it gives weights, is
    sent their products, and returns the vector it comes to."""
    def inner(a, b):
        return float(a[0, :n] @ b[1, :n] + a[0, -1] * b[1, -1])

    def at(x):
        """Value, and the gradient's weights and intercept."""
        value, r = loss(x[1, :n] + x[1, -1])
        return value + penalty / 2 * float(x[0, :n] @ x[1, :n]), r + penalty * x[0, :n], float(r.sum())

    def gradient(x, found):
        g = np.zeros_like(x)
        g[0, :n] = found[1]
        g[1, :-1] = yield found[1]
        g[:, -1] = found[2]
        return g

    found = at(x)
    g = yield from gradient(x, found)
    history, values, first, failed, turn = deque(maxlen=10), deque([found[0]], maxlen=20), abs(found[0]), False, 0
    while turn < turns and np.sqrt(max(inner(g, g), 0)) > max(tolerance * abs(found[0]), 1e-8):
        d, used = -g, []
        for s, y, sy in reversed(history):
            used.append(inner(s, d) / sy)
            d = d - used[-1] * y
        if history:
            s, y, sy = history[-1]
            d = d * (sy / inner(y, y))
        for (s, y, sy), a in zip(history, reversed(used)):
            d = d + (a - inner(y, d) / sy) * s

        def phi(t):
            value, r, b = at(x + t * d)
            return t, value, float(r @ d[1, :n]) + b * d[1, -1]

        length, steepness, slope = np.sqrt(max(inner(d, d), 0)), np.sqrt(max(inner(g, g), 0)), inner(g, d)
        try:
            if slope > 0:
                raise _Failed
            t = search(phi, (found[0], slope), turn, length, steepness)
        except _Failed:
            if failed or not history:
                break
            failed = True
            history.clear()
            continue
        step = t * d
        x = x + step
        found, failed, turn = at(x), False, turn + 1
        before, g = g, (yield from gradient(x, found))
        sy = inner(step, g - before)
        if sy > 0:
            history.append((step, g - before, sy))
        if abs(found[0] - max(values)) <= tolerance * first:
            break
        values.append(found[0])
    return x


def accuracies(estimators: list, train: DataFrame, test: DataFrame, features: str = "features", label: str = "label", block: int = BLOCK) -> list[float | None]:
    """The share of the test rows that each estimator, fitted on the training rows, classifies
    rightly; labels are 0 or 1.  A row's number follows from its place, so both parts should be
    persisted."""
    spark = train.sparkSession
    ship_package(spark)
    part = lambda df: df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("f"))
    rows = part(train).unionByName(part(test)).withColumn("place", F.monotonically_increasing_id())
    raw = F.unwrap_udt("f")
    indices = F.coalesce(raw["indices"], F.sequence(F.lit(0), F.size(raw["values"]) - 1))
    seen = rows.select("place", "label", F.size(indices).alias("size")).toArrow().sort_by("place")
    place, y = _numbers(seen["place"]), _numbers(seen["label"])
    task, first = np.unique(place >> 33, return_index=True)
    starts = np.zeros(int(task.max(initial=0)) + 1, np.int64)
    starts[task] = first
    n, total = train.count(), len(y)
    if not np.isin(y, (0, 1)).all() or not 0 < n:
        raise ValueError("labels must be 0 or 1, and there must be training rows")
    blocks = max(1, -(-int(_numbers(seen["size"]).sum()) // block))
    entries = rows.select("place", indices.alias("indices"), raw["values"].alias("values")).mapInArrow(_dealt(starts, blocks), "b int, row binary, at binary, value binary")
    table = cut_lineage(entries.groupBy("b").applyInArrow(_block(n), "row binary, first binary, mean binary, scale binary, value binary"))
    given = table.rdd
    given = given.coalesce(max(1, min(given.getNumPartitions(), ANSWERS // max(total, 1))))

    def products(weights: list[np.ndarray]) -> np.ndarray:
        sent = spark.sparkContext.broadcast([np.concatenate([w, np.zeros(total - n)]) for w in weights])
        try:
            return sum(given.mapPartitions(_products(sent, total)).collect())
        finally:
            sent.destroy()

    def logistic(m):
        z = np.where(y[:n] == 1, -m, m)
        return float(np.logaddexp(0, z).mean()), np.where(y[:n] == 1, -1, 1) / (1 + np.exp(np.clip(-z, None, 700))) / n

    def hinge(m):
        sign = 2 * y[:n] - 1
        short = 1 - sign * m
        return float(np.maximum(short, 0).mean()), np.where(short > 0, -sign, 0) / n

    ends_at, wanted = {}, {}
    for k, e in enumerate(estimators):
        x, of_one = np.zeros((2, total + 1)), float(y[:n].sum())
        if isinstance(e, LinearSVC):
            loss, search = hinge, _backtracking
        elif 0 < of_one < n:
            loss, search, x[:, -1] = logistic, _strong_wolfe, np.log(of_one / (n - of_one))
        else:  # of one class alone nothing is learnt
            x[:, -1] = 1 if of_one else -1
            ends_at[k] = x
            continue
        fit = _descend(loss, x, n, e.getRegParam(), e.getMaxIter(), e.getTol(), search)
        wanted[k] = fit, next(fit)
    while wanted:  # a pass serves all fits
        for (k, (fit, _)), got in zip([*wanted.items()], products([w for _, w in wanted.values()])):
            try:
                wanted[k] = fit, fit.send(got)
            except StopIteration as done:
                ends_at[k] = done.value
                del wanted[k]
    right = [(x[1, n:-1] + x[1, -1] > 0) == (y[n:] == 1) for x in (ends_at[k] for k in range(len(estimators)))]
    return [float(r.mean()) if len(r) else None for r in right]
