"""Linear classifiers fitted by one weight for each row against MLlib's fits."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from roamlens.operators import ml as ML
from roamlens.operators import wide


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        y, d = i % 2, 60
        at = [0] + sorted(set(rng.choice(np.arange(1, d), 12).tolist()) | ({int(rng.integers(1, 12))} if y else {int(rng.integers(9, 21))}))
        rows.append((float(y), Vectors.sparse(d, at, [1.0] * len(at) if i % 3 else [1.0] + rng.uniform(0.2, 2, len(at) - 1).tolist()), "train" if i < 100 else "test"))
    df = spark.createDataFrame(rows, ["label", "features", "split"])
    return tuple(df.filter(F.col("split") == s).repartition(3).persist() for s in ("train", "test"))


@pytest.mark.parametrize("block", [wide.BLOCK, 37])
def test_logistic_fit_is_mllibs(parts, block):
    est = [LogisticRegression(maxIter=50, regParam=0.05), LogisticRegression(maxIter=4)]
    assert wide.accuracies(est, *parts, block=block) == pytest.approx([ML.evaluate(e, *parts) for e in est])


def test_svm_reaches_mllibs_objective(parts):
    est = LinearSVC(maxIter=50, regParam=0.01)
    train = parts[0]
    got = []
    keep = wide._descend

    def spy(loss, x, n, penalty, *a):
        x = yield from keep(loss, x, n, penalty, *a)
        got.append(loss(x[1, :n] + x[1, -1])[0] + penalty / 2 * float(x[0, :n] @ x[1, :n]))
        return x

    wide._descend = spy
    try:
        found, = wide.accuracies([est], *parts)
    finally:
        wide._descend = keep
    assert got[0] <= 1.02 * min(est.fit(train).summary().objectiveHistory)
    assert abs(found - ML.evaluate(est, *parts)) < 0.1


def test_grid_takes_the_wide_fits_beyond_its_bound(parts, monkeypatch):
    linear = {"lr": LogisticRegression(maxIter=5), "svc": LinearSVC(maxIter=5, regParam=0.01)}
    expected = ML.evaluate(linear["lr"], *parts)
    for kind in (LogisticRegression, LinearSVC):  # MLlib holds all features on the driver
        monkeypatch.setattr(kind, "_fit", lambda self, df: (_ for _ in ()).throw(AssertionError("a fit over all features on the driver")))
    rows = ML.grid({"all": parts}, linear, most_features=10)
    assert [(m, c) for m, c, _ in rows] == [("all", "lr"), ("all", "svc")]
    assert rows[0][2] == pytest.approx(expected, abs=1e-6)


def test_one_class_and_no_test_rows(parts):
    train, test = parts
    one = train.filter("label = 1")
    assert wide.accuracies([LogisticRegression()], one, test) == [pytest.approx(test.filter("label = 1").count() / test.count())]
    assert wide.accuracies([LogisticRegression(maxIter=2)], train, test.limit(0)) == [None]


def test_other_estimators_stay_with_mllib():
    assert not wide.fits(LogisticRegression(regParam=0.1, elasticNetParam=0.5))
    assert not wide.fits(LinearSVC(standardization=False))
    assert wide.fits(LinearSVC()) and wide.fits(LogisticRegression(regParam=0.1))
