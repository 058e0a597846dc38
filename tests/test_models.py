"""Naive Bayes tables against the formulas, the kernel estimator, round trips."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from roamlens.operators import bayes as B
from roamlens.operators import evaluation as EV
from roamlens.operators import kernel
from roamlens.operators import ml as ML
from roamlens.operators import sampling as SM
from roamlens.operators.kernel import RandomFourierFeatures, RandomFourierSVC


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        weights = [1 + (k % 5) * (y if k % 2 else 1 - y) for k in range(30)]
        rows.append((i, y, rng.choices(words, weights, k=rng.randint(0, 12))))
    return rows + [(n, 1, []), (n + 1, 0, None)]


def plain_margin(train, words, vocabulary, model):
    n = Counter(y for _, y, _ in train)
    seen = {y: Counter() for y in (0, 1)}
    for _, y, w in train:
        seen[y].update(set(w or ()) if model == "bernoulli" else (w or ()))
    out = {}
    for y in (0, 1):
        v = math.log(n[y] + 1)
        if model == "bernoulli":
            for f in vocabulary:
                t = (seen[y][f] + 1) / (n[y] + 2)
                v += math.log(t if f in words else 1 - t)
        else:
            total = sum(seen[y][f] for f in vocabulary)
            v += sum(math.log((seen[y][f] + 1) / (total + len(vocabulary))) for f in words if f in vocabulary)
        out[y] = v
    return out[1] - out[0]


@pytest.mark.parametrize("model", B.MODELS)
def test_margins(spark, model, tmp):
    rows, schema = corpus(80, 1), "k long, y int, words array<string>"
    train, test = rows[:50] + rows[-2:], rows[50:] + [(500, 1, ["unknown", "w1", "w1"])]
    binary = model == "bernoulli"
    table = B.feature_table(spark.createDataFrame(train, schema), "y", "words", binary=binary)
    vocabulary = {w for _, _, ws in train for w in ws or ()}
    sets = {"all": F.lit(True), "few": F.col("word").isin("w1", "w2", "w3"), "none": F.lit(False)}
    B.save(table, B.set_totals(table, sets), tmp)
    got = B.margins(spark.createDataFrame(test, schema), "k", "words", *B.load(spark, tmp), sets, binary, (model,), keep=("y",)).collect()
    assert len(got) == 3 * len(test)
    used = {"all": vocabulary, "few": vocabulary & {"w1", "w2", "w3"}, "none": set()}
    by = {k: (set(w or ()) if binary else list(w or ())) for k, _, w in test}
    for r in got:
        assert r.margin == pytest.approx(plain_margin(train, by[r.k], used[r.method], model), abs=1e-9)


def test_vocabulary_stays_in_tables(spark):
    """A hundred thousand features: the scoring plan holds no literal of them."""
    rows = spark.range(2000).select("id", (F.col("id") % 2).cast("int").alias("y"), F.transform(
        F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("f"), (F.col("id") * 50 + i).cast("string"))).alias("words"))
    table = B.feature_table(rows, "y", "words")
    sets = {"all": F.lit(True)}
    scored = B.margins(rows, "id", "words", table, B.set_totals(table, sets), sets, keep=("y",))
    assert {r.accuracy for r in B.accuracies(scored, "y").collect()} == {1.0}
    assert len(scored._jdf.queryExecution().toString()) < 200_000


def test_first_n_per_class_is_limited_before_the_shuffle(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = SM.first_n_per_class(df, "y", "id", 7, seed=3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    whole = SM.class_ordinal(df, "y", "id", 3).filter("rn <= 7")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))


def test_random_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 40))
    x[:, 20:] = 0
    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x)] + [
        (100 + i, Vectors.sparse(40, {j: float(v[j]) for j in range(20)})) for i, v in enumerate(x)] + [(200, Vectors.sparse(40, {}))], ["i", "features"])
    z = {r.i: np.array(r.z) for r in RandomFourierFeatures(numFeatures=4000, gamma=0.02).transform(df).select("i", vector_to_array("rff").alias("z")).collect()}
    for i in range(12):
        assert np.allclose(z[i], z[100 + i])
        for j in range(12):
            assert z[i] @ z[j] == pytest.approx(math.exp(-0.02 * ((x[i] - x[j]) ** 2).sum()), abs=0.08)
    assert z[200] @ z[0] == pytest.approx(math.exp(-0.02 * (x[0] ** 2).sum()), abs=0.08)


def test_rows_of_the_kernel_do_not_depend_on_their_order():
    want = {i: np.random.Generator(np.random.Philox(key=3, counter=[0, 0, 0, i])).standard_normal(7).astype(np.float32) for i in (0, 5, 9, 1 << 40)}
    for order in ((9, 0, 1 << 40, 5), (5, 9, 0, 1 << 40)):
        kernel._row.cache_clear()
        for i in order:
            kernel._row(4, i, 3)
            assert (kernel._row(3, i, 7) == want[i]).all()


def test_kernel_fit_computes_its_features_once(spark):
    """The rows are counted as they pass: a fit reads them once, however many passes its parts make."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(y):
        read.add(1)
        return y

    df = spark.createDataFrame([(i, float(i % 2), [float(i % 2 + i % 3), 1.0]) for i in range(60)], "i long, y double, v array<double>")
    rows = df.withColumn("features", array_to_vector(F.array(seen.asNondeterministic()(F.col("v")[0]), F.lit(1.0))))
    model = RandomFourierSVC(labelCol="y", gamma=1.0, maxIter=10, numFeatures=20).fit(rows)
    assert read.value == 60
    assert [type(x).__name__ for x in model.stages] == ["RandomFourierFeatures", "LinearSVCModel", "MarginVector", "LogisticRegressionModel"]


def test_kernel_classifier(spark, tmp):
    """Rings are not linearly separable; the kernel classifier tells them apart, and is
    the same after it was written and loaded."""
    rng = np.random.default_rng(5)
    angle, ring = rng.uniform(0, 6.3, 400), rng.integers(0, 2, 400)
    radius = 1 + 2 * ring + rng.normal(0, 0.1, 400)
    rows = [(int(i), float(y), [float(r * math.cos(a)), float(r * math.sin(a))]) for i, (a, r, y) in enumerate(zip(angle, radius, ring))]
    df = spark.createDataFrame(rows, "i long, label double, v array<double>").withColumn("features", array_to_vector("v"))
    tr, te = df.filter("i < 300"), df.filter("i >= 300")
    estimator = RandomFourierSVC(gamma=1.0, maxIter=40)
    model = estimator.fit(tr)
    model.write().overwrite().save(f"{tmp}/model")
    estimator.save(f"{tmp}/estimator")
    assert RandomFourierSVC.load(f"{tmp}/estimator").getOrDefault("gamma") == 1.0
    out = model.transform(te).select("i", "label", "prediction", vector_to_array("probability")[1].alias("score"))
    again = PipelineModel.load(f"{tmp}/model").transform(te).select("i", "label", "prediction", vector_to_array("probability")[1].alias("score"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert ML.evaluate(estimator, tr, te) > 0.97 > 0.8 > ML.evaluate(ML.classifiers()["LinearSVC"], tr, te)
    scored = out.withColumn("label", F.col("label").cast("int"))
    assert EV.auc(scored).first()["auc"] > 0.99
