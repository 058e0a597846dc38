"""Fits over a bounded number of features: nothing of the whole vocabulary is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from roamlens.operators import bayes as BY
from roamlens.operators import features as FT


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.choice(["a", "b", "c", "a_b", "d", "e"]) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, 1, ["a"]), (61, 0, None)], "doc_id long, label int, words array<string>")
    return df.withColumn("feats", FT.word_and_bigram_features("words")).cache()


def test_scores_from_pairs(docs):
    """Also where a word reads like a bigram."""
    got = FT.word_and_bigram_class_scores(docs, "words", "label")
    want = FT.class_scores(docs, "feats", "label")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_table_of_some_features(spark, docs):
    only = spark.createDataFrame([("a",), ("a_b",), ("none",)], "word string")
    got = BY.feature_table(docs, "label", "feats", only=only)
    want = BY.feature_table(docs, "label", "feats").filter(F.col("word").isin("a", "a_b"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_few_features_go_to_the_rows(docs):
    table = BY.feature_table(docs, "label", "feats")
    sets = {"all": F.lit(True), "some": F.col("c1") > 3}
    args = (docs, "doc_id", "feats", table, BY.set_totals(table, sets), sets)
    got = BY.margins(*args, few=True).select("doc_id", "method", "model", F.round("margin", 9).alias("margin"))
    want = BY.margins(*args).select("doc_id", "method", "model", F.round("margin", 9).alias("margin"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 62 * 4
