"""Sums over blocks of documents: means of known vectors."""

import pytest

from roamlens.operators import blocks as B
from roamlens.operators import vectors as VC


@pytest.mark.parametrize("block", [1, 4, 1 << 22])
def test_known_vector_mean(spark, monkeypatch, block):
    """Repeated and null keys, a word with two vectors, unknown words, many blocks."""
    monkeypatch.setattr(B, "BLOCK", block)
    docs = [(1, ["a", "b", "a", "q"]), (1, ["b"]), (None, ["c"]), (None, ["a"]), (2, ["q"]), (3, []), (4, None), (5, ["c", None, "c"])]
    vecs = [("a", [1.0, 2.0]), ("b", [3.0, 5.0]), ("c", [1.0, 0.0]), ("c", [0.0, 7.0]), (None, [9.0, 9.0])]
    d = spark.createDataFrame(docs, "k long, w array<string>")
    v = spark.createDataFrame(vecs, "word string, vec array<float>")
    got = {(r.k, r.dim): (r.mean, r.n_known) for r in VC.known_vector_mean(d, "k", "w", v, "word", "vec").collect()}
    assert got == {(1, 0): (2.0, 4), (1, 1): (3.5, 4), (None, 0): (0.666667, 3), (None, 1): (3.0, 3), (5, 0): (0.5, 4), (5, 1): (3.5, 4)}


def test_no_known_word(spark):
    d = spark.createDataFrame([(1, ["a"])], "k long, w array<string>")
    v = spark.createDataFrame([("b", [1.0])], "word string, vec array<double>")
    assert VC.known_vector_mean(d, "k", "w", v, "word", "vec").collect() == []


def test_a_vector_travels_once_for_each_word_of_a_block(spark):
    """the join sees the distinct words of a block, not each pair."""
    rows = 400
    d = spark.createDataFrame([(i, ["a", "b"]) for i in range(rows)], "k long, w array<string>")
    v = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, vec array<double>")
    out = VC.known_vector_mean(d, "k", "w", v, "word", "vec")
    assert out.count() == rows
    seen = []
    B.by_block(d, "w", lambda need: (seen.append(need.count()), need)[1], lambda a, b: a, "k long, w array<string>, __b long")
    assert seen == [2]
