"""Property tests (hypothesis) against small pure-Python restatements."""

import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from roamlens.functions.columns import similarity
from roamlens.operators import extract as X
from roamlens.operators import lexicon as LX

KINDS = st.sampled_from(["sen", "not", "deg", "none"])


def fold_reference(hits):
    """The sentiment score restated directly (hits sorted by position)."""
    w, score, seen = 1.0, 0.0, False
    for kind, weight in hits:
        if kind == "sen":
            score += w * weight
            seen = True
        elif seen and kind == "not":
            w *= -1.0
        elif seen and kind == "deg":
            w *= weight
    return score


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(KINDS, st.sampled_from([-2.0, -1.0, 0.5, 1.5, 2.0, 3.0])), max_size=12))
def test_fold_matches_reference(spark, hits):
    hits = [(k, w) for k, w in hits if k != "none"]
    rows = [(i, k, w) for i, (k, w) in enumerate(hits)]
    df = spark.createDataFrame([(rows,)], "h array<struct<pos:int,kind:string,weight:double>>")
    got = df.select(LX.fold_score(F.col("h")).alias("s")).first().s
    assert math.isclose(got, fold_reference(hits), rel_tol=1e-9, abs_tol=1e-9)


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="abc桂林 ", max_size=8), st.text(alphabet="abc桂林 ", max_size=8))
def test_similarity_bounds_and_symmetry(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(
        similarity("a", "b").alias("ab"), similarity("b", "a").alias("ba")).first()
    assert r.ab == r.ba and 0 <= r.ab <= 100
    if a == b:
        assert r.ab == 100


@settings(max_examples=20, deadline=None)
@given(st.one_of(st.none(), st.integers(min_value=0, max_value=200)))
def test_page_count(spark, n):
    df = spark.createDataFrame([(None if n is None else str(n),)], "n string")
    got = X.fan_out_pages(df, "n").count()
    assert got == (0 if not n else math.ceil(n / 15))
