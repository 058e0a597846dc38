"""Collocations inside documents and classes."""

import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roamlens.operators import blocks as B
from roamlens.operators import features as FT

ROWS = [(1, "a b a b c".split()), (1, "b a d".split()), (2, ["x"]), (3, []), (4, None), (None, "a b a".split()), (5, "é 好 é 好 é".split()),
        (6, [f"w{i % 7}" for i in range(50)]), (7, [f"v{i * i % 31}" for i in range(90)]), (8, [])]


def plain(rows):
    """Per key: (w1, w2) -> n_ii, n_ix, n_xi, n_xx."""
    words, pairs = defaultdict(Counter), defaultdict(Counter)
    for k, w in rows:
        if k is not None and w:
            words[k].update(w)
            pairs[k].update(zip(w, w[1:]))
    return {(k, a, b): (n, words[k][a], words[k][b], sum(words[k].values())) for k in pairs for (a, b), n in pairs[k].items()}


@pytest.mark.parametrize("documents", [True, False])
def test_scores_by_group(spark, documents):
    df = spark.createDataFrame(ROWS, "k long, w array<string>").repartition(3)
    got = {(r.k, r.w1, r.w2): (r.n_ii, r.n_ix, r.n_xi, r.n_xx, r.pmi) for r in FT.bigram_scores(df, "w", "k", documents=documents).collect()}
    want = plain(ROWS)
    assert {k: v[:4] for k, v in got.items()} == want
    for k, (ii, ix, xi, xx) in want.items():
        assert got[k][4] == pytest.approx(math.log2(ii * xx / (ix * xi)), abs=1e-6)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("Initial Plan")[0].count("Exchange hashpartitioning"), plan


def test_documents_are_shuffled_once(spark):
    """no join of counts; the tokens of a document travel, nothing else."""
    df = spark.createDataFrame(ROWS, "k long, w array<string>")
    assert exchanges(FT.bigram_scores(df, "w", "k", documents=True))[0] == 1
    n, plan = exchanges(FT.best_bigram_features(df, "k", "w", 2))
    assert n == 1 and "Join" not in plan


@pytest.mark.parametrize("score", ["chi_sq", "pmi"])
def test_best_of_a_document(spark, score):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "k long, w array<string>, i int")
    got = {r.i: r.features for r in FT.best_bigram_features(df, "k", "w", 3, score).collect()}
    top = FT.top_bigrams(FT.bigram_scores(df, "w", "k"), 3, "k", score).collect()
    best = defaultdict(list)
    for r in sorted(top, key=lambda r: r["rank"]):
        best[r.k].append(f"{r.w1}_{r.w2}")
    assert got == {i: None if w is None else w + best[k] for i, (k, w) in enumerate(ROWS)}


def test_a_class_is_not_one_task(spark):
    """the totals of the classes are broadcast, whatever the session's threshold."""
    df = spark.createDataFrame([(i % 2, ["a", f"b{i}", "c"]) for i in range(40)], "y int, w array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FT.bigram_scores(df, "w", "y")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [line for line in plan.splitlines() if "Join [y" in line]
    assert any("BroadcastHashJoin" in j for j in joins) and all("w1" in j or "w2" in j for j in joins if "Broadcast" not in j)
    assert FT.class_collocations(df, "y", "w", 2).filter(F.col("rank") > 2).isEmpty()


def test_pairs_are_counted_a_run_of_documents_at_a_time(spark):
    """what is held at once follows a number of tokens, not the documents of a batch."""
    texts = [["a", "b", "a", "b"], [], None, ["b"], ["a", None, "a"], ["c"] * 9, ["a", "b"]]
    df = spark.createDataFrame([(i, [t, ["x", "a"]]) for i, t in enumerate(texts)], "k long, w array<array<string>>").coalesce(1)
    whole, runs = (sorted(map(str, df.select("k", F.inline(FT._row_pairs("w", size=n))).collect())) for n in (1 << 18, 3))
    assert whole == runs and len(whole) > 7
    rows = pa.array([[["a"] * n] for n in (2, 2, 9, 1, 1, 1)])
    cut = [len(r.flatten().flatten()) for r in B.runs(rows, B.ends(rows.flatten())[B.ends(rows)], 4)]
    assert cut == [4, 9, 3]


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_documents_best_bigrams_are_ranked_in_the_row(spark, n):
    """the same rows as a window over all pairs, with one exchange."""
    df = spark.createDataFrame(ROWS, "k long, w array<string>")
    out = FT.top_document_bigrams(df, "w", "k", n)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    window = FT.top_bigrams(FT.bigram_scores(df, "w", by="k", documents=True), n, by="k").select(*out.columns)
    assert sorted(out.collect()) == sorted(window.collect()) and out.schema.simpleString() == window.schema.simpleString()
