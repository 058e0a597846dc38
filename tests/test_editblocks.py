"""Edit distances over blocks, and searches among texts that no key tells apart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roamlens.functions.columns import partial_similarity, similarity
from roamlens.operators import editblocks as E
from roamlens.operators import simjoin as S


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [3, 32, 40, 70, 150])
def test_distances(most, monkeypatch):
    monkeypatch.setattr(E, "TRIE_TEXTS", 13)
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abc好😀") for _ in range(rng.randint(1, most)))
    patterns, texts = [word() for _ in range(25)], [word() for _ in range(25)] + ["a", "ab", "ab", "c" * most]
    found = np.full((len(texts), len(patterns)), -1)
    for some, d in E.distances(patterns, texts):
        found[:, some] = d
    assert found.tolist() == [[plain(p, t) for p in patterns] for t in texts]


def test_scores_are_those_of_the_column(spark):
    pairs = [(d, n) for n in range(1, 130) for d in range(n + 1)]
    rows = spark.createDataFrame([("a" * n, "a" * (n - d) + "b" * d, d, n) for d, n in pairs], "a string, b string, d int, n int")
    want = {(r.d, r.n): r.s for r in rows.select("d", "n", similarity("a", "b").alias("s")).collect()}
    d, n = map(np.array, zip(*pairs))
    assert dict(zip(pairs, E.scores(d, n).tolist())) == want


@pytest.fixture()
def alike(spark, monkeypatch):
    """Numbered names of two kinds, dealt to several blocks."""
    deal = E._by_blocks
    monkeypatch.setattr(E, "_by_blocks", lambda q, c, n, m, *a: deal(q, c, 40, 30, *a))
    q = spark.createDataFrame([(f"Customer#{i:06d}",) for i in range(0, 900, 7)] + [("north",), ("North 7",)], "q string")
    c = spark.createDataFrame([(i, i % 2, f"Supplier#{i:06d}") for i in range(100)] + [(i, 2, f"NORTH_{i % 9}") for i in range(100, 120)],
                              "ord long, level int, name string")
    return q, c


def all_scores(q, c, scorer, threshold):
    pairs = q.join(F.broadcast(c)).withColumn("score", scorer(S.normalise_name("q"), S.normalise_name("name")))
    return pairs.filter(F.col("score") > threshold).collect()


@pytest.mark.parametrize("limit, threshold", [(1, 0), (3, 0), (12, 0), (1, 60)])
def test_texts_that_share_all_keys(alike, limit, threshold, monkeypatch):
    """No join on keys forms most pairs, and the results are those of all pairs."""
    q, c = alike
    formed, above = [], S.above
    monkeypatch.setattr(S, "above", lambda *a, **k: (formed.append(S._joined(*a[:3])), above(*a, **k))[1])
    got = S.top_matches(q, c, limit, threshold=threshold).select("q", "level", "ord", "score", "rank").collect()
    want, place = [], {}
    for r in sorted(all_scores(q, c, similarity, threshold), key=lambda r: (r.q, r.level, -r.score, r.ord)):
        k = place[r.q, r.level] = place.get((r.q, r.level), 0) + 1
        if k <= limit:
            want.append((r.q, r.level, r.ord, r.score, k))
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(formed) <= q.count() * c.count() / S.PAIRS_IN_BLOCKS


def test_best_windows_in_blocks(alike):
    q, c = alike
    df = S.candidates(q, c, threshold=60, scorer=partial_similarity)
    assert sorted((r.q, r.ord, r.score) for r in df.collect()) == sorted((r.q, r.ord, r.score) for r in all_scores(q, c, partial_similarity, 60))
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()  # no row for each substring
