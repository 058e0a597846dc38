"""Similarity joins against all pairs."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from roamlens.functions.columns import partial_similarity, similarity
from roamlens.operators import simjoin as S

LETTERS = "abcdefghiklmnoprstuvxz好市"
SYLLABLES = ["ba", "lo", "mi", "ta", "ren", "shi", "gu", "kor", "vel", "na", "do", "pe", "zu", "hai", "xi", "市", "桂林"]


def words(rng, n):
    return sorted({"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)})


def typo(rng, s, most=2):
    s = list(s)
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(s))
        s[k:k + 1] = rng.choice(["", rng.choice(LETTERS), s[k] + rng.choice(LETTERS)])
    return "".join(s) or "x"


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(7)
    found = words(rng, 500)
    queries = sorted({typo(rng, rng.choice(found)) for _ in range(120)} | {"", "-", "a", "好", "aaaa", "ba ba", found[0].upper()})
    q = spark.createDataFrame([(x,) for x in queries], "q string")
    c = spark.createDataFrame([(i, i % 3, x) for i, x in enumerate([*found, "", "?", "a", "aa", "b"])], "ord long, level int, name string")
    return q, c


def every_pair(spark, q, c, scorer, threshold):
    """Scores of all pairs, none left out, in one plain expression."""
    rows = [(a.q, *b) for a, b in product(q.distinct().collect(), c.collect())]
    df = spark.createDataFrame(rows, "q string, ord long, level int, name string")
    df = df.withColumn("a", S.normalise_name("q")).withColumn("b", S.normalise_name("name")).filter("a != '' AND b != ''")
    return df.withColumn("score", scorer("a", "b")).filter(F.col("score") > threshold).drop("a", "b")


@pytest.mark.parametrize("threshold", [0, 5, 20, 41, 60, 85, 99])
def test_edit_distance_join(spark, names, threshold):
    q, c = names
    got = S.candidates(q, c, threshold=threshold).select("q", "ord", "score")
    want = every_pair(spark, q, c, similarity, threshold).select("q", "ord", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("threshold", [10, 34, 60, 75, 99])
def test_partial_join(spark, names, threshold):
    q, c = names
    got = S.candidates(q, c, threshold=threshold, scorer=partial_similarity).select("q", "ord", "score")
    want = every_pair(spark, q, c, partial_similarity, threshold).select("q", "ord", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("limit, threshold, falling", [(1, 0, S.FALLING), (3, 0, S.FALLING), (1000, 0, (50, 0)), (2, 55, S.FALLING), (2, 0, (0,))])
def test_top_matches(spark, names, limit, threshold, falling):
    q, c = names
    got = S.top_matches(q, c, limit, threshold=threshold, falling=falling).select("q", "level", "ord", "score", "rank")
    rows = every_pair(spark, q, c, similarity, threshold).select("q", "level", "ord", "score").collect()
    want, place = [], {}
    for r in sorted(rows, key=lambda r: (r.q, r.level, -r.score, r.ord)):
        k = place[r.q, r.level] = place.get((r.q, r.level), 0) + 1
        if k <= limit:
            want.append((*r, k))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_list_and_no_rows(spark, names):
    q, c = names
    got = {r.q: (r.ord, r.score) for r in S.top_matches(q, c, 1, by=()).collect()}
    want = {}
    for r in every_pair(spark, q, c, similarity, 0).collect():
        want[r.q] = min(want.get(r.q, (0, 0)), (-r.score, r.ord))
    assert got == {k: (o, -s) for k, (s, o) in want.items()}
    assert S.top_matches(q.limit(0), c, 1).collect() == [] == S.top_matches(q, c.limit(0), 3).collect()


@pytest.mark.parametrize("limit, most", [(1, 0.05), (3, 0.1)])
def test_pairs_scored(spark, limit, most, monkeypatch):
    """Of misspelt names against a gazetteer, under a tenth of all pairs is scored."""
    rng = random.Random(1)
    found = words(rng, 3000)
    q = spark.createDataFrame([(typo(rng, rng.choice(found)),) for _ in range(300)], "q string").distinct()
    c = spark.createDataFrame([(i, i % 3, x) for i, x in enumerate(found)], "ord long, level int, name string")
    scored, count = S._scored, []
    monkeypatch.setattr(S, "_scored", lambda pairs, *a: (count.append(pairs.count()), scored(pairs, *a))[1])
    S.top_matches(q, c, limit)
    assert sum(count) < most * q.count() * c.count()


def test_unknown_scorer(names):
    with pytest.raises(ValueError):
        S.candidates(*names, scorer=lambda a, b: a)
