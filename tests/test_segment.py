"""Dictionary segmentation against the plain dynamic programme."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from roamlens.operators import segment as S
from roamlens.operators import text as TX

DICTIONARY = [("桂林", 50), ("桂林山水", 20), ("山水", 30), ("甲", 5), ("天下", 40), ("甲天下", 25), ("我们", 60), ("去", 80), ("了", 90),
              ("阳朔", 35), ("很", 70), ("漂亮", 30), ("the", 100), ("sea", 10), ("side", 8), ("seaside", 3)]


def plain(text, words):
    total = sum(words.values())
    longest = max(map(len, words))
    out = []
    for run in re.findall(r"[^\W\d_]+", text.lower()):
        best = {len(run): (0.0, 0)}
        for i in range(len(run) - 1, -1, -1):
            options = [(-math.log(total) + best[i + 1][0], 1)]
            options += [(math.log(words[run[i:i + n]]) - math.log(total) + best[i + n][0], n)
                        for n in range(1, min(longest, len(run) - i) + 1) if run[i:i + n] in words]
            best[i] = max(options)
        i = 0
        while i < len(run):
            out.append(run[i:i + best[i][1]])
            i += best[i][1]
    return out


@pytest.fixture(params=["in tasks", "as a table"], autouse=True)
def form(request, monkeypatch):
    """Every test for a dictionary that goes to the tasks and for one that does not."""
    if request.param == "as a table":
        monkeypatch.setattr(S.segment, "__defaults__", (*S.segment.__defaults__[:-1], -1))


def cut(spark, texts, dictionary=DICTIONARY):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    d = spark.createDataFrame(dictionary, "word string, freq long")
    return {r.k: r.words for r in TX.tokenize(df, "text", mode="dictionary", key="k", dictionary=d).collect()}


def test_chinese(spark):
    got = cut(spark, ["桂林山水甲天下", "我们去了阳朔，很漂亮！", "TheSeaside 2018", None, "", "123 。", "桂林火星"])
    assert got == {0: ["桂林山水", "甲天下"], 1: ["我们", "去", "了", "阳朔", "很", "漂亮"], 2: ["the", "seaside"], 3: None, 4: [], 5: [],
                   6: ["桂林", "火", "星"]}


def test_random_texts(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): rng.randint(1, 60) for _ in range(25)}
    texts = ["".join(rng.choice("abcabcabc x.") for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["abc" * 700]
    got = cut(spark, texts, list(words.items()))
    assert got == {i: plain(t, words) for i, t in enumerate(texts)}


def test_empty_dictionary_and_repeated_words(spark):
    d = spark.createDataFrame([], "word string, freq long")
    df = spark.createDataFrame([(1, "abc d")], "k long, text string")
    assert S.segment(df, "k", "text", d).first().words == ["a", "b", "c", "d"]
    assert cut(spark, ["abab"], [("AB", 1), ("ab", 4), ("ba", 3), ("", 9), (None, 3)])[0] == ["ab", "ab"]


@settings(max_examples=50, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="桂林山水甲天下去了 x", max_size=30))
def test_plain_keeps_all_letters(text):
    assert "".join(plain(text, dict(DICTIONARY))) == re.sub(r"\s", "", text)


def test_no_shuffle_with_a_small_dictionary(spark, form, request):
    df = spark.createDataFrame([(1, "abab"), (2, None)], "k long, text string")
    d = spark.createDataFrame([("ab", 3)], "word string, freq long")
    plan = S.segment(df, "k", "text", d)._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == ("table" in request.node.name)


def test_very_long_run(spark):
    """A run of 200,000 letters in the tasks' form."""
    df = spark.createDataFrame([(1, "ab" * 100_000)], "k long, text string")
    d = spark.createDataFrame([("ab", 3), ("ba", 2)], "word string, freq long")
    assert S.segment(df, "k", "text", d, most_words=9).first().words == ["ab"] * 100_000


@pytest.mark.parametrize("most", [9, -1])
def test_full_mode(spark, most):
    """every hit and every letter outside all of them, the rows of a key together; a
    dictionary that goes to the tasks is not joined with substrings."""
    rows = [(1, "Abcx. 好a"), (1, "xxab"), (2, None), (3, ""), (None, "ab"), (None, "zz"), (4, "𝒜bc")]
    df = spark.createDataFrame(rows, "k long, text string")
    d = spark.createDataFrame([("ab",), ("BC",), ("",), (None,), ("ab",)], "word string")
    out = TX.dictionary_segments(df, "k", "text", d, most_words=most)
    got = sorted((r.k or 0, r.start, r.len, r.word) for r in out.collect())
    hits = [(1, 1, 2, "ab"), (1, 2, 2, "bc"), (1, 3, 2, "ab"), (0, 1, 2, "ab"), (4, 2, 2, "bc")]
    letters = [(1, 7, 1, "好"), (1, 8, 1, "a"), (4, 1, 1, "𝒜")]
    assert got == sorted(hits + letters)
    assert ("Generate posexplode" in out._jdf.queryExecution().executedPlan().toString()) == (most < 0)


def test_full_mode_searches_all_texts_of_a_batch_together(spark):
    """a trie over whole runs of texts finds what a search of each text finds; with keys of
    their own the texts stay in their rows."""
    words = ["the", "then", "he", "her", "here", "一", "一二", "𝒜b", "e"]
    texts = ["then here", "", "th", "e", "x1-𝒜b一二三ε", "heé\0the", "ß\n" * 3, "t" * 50 + "hen"]
    letter = np.array([c for c in range(TX.POINTS) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    table = np.zeros(TX.POINTS, bool)
    table[letter] = True

    def plain(t):
        hits = [(i + 1, n, t[i:i + n]) for i in range(len(t)) for n in range(1, 5) if t[i:i + n] in words and i + n <= len(t)]
        met = {i for a, n, _ in hits for i in range(a, a + n)}
        return sorted(hits + [(i + 1, 1, c) for i, c in enumerate(t) if c.isalpha() and i + 1 not in met])

    trie = TX._Trie(words)
    for sparse in (False, True):
        if sparse:
            trie.table = None
        got = TX._search(pa.array([*texts, None]), trie, pa.array(words), table).to_pylist()
        assert [sorted((h["start"], h["len"], h["word"]) for h in x) for x in got] == [plain(t) for t in [*texts, ""]]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    out = TX.dictionary_segments(df, "k", "text", spark.createDataFrame([(w,) for w in words], "word string"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in out.collect():
        found.setdefault(r.k, []).append((r.start, r.len, r.word))
    assert [sorted(found.get(k, [])) for k in range(len(texts))] == [plain(t.lower()) for t in texts]


def test_letters_are_the_engines(spark):
    points = "aZé一𝒜ßǅ1_ -\u0301\u00b2ªʰ"
    runs, seen = TX._letters(spark), spark.createDataFrame([(c,) for c in points], "c string").selectExpr("c", r"c RLIKE '^\\p{L}$' AS is").collect()
    assert {r.c: np.searchsorted(runs, ord(r.c), "right") % 2 == 1 for r in seen} == {r.c: r["is"] for r in seen}
