"""Repetition rules, near-duplicates, quality and mixing against brute force."""

import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roamlens.llm import minhash as M
from roamlens.llm import mixing, ordinal_quality as Q, queries, repetition as R
from roamlens.llm.common import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


# --- repetition -------------------------------------------------------------

def brute_rules(text):
    ws = words_of(text)
    windows = defaultdict(list)
    for i in range(len(ws) - 4):
        windows[tuple(ws[i:i + 5])].append(i)
    repeat = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(ws) < 10 or 100 * len(repeat) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat), failed


def brute_depth(ws):
    out = []
    for i in range(len(ws)):
        best = 0
        for j in range(len(ws)):
            k = 0
            while i != j and max(i, j) + k < len(ws) and ws[i + k] == ws[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=60), min_size=1, max_size=5))
def test_longest_repeats(texts):
    w = Words([t.encode() for t in texts])
    got = R.longest_repeats(w.hash, w.doc, len(texts)).tolist()
    assert got == [d for t in texts for d in brute_depth(words_of(t))]


def test_repetition_rules(make_docs):
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, "\n".join(" ".join(rng.choice(["the", "sea", "é|x", "#a", f"u{rng.random()}"]) for _ in range(rng.randint(0, 30)))
                          for _ in range(rng.randint(1, 5)))) for i in range(60)]
    filler = lambda n: " ".join(f"f{rng.random()}" for _ in range(n))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, f"{filler(900)} {passage} {filler(9)} {passage}"), (103, "x"), (None, "y " * 50),
             (104, filler(40000))]
    got = R.repetition_rules(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute_rules(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    by = {r.doc_id: r for r in got if r.doc_id in (103, 104) and r.n_words > 1}
    assert not by[103].base_failed and not by[103].kept and by[103].longest_repeat_words == 60
    assert by[104].kept
    assert not any(r.kept for r in got if r.base_failed)
    assert R.repetition_rules(make_docs([])).collect() == []


# --- near-duplicates --------------------------------------------------------

def shingle_set(text):
    w = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and 100 * both >= 75 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_near_duplicates(make_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # a chain that drifts: neighbours are near, its ends are not
        base = base[:]
        base[rng.randrange(len(base))] = word()
        rows.append((500 - i, " ".join(base)))
    for i in range(25):  # a family about a centre whose members are not all near each other
        member = [x if rng.random() > 0.025 else word() for x in base]
        rows.append((600 + i, " ".join(member).upper()))
    rows += [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(40)]
    rows += [(700, "One two"), (701, "one  TWO\n"), (702, None), (703, ""), (704, None), (705, "one"), (706, rows[0][1]), (706, rows[0][1]),
             (None, rows[0][1]), (None, None), (707, rows[0][1] + " tail"), (707, "another text under the same id as before")]
    got = M.near_duplicates(make_docs(rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingle_set(t))) for i, t in rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert M.near_duplicates(make_docs([])).collect() == []
    assert [r.kept for r in M.near_duplicates(make_docs([(1, None), (2, "")])).collect()] == [True, True]


def test_own_shingles_by_set(spark, make_docs):
    near, twin, other = "a b c d e f g h i j k l", "a b c d e f g h i j k m", " ".join(f"w{i}" for i in range(90))
    docs = make_docs([(1, near), (1, other), (2, twin)]).selectExpr("doc_id AS id", "text")
    rows = M.own_shingles(spark.createDataFrame([(1,), (2,)], "rep long"), docs).collect()
    assert sorted((r.rep, r.own) for r in rows) == [(1, 1), (1, 86), (2, 1)]


def test_signature_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate((a[:700], rng.integers(0, 1 << 63, 200, dtype=np.uint64)))
    low, high = M.signatures(np.concatenate((a, b)), np.array([0, 900]))
    share = ((low[0] == low[1]).sum() + (high[0] == high[1]).sum()) / (2 * M.PERMUTATIONS)
    assert abs(share - 700 / 1100) < 0.15


# --- quality ----------------------------------------------------------------

def graded(n, seed=2):
    rng = random.Random(seed)
    good = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(good) for _ in range(rng.randint(3, 80)))
        kind = rng.choice([0, 1, 2, 2, 2])
        if kind == 0:
            text = rng.choice([" ".join(x + "###" for x in text.split()), " ".join([rng.choice(good)] * 40), text.upper() + "!!"])
        elif kind == 1:
            text += f" {rng.choice(['vile', 'nasty'])} " + " ".join(rng.choice(good) for _ in range(20))
        rows.append((i, text))
        labels.append((i, int(kind > 0), int(kind == 1)))
    return rows, labels


def test_quality_held_out(spark, make_docs):
    rows, labels = graded(1500)
    table = spark.createDataFrame(labels + [(3, None, 0), (None, 1, 1), labels[5]], "doc_id long, quality int, toxic int")
    train = make_docs(rows[:1000])
    model = Q.train(train, table)
    assert np.all(np.diff(model[1]) > 0)
    extra = [(9000, None), (9001, ""), (9002, " \n"), (None, rows[0][1]), (9003, "w1 " * 50000)]
    got = Q.quality(make_docs(rows[1000:] + extra), model).collect()
    assert len(got) == 505
    truth = {i: q - t for i, q, t in labels}
    scored = [r for r in got if r.doc_id is not None and r.doc_id < 9000]
    right = sum(r.kept == (truth[r.doc_id] == 1) for r in scored)
    assert right / len(scored) > 0.95
    for r in got:
        assert 0 <= r.expected_grade <= 2 and r.kept == (r.p_good >= Q.MIN_TAIL)
        if r.doc_id in (9000, 9001, 9002):
            assert r.expected_grade == 0 and not r.kept
    again = Q.train(train, table)
    assert np.array_equal(again[0], model[0])
    assert Q.quality(make_docs([]), model).collect() == []
    empty = Q.train(make_docs([]), table)
    assert len(empty[0]) == Q.N_FEATURES


def test_labelled_bound(spark, make_docs):
    rows, labels = graded(200)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert Q.labelled(make_docs(rows), table, 50).count() == 50


# --- mixing -----------------------------------------------------------------

def test_mix_against_sql(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, "\t".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "é", "z", None])) for i in range(300)]
    rows += [(7, None, "b"), (7, "x", "b"), (7, "x", "b"), (None, "q r", "a"), (8, "", "empty"), (9, None, "empty")]
    docs = make_docs(rows)
    got = mixing.mix(docs, range_rows=7).collect()
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.SQL_MIX})").fetchall()
    tidy = lambda found: sorted(tuple(-1 if x is None else x for x in r) for r in found)
    assert tidy(got) == tidy(want)
    assert sum(r.taken for r in got) == pytest.approx(sum(r["size"] for r in got), abs=5)
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(make_docs([])).collect() == []


def test_mix_targets(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 40), (None, 3)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    total, cap, weight = 1553, {"a": 30, "b": 3000, "c": 1500, "d": 120, None: 9}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    full = set()
    while True:  # share again what lies above the caps
        level = (total - sum(cap[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in cap if s not in full and weight[s] * level > cap[s]}
        if not more:
            break
        full |= more
    assert got == pytest.approx({s: cap[s] if s in full else weight[s] * level for s in cap})


def test_copies(make_docs):
    rows = [(1, "a b  c", "s"), (2, " d e", "s"), (3, "", "s"), (4, None, "s"), (5, "x " * 60, "t")]
    mixed = mixing.mix(make_docs(rows), keep=("text", "source"))
    sizes = {r.doc_id: r.taken for r in mixed.collect()}
    out = defaultdict(list)
    for r in mixing.copies(mixed).collect():
        out[r.doc_id].append(r.text)
    for i, t, _ in rows:
        assert sum(len(words_of(x)) for x in out[i]) == sizes[i]
        assert all((t or "").startswith(x) for x in out[i])


# --- the tables -------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_queries_on_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.component_id for r in queries.op3_minmax_near_duplicates(spark, SF).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs])
    rules = {r.doc_id: r for r in queries.op2_repetition_rules(spark, SF).collect()}
    assert len(rules) == len(docs)
    for r in docs:
        x = rules[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute_rules(r.text)
