"""Source divergence against a plain version of the rule, and DuckDB."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from roamlens.llm import queries, source_divergence as D
from roamlens.llm.common import load
from roamlens.plans.compare import compare, duck

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=10, top=10):
    """(lang, source, part, item, value, rank), counted term by term."""
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        terms = TERM.findall(text.translate({c: c + 32 for c in range(65, 91)}))
        groups[lang].add(source)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def rates(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: rates(count[lang, s]) for s in sources}
        q = rates(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(sorted(pair), 1)]
            out += [(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(sorted(term)[:top], 1)]
    return sorted(out)


SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "text", "n", "term", "levels", "total", "p")])


@pytest.fixture
def make(spark):
    """documents with clashing extra columns."""
    return lambda rows: spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("most_terms", [3, 256])
def test_against_plain(make, most_terms):
    rng = random.Random(6)
    words = ["sea", "Sea", "été", "好", "O'Neil", "x-y", "tail", "İ", "a1b", "\x7f", "_", "42"] + [f"w{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "s1", "s2", "é", "\U0001f600", "￮", None, ""])
        rows.append((lang, source, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40)))))
    rows += [("en", "empty", None), ("en", "void", ""), ("xx", "one", "rare words only"), ("xx", "two", "1 2 3"), ("yy", "alone", "sea " * 30)]
    rows += [("long", "a", "sea tide " * 40000)] * 10 + [("long", "b", "x" * 100000), ("long", "b", "sea")]
    rows += [rows[0]] * 5
    got = [tuple(r) for r in D.source_divergence(make(rows), most_terms=most_terms).collect()]
    assert sorted(got) == plain(rows)
    assert any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in got)


def test_no_rows(make):
    got = D.source_divergence(make([]))
    assert got.collect() == []
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]


def test_products_are_joint_tables(monkeypatch):
    rng = np.random.default_rng(2)
    want = Counter()
    term, source, level = [], [], []
    for t in range(50):
        at = {s: int(rng.integers(1, 6)) * 10**10 for s in range(7) if rng.random() < 0.6}
        term += [t] * len(at)
        source += list(at)
        level += list(at.values())
        want.update((a, at[a], b, at[b]) for a in at for b in at if a <= b)
    for cells in (1, 100, 1 << 22):
        monkeypatch.setattr(D, "TILE_CELLS", cells)
        a, c, b, d, n = D.level_product(*map(np.array, (term, source, level)))
        assert dict(zip(zip(a.tolist(), c.tolist(), b.tolist(), d.tolist()), n.tolist())) == want


def test_blocks_cover_all_terms():
    size = np.array([1, 5, 70000, 2, 2, 2, 0, 3])
    got = list(D.blocks(size, 3, 100))
    assert [i for a, b in got for i in range(a, b)] == list(range(8))
    assert all(b - a <= 3 and (b - a == 1 or size[a:b].sum() <= 100) for a, b in got)
    assert list(D.blocks(size[:0])) == []


def test_query(spark):
    rows = [tuple(r) for r in load(spark, SF, "documents").select("lang", "source", "text").collect()]
    assert sorted(tuple(r) for r in queries.QUERIES["op13_level_products"](spark, SF).collect()) == plain(rows)
    r = compare(queries.QUERIES["op13_level_products"](spark, SF), duck(SF), queries.ORACLES["op13_level_products"])
    assert r["match"], r
