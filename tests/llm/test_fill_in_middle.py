"""Fill-in-the-middle against a plain version of the rule, and DuckDB."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roamlens.llm import fill_in_middle as M
from roamlens.llm import queries
from roamlens.llm.common import load
from roamlens.plans.compare import compare, duck

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(alphabet="aé好 \n\t\x0b\r<P>S\x00\U0001f600", max_size=60)


def plain_row(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, len(p), len(m), out


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_transform(texts):
    ids = list(range(17, 17 + len(texts)))
    got = M.transform(ids, [t.encode() for t in texts])
    want = [plain_row(i, t) for i, t in zip(ids, texts)]
    assert list(zip(ids, got["n"], got["form"], got["prefix_chars"], got["middle_chars"], [o.decode() for o in got["output"]])) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_lines(texts):
    """Line units: a unit ends after a line break, the last with the text."""
    found = M.Boundaries([t.encode() for t in texts], "lines")
    lines = [re.findall(r"[^\n\x0b\x0c\r]*[\n\x0b\x0c\r]|[^\n\x0b\x0c\r]+", t) for t in texts]
    assert found.units.tolist() == [len(x) for x in lines]
    for i, parts in enumerate(lines):
        for k in range(len(parts) + 1):
            at = found.cut(np.array([i]), np.array([k]))
            assert at[0] - found.first[i] == len("".join(parts[:k]))


def test_ranks_and_selects():
    rng = np.random.default_rng(4)
    for n in (0, 1, 511, 512, 513, 5000):
        bits = rng.random(n) < 0.3
        v, at = M.BitVector(bits), np.arange(n + 1)
        assert v.rank(at).tolist() == [int(bits[:i].sum()) for i in at]
        assert v.select(np.arange(bits.sum())).tolist() == np.flatnonzero(bits).tolist()
        symbols = rng.integers(0, 16, n).astype(np.uint8)
        w = M.WaveletMatrix(symbols, 4)
        for s in range(16):
            assert w.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]


def test_rows(spark, make_docs):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["word", "é", " ", "\n\n", "\t", "好 "]) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n "), (403, "a <P> b"), (404, "x < P>"), (5, "again"), (5, "again"), (None, "no id"), (None, None)]
    rows += [(i, "word " * 60000) for i in range(500, 504)] + [(i, "好" * 300000) for i in range(504, 508)] + [(i, " " * 50000) for i in range(508, 512)]
    rows += [(i, "a<S b<P<M> <") for i in range(600, 640)]
    out = M.restore(M.fill_in_middle(make_docs(rows)))
    got = out.collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(plain_row(*r) for r in rows)
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(make_docs([])).collect() == []
    own = M.fill_in_middle(make_docs(rows[:300]), percent=100, spm_percent=0, marks=("[p]", "[s]", "[m]"))
    assert {r.form for r in own.filter("n > 0").collect()} == {"psm"}
    back = M.restore(own, marks=("[p]", "[s]", "[m]")).select("doc_id", "restored").collect()
    assert dict(map(tuple, back)) == dict(rows[:300])


def test_query_against_brute_force(spark):
    got = queries.QUERIES["op11_wavelet_fill_in_middle"](spark, SF).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in load(spark, SF, "documents").select("doc_id", "text").collect():
        i, n, form, p, m, out = plain_row(r.doc_id, r.text)
        want.append((i, n, form, p, m, sha(out), sha(r.text or "")))
    cols = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    assert Counter(tuple(r[c] for c in cols) for r in got) == Counter(want)


@pytest.mark.parametrize("sf", [SF])
def test_query_against_sql(spark, sf):
    r = compare(queries.QUERIES["op11_wavelet_fill_in_middle"](spark, sf), duck(sf), queries.ORACLES["op11_wavelet_fill_in_middle"])
    assert r["match"], r
