"""The pipeline's stages, each against a brute-force version over its own input, and
the registered queries over whole tables."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from roamlens.llm import mixing, ordinal_quality, pseudonyms, queries
from roamlens.plans.compare import compare, duck

from tests.llm.test_rules_and_duplicates import brute_components, words_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_registered():
    names = list(E.queries())
    assert names[-1] == "pipeline"
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "pseudonyms", "mix", "pieces"]


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_oracles(spark, key):
    r = compare(E.queries()[key](spark, SF), duck(SF), E.oracle_sql()[key])
    assert r["columns_match"] and r["match"], r


def test_pipeline_stages(spark):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(P.materialise(stage(spark, tables[-1], SF), f"test-{name}"))
    for t in tables[:-1]:
        assert t.columns == columns
    start, good, single, masked, mixed, pieces = [[r.asDict() for r in t.collect()] for t in tables]

    model = ordinal_quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    tail = ordinal_quality.score_texts([(r["text"] or "").encode() for r in start], *model)[1]
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r, p in zip(start, tail) if p >= ordinal_quality.MIN_TAIL}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    poor = [i for i, r in labels.items() if r.quality == 0]
    assert np.mean([i in kept for i in clean]) > 0.95 and np.mean([i in kept for i in poor]) < 0.3

    groups = brute_components([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted({*groups.values()})

    f = pseudonyms.Feistel(pseudonyms.DEFAULT_KEY)
    want = {r["doc_id"]: pseudonyms.pseudonymise(f, r["text"])[0] for r in single}
    assert {r["doc_id"]: r["text"] for r in masked} == want
    assert all(r["n_chars"] == len(r["text"]) for r in masked)

    con = duckdb.connect()
    con.register("documents", tables[3].toArrow())
    taken = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, taken FROM ({queries.SQL_MIX})").fetchall()}
    rows = Counter()
    texts = {r["doc_id"]: r["text"] for r in masked}
    for r in mixed:
        rows[r["doc_id"]] += len(words_of(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"])
    assert rows == Counter({i: t for i, (_, t) in taken.items() if t})

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in pieces) == Counter((r["doc_id"], tuple(sp.encode(r["text"]))) for r in mixed)


def test_pipeline_on_odd_rows(spark, make_docs):
    long = " ".join(f"word{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (None, long), (None, long), (3, long), (3, long), (4, long + " tail"), (5, "x y z", None), (6, "short text here")]
    t = make_docs(rows)
    for _, stage in P.STAGES[1:4]:
        t = P.materialise(stage(spark, t, SF), "odd")
    ids = Counter(r.doc_id for r in t.collect())
    assert set(ids) <= {None, 3, 5, 6} and 3 in ids
    model = (np.zeros(ordinal_quality.N_FEATURES), np.array([-2.0, -1.0]))
    kept = ordinal_quality.quality(make_docs(rows), model, out=P.QUALITY).filter(P.QUALITY[2])
    assert Counter(r.doc_id for r in kept.collect()) == Counter({None: 2, 3: 2, 4: 1, 5: 1, 6: 1})
    empty = make_docs([])
    for _, stage in P.STAGES[1:]:
        empty = stage(spark, empty, SF)
    assert empty.collect() == []


def test_unlike_texts_under_one_id(spark, make_docs):
    """Each text of a repeated id is a document of its own; near copies go under any id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (7, a), (5, b + " tail"), (9, c), (9, c + " tail"), (9, None), (9, ""), (None, a), (2, "one two")]
    got = P.drop_near_duplicates(spark, make_docs(rows), SF)
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    nine = [t for i, t in kept if i == 9 and t]
    assert len(nine) == 1 and nine[0] in (c, c + " tail")
    assert kept == Counter([(7, a), (5, b + " tail"), (9, nine[0]), (9, None), (9, ""), (None, a), (2, "one two")])
    assert got.columns == make_docs(rows).columns
    again = P.drop_near_duplicates(spark, make_docs(rows[::-1]).repartition(3), SF)
    assert Counter((r.doc_id, r.text) for r in again.collect()) == kept


def test_whole_table_queries(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op9_shared_prefix_pieces(spark, SF).collect()}
    assert {i: r.decoded_md5 for i, r in got.items()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in docs.items()}
    made = {r.doc_id: r.text for r in queries.op10_feistel_pseudonyms(spark, SF).collect()}
    f = pseudonyms.Feistel(pseudonyms.DEFAULT_KEY)
    assert {i: pseudonyms.pseudonymise(f, t, back=True)[0] for i, t in made.items()} == docs
    assert sum(r.n_tokens for r in queries.op1_token_codes(spark, SF).collect()) > len(docs)
    assert queries.op6_ordinal_quality(spark, SF).count() == len(docs)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits, found = 0, queries.op4_collision_search(spark, SF).collect()
    near = {}
    for r in found:
        near.setdefault(r.query_id, set()).add(r.vec_id)
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hits += len(near[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]]))
    assert len(found) == 20 * len(near) and hits >= 0.9 * len(found)
    assert mixing.MAX_REPEATS == 3
