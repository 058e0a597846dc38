"""Token codes and sub-word pieces against the libraries themselves."""

import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roamlens.llm import piece_trie as P
from roamlens.llm import token_codes as K
from roamlens.llm.common import new_folder
from roamlens.llm.queries import tokenizer_file

BPE, MODEL = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary files here")

ODD = ["", " ", "a   b", " a", "a \n b", "a\n \nb", "  \n  x  ", "a<|endoftext|> b", "it's  'll x\n\n\n y", "\t\ta", "é é", "日本語 テキスト",
       "a.\nb (c d$$$ 4.5 x", "x\n", "\nx ", "a_b", "▁x", "ﬁ Å ①", "x².y ².. 12345", "नमस्ते दुनिया", "😀 a😀b", "    code()", "\x1c a \x85 b"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def sentencepiece_model():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def enc():
    return K.Encoder(BPE)


@pytest.fixture(scope="module")
def vocabulary():
    return P.Pieces.load(MODEL)


def test_encoder_is_the_library(library, enc):
    got = enc.encode_all(ODD)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(x, add_special_tokens=False).ids for x in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé ß.,!\n\t'0日 ", max_size=40))
def test_encoder_on_any_text(library, enc, text):
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_new_words_skip_the_splitter(library, monkeypatch):
    """Words that no worker has seen go to the merge model; the costly whole way is for other texts."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäßéñðшяǅ", k=rng.randint(1, 14))) for _ in range(3000)]
    texts = [" ".join(words[i:i + 50]).capitalize() + ", (12) x.\nEnd" for i in range(0, 3000, 50)] + ["a   b"]
    own, pieces = K.Encoder(BPE), []
    whole = own._ids
    monkeypatch.setattr(own, "_ids", lambda some: (pieces.extend(some), whole(some))[1])
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)]
    assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert "a   b" in pieces and sum(len(p) for p in pieces) < 50


def test_kept_units_are_bounded(library):
    own = K.Encoder(BPE)
    own.units.most = 5
    text = " ".join(f"{a}{b} {a}" for a in "abcdefgh" for b in "xyz")
    for _ in range(2):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.units) <= 5 and len(own.units.old) <= 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1), max_size=1500))
def test_codes_random_access(ids):
    tf = K.TokenFile(K.pack_file([None], np.array([len(ids)]), np.array(ids, "<u4")))
    assert tf.document(0).tolist() == ids
    for i in range(0, len(ids), 97):
        assert tf.token(i) == ids[i]
    if len(ids) > 3:
        assert tf.tokens(1, len(ids) - 1).tolist() == ids[1:-1]


def test_token_files(make_docs, library):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(i % 7)) or None) for i in range(40)]
    rows += [(3, "again"), (3, "again"), (None, "no id"), (99, "long " * 30000), (98, "")]
    got = [tuple(r) for r in K.token_codes(make_docs(rows), BPE).orderBy("start").collect()]
    want, start = [], 0
    for i, t in got_order(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((g[0] if g[0] is not None else -1, g[2], g[3]) for g in got) == sorted((w[0] if w[0] is not None else -1, *w[1:]) for w in want)
    for i, begin, n, _ in got:
        assert begin == start
        start += n
    ids = [g[0] for g in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def got_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_files_hold_a_bounded_number_of_tokens(make_docs, library, spark):
    rows = [(i, f"w{i} " * (i % 9)) for i in range(200)] + [(500, "long " * 3000), (501, None)]
    docs, folder = make_docs(rows), new_folder(spark, "tokens")
    files = K.write_token_files(docs, BPE, folder, file_tokens=100)
    held = files.collect()
    assert all(r.n_tokens <= 100 or r.n_docs == 1 for r in held) and max(r.file for r in held) > 3
    assert len({r.path for r in held}) == len(held)
    key = ["doc_id", "start", "n_tokens", "ids_crc32"]
    one = K.token_codes(docs, BPE).orderBy("start").select(key).collect()
    assert K.read_token_files(files, folder).orderBy("start").select(key).collect() == one


def test_token_files_empty(make_docs):
    assert K.token_codes(make_docs([]), BPE).collect() == []


def test_pieces_are_the_library(vocabulary, sentencepiece_model):
    got = vocabulary.encode_all(ODD)
    assert [g.tolist() for g in got] == [sentencepiece_model.encode(x) for x in ODD]
    assert [vocabulary.decode(g.tolist()) for g in got] == [sentencepiece_model.decode(sentencepiece_model.encode(x)) for x in ODD]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="theinrou ▁.,'é\n1²日", max_size=60))
def test_pieces_on_any_text(vocabulary, sentencepiece_model, text):
    assert vocabulary.encode_all([text])[0].tolist() == sentencepiece_model.encode(text)


def test_unigram_walk_is_viterbi():
    rng = random.Random(5)
    for _ in range(40):
        scores = {c: -rng.random() * 9 for c in "ab"}
        scores |= {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 9 for _ in range(8)}
        v = P.Pieces(scores, {p: i for i, p in enumerate(scores)}, None, 99, bpe=False)
        units = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(30)})
        for s, parts in v.walk(units).items():
            best = [0.0] + [-1e99] * len(s)
            for i in range(1, len(s) + 1):
                for j in range(i):
                    p = s[j:i]
                    if p in scores or i - j == 1:
                        best[i] = max(best[i], best[j] + scores.get(p, -1e9))
            assert "".join(parts) == s
            assert sum(scores.get(p, -1e9) for p in parts) == pytest.approx(best[-1])


def test_encode_and_decode(make_docs, sentencepiece_model):
    rows = [(1, "The harbour opened."), (1, "The harbour opened."), (2, None), (3, ""), (None, "x  y\n"), (5, "ab " * 20000)]
    both = P.decode(P.encode(make_docs(rows), MODEL), MODEL).collect()
    assert sorted((r.doc_id or 0, r.text, tuple(r.ids)) for r in both) == sorted(
        (i or 0, t or "", tuple(sentencepiece_model.encode(t or ""))) for i, t in rows)
    assert P.encode(make_docs([]), MODEL).collect() == []
