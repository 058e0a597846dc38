"""Word vectors from co-occurrence counts."""

import hashlib
import math
from collections import Counter

import pytest

import __spark_entry__ as E
from roamlens.operators import embedding as EM


def plain(texts, dim, window, least):
    counts, near = Counter(), Counter()
    for w in texts:
        counts.update(w)
        for i, a in enumerate(w):
            for b in w[i + 1:i + 1 + window]:
                near[a, b] += 1
                near[b, a] += 1
    total, out = sum(counts.values()), {}
    for (a, b), n in near.items():
        if counts[a] >= least and counts[b] >= least:
            h = hashlib.md5(b.encode()).hexdigest()
            v = out.setdefault(a, [0.0] * dim)
            for d in range(dim):
                v[d] += n * math.log(total / counts[b]) * ((int(h[d // 4], 16) >> d % 4 & 1) * 2 - 1)
    return {a: [x / math.hypot(*v) for x in v] for a, v in out.items() if any(v)}


@pytest.mark.parametrize("dim, window, least", [(64, 2, 1), (8, 1, 2), (128, 5, 3)])
def test_word_vectors(spark, dim, window, least):
    texts = [("sea wind sea salt " * 4).split(), "sea 好 wind".split(), ["alone"], [], "wind wind salt 好".split(), None]
    df = spark.createDataFrame([(t,) for t in texts], "words array<string>")
    got = {r.word: r.vec for r in EM.word_vectors(df, "words", dim, window, least).collect()}
    want = plain([t or [] for t in texts], dim, window, least)
    assert set(got) == set(want)
    for w, v in want.items():
        assert got[w] == pytest.approx(v, abs=1e-12)


def test_too_many_dimensions():
    with pytest.raises(ValueError):
        EM.direction("word", 129)


def test_chain_beats_the_larger_class(spark):
    """Held-out accuracy above the share of the larger class, AUC well above chance."""
    sf = "/root/testdata/sf0.01"
    r = E.queries()["embedding_chain"](spark, sf).first()
    share = [x["count"] for x in spark.read.parquet(f"{sf}/labels.parquet").groupBy("quality").count().collect()]
    assert r.n > 50 and r.auc > 0.65 and r.accuracy > max(share) / sum(share)
