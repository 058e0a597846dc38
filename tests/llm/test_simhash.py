"""SimHash near-duplicates against a plain version and all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from roamlens.llm import queries, simhash as S
from roamlens.llm.common import load

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(points):
    """Smallest id reachable, of (id, fingerprint) rows; an id is one vertex."""
    parent = {i: i for i, _ in points}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(points):
        for j, b in points[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


def family(rng, base, n, most):
    out = set()
    for _ in range(n):
        x = base
        for b in rng.sample(range(64), rng.randint(1, most)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize("crowded", [0, 8, 1024])
def test_links_are_those_of_all_pairs(spark, crowded):
    """Families of 2 to 12 flipped bits, some beyond the bound of a joined bucket."""
    rng = random.Random(5)
    points = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 7, 15}
    for most in (3, 5, 12):
        points |= family(rng, rng.getrandbits(64), 40, most)
    points = sorted(points)
    df = spark.createDataFrame([(as_long(p),) for p in points], "fp long")
    got = {r.v % (1 << 64): r.label % (1 << 64) for r in S.links(df, crowded=crowded).collect()}
    want = plain_components([(i, p) for i, p in enumerate(points)])
    groups = Counter(want.values())
    linked = {points[i]: c for i, c in want.items() if groups[c] > 1}
    assert set(got) == set(linked)
    assert len(set(zip(got.values(), (linked[p] for p in got)))) == len(set(got.values())) == len(set(linked.values()))


def test_masks_meet_every_link():
    masks = [m % (1 << 64) for m in S.block_masks()]
    assert len(masks) == 20
    rng = random.Random(1)
    for _ in range(500):
        flipped = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & flipped == 0 for m in masks)


def test_fingerprints_of_odd_texts():
    rng = random.Random(2)
    texts = ["", " \n", "A", "a b", "A  B\tC", "a b c", "é Ü x y z " * 50, "word" * 40000, "\x00 \x1f b", "a b a b a b a b"]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    assert S.fingerprints([t.encode() for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]
    assert S.fingerprints(["a b c".encode()])[0] == S.fingerprints(["A\n\nB C ".encode()])[0]


def test_near_duplicates(make_docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(300)]
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(100, 160)]
    for i in range(200, 240):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    rows += [(1, None), (2, ""), (3, " \n "), (5, rows[0][1]), (5, rows[0][1]), (6, rows[3][1].upper()), (7, rows[5][1]), (7, rows[9][1]),
             (7, rows[11][1]), (None, rows[0][1]), (None, None), (8, "long " * 30000), (9, "x" * 300000)]
    got = S.near_duplicates(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{plain_fingerprint(t):016x}") for i, t in rows)
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows if i is not None])
    assert len(set(want.values())) < len(want) - 20
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}
    assert S.near_duplicates(make_docs([])).collect() == []


def test_query(spark):
    got = queries.QUERIES["op12_simhash_blocks"](spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    rows = load(spark, SF, "documents").select("doc_id", "text").collect()
    points = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    home = plain_components(points)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == {(i, f"{p:016x}", home[i]) for i, p in points}


def test_bad_blocks(make_docs):
    with pytest.raises(ValueError):
        S.near_duplicates(make_docs([(1, "a")]), blocks=3)
    assert len(np.unique(S.block_masks(7, 3))) == 35
