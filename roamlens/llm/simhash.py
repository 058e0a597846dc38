"""Near-duplicates by SimHash, found through pigeonhole blocks.

A text's fingerprint has a bit set where over half of the XXH64 values of its 3-word
shingles (repeats included) have it set.  Fingerprints link at ``MOST_BITS`` or fewer
differing bits.

1. Texts with one fingerprint become one vertex, so copies cost a row.
2. The 64 bits fall into ``BLOCKS`` blocks.  ``MOST_BITS`` differing bits touch at most
   as many blocks, so two linked fingerprints agree on at least ``BLOCKS - MOST_BITS``
   whole blocks: each choice of that many blocks (20 choices, 31 to 33 bits) is a key.
3. Members of a bucket are verified against its leader, the smallest fingerprint.
   This links most of a family in rows linear in its size.
4. Buckets that still hold several components are joined on the key across components
   only, the Hamming distance being part of the join condition.
5. A bucket of more than ``CROWDED`` open members is not joined with itself.  Each of
   its fingerprints names the points within two bits.  Two fingerprints link exactly
   if some point lies within one bit of one and within two bits of the other; so at
   each point all that name it link to the smallest one within one bit.  That is as
   exact as the join, and linear in the members.
6. Components come from large-star and small-star steps.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import Words, materialise, text_chunks, utf8
from roamlens.llm.minhash import components

SHINGLE = 3
SEED = 42
MOST_BITS = 3
BLOCKS = 6
#: Beyond so many members, naming 2,081 points costs less than comparing with the half of them.
CROWDED = 1024


# --- one text --------------------------------------------------------------

def shingle_hashes(texts: list[bytes], size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of every shingle, text after text, and the first of each text (and
    the end).  A text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = Words(texts, lower=True)
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    solid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    keep = solid.copy()
    keep[words.end] = True  # one blank after each word
    data = np.where(solid, words.data, np.uint8(0x20))[keep].tobytes()
    place = np.cumsum(keep) - 1
    start, end = place[words.start], place[words.end]
    n = np.diff(words.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(count)))
    a = np.repeat(words.first[:-1] - first[:-1], count) + np.arange(first[-1])
    b = np.minimum(a + size, np.repeat(words.first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(start[a].tolist(), end[b].tolist())
    return np.fromiter((digest(data[x:y], seed) for x, y in spans), np.uint64, len(a)), first


def fingerprints(texts: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text, 0 without words."""
    h, first = shingle_hashes(texts, size, seed)
    n, out = np.diff(first), np.zeros(len(texts), np.uint64)
    ones = np.zeros((len(texts), 64), np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    for at in range(0, len(h), 1 << 16):  # bits of so many shingles at once
        part = owner[at:at + (1 << 16)]
        bits = np.unpackbits(h[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        new = np.flatnonzero(np.diff(part, prepend=-1))
        ones[part[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.packbits(2 * ones[full] > n[full, None], axis=1).view(">u8").ravel()
    return out


def fingerprint_table(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, fp (the fingerprint as a signed long) of each (id, text) row."""
    import pyarrow as pa

    def batches(it):
        for b in it:
            ids, texts = b.column(0), utf8(b.column(1))
            for at, part in text_chunks(texts):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(fingerprints(part, size, seed).view(np.int64))], ["id", "fp"])

    return docs.mapInArrow(batches, "id long, fp long")


# --- links -----------------------------------------------------------------

def block_masks(blocks: int = BLOCKS, most_bits: int = MOST_BITS) -> list[int]:
    """The bits of each choice of ``blocks - most_bits`` blocks, as signed longs."""
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:])]
    masks = [sum(x) for x in combinations(part, blocks - most_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hamming(a, b) -> Column:
    """Differing bits of two long columns."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _edges(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.select(F.col(u).alias("u"), F.col(v).alias("v"))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """The component of each row's fingerprint (its own name if it has no link)."""
    found = rows.drop("label").join(label.withColumnRenamed("v", "fp"), "fp", "left")
    return found.withColumn("label", F.coalesce("label", "fp"))


def midpoint_links(members: DataFrame) -> DataFrame:
    """Edges (u, v) with the components of all pairs of ``members.fp`` at three or
    fewer differing bits: stars around the points within one bit of a member and two
    of another."""
    bit = lambda i: F.when(F.col(i) < 64, F.expr(f"shiftleft(1L, {i})")).otherwise(F.lit(0))  # noqa: E731  64: no bit
    flips = members.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    flips = flips.withColumn("j", F.explode(F.sequence(F.least(F.col("i") + 1, F.lit(64)), F.lit(64))))
    near = flips.select("fp", F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("point"), (F.col("j") == 64).alias("one"))
    centre = near.groupBy("point").agg(F.min(F.when(F.col("one"), F.col("fp"))).alias("centre"), F.count(F.lit(1)).alias("n"))
    stars = near.join(centre.filter("n > 1 AND centre IS NOT NULL"), "point").filter("fp != centre")
    return _edges(stars, "fp", "centre").distinct()


def links(points: DataFrame, blocks: int = BLOCKS, most_bits: int = MOST_BITS, crowded: int = CROWDED) -> DataFrame:
    """v, label: the smallest fingerprint (as a long) reachable over links, for each
    fingerprint of ``points.fp`` (distinct) that has a link."""
    masks = block_masks(blocks, most_bits)
    keys = F.array(*[F.struct(F.lit(k).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("part"))
                     for k, m in enumerate(masks)])
    flat = points.select("fp", F.inline(keys))
    leads = flat.groupBy("choice", "part").agg(F.min("fp").alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialise(flat.join(leads, ["choice", "part"]), "shared-blocks")
    edges = [_edges(shared.filter(F.col("fp") != F.col("lead")).filter(hamming("fp", "lead") <= most_bits), "fp", "lead").distinct()]
    label = materialise(components(edges[0]), "labels")
    # What no leader has settled: buckets of several components, across components only.
    rows = _labelled(shared, label)
    several = rows.groupBy("choice", "part").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 != l1")
    rest = materialise(rows.join(several.select("choice", "part"), ["choice", "part"]).drop("lead"), "open-blocks")
    few = rest.filter(F.col("members") <= crowded)
    other = few.select("choice", "part", F.col("fp").alias("fp_b"), F.col("label").alias("label_b"))
    pairs = few.join(other, ["choice", "part"]).filter((F.col("label") < F.col("label_b")) & (hamming("fp", "fp_b") <= most_bits))
    edges.append(materialise(_edges(pairs, "fp", "fp_b").distinct(), "open-pairs"))
    full = rest.filter(F.col("members") > crowded).select("fp").distinct()
    if not full.isEmpty():
        if most_bits != 3:
            raise ValueError("crowded blocks are settled for three differing bits")
        edges.append(materialise(midpoint_links(full), "open-stars"))
    return components(reduce(DataFrame.union, edges))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED,
                    blocks: int = BLOCKS, most_bits: int = MOST_BITS, crowded: int = CROWDED) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits) and component_id,
    the smallest id reachable over links.

    Texts without words (null, empty) have fingerprint zero, linked like any other.
    Rows with a null id name nothing and link nothing: their component is null.
    Equal ids are one vertex, so different texts under one id share a component.
    Other columns are not read."""
    if not 0 < most_bits < blocks:
        raise ValueError("there must be more blocks than differing bits")
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    table = materialise(fingerprint_table(src, size, seed), "fingerprints")
    named = table.filter("id IS NOT NULL")
    points = materialise(named.groupBy("fp").agg(F.min("id").alias("rep")), "points")
    label = links(points.select("fp"), blocks, most_bits, crowded)
    # Equal ids with different texts tie their fingerprints together.
    ties = named.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x != y")
    ties = materialise(named.join(ties.select("id", "x"), "id").filter("fp != x").select(F.col("fp").alias("u"), F.col("x").alias("v")).distinct(), "id-ties")
    if not ties.isEmpty():
        label = components(_edges(label, "v", "label").union(ties))
    home = _labelled(points, label)
    least = home.groupBy("label").agg(F.min("rep").alias("component_id"))
    home = materialise(home.join(least, "label").select("fp", "component_id"), "homes")
    out = table.join(home, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
