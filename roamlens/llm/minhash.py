"""Near-duplicates by min-max hashing.

A document's set holds the distinct 5-word shingles of its lower-cased text (a
shorter text is one shingle).  Each of 64 permutations gives two values of the
set, the smallest and the largest, so 128 signature values cost 64 evaluations;
the estimate stays unbiased and its variance is that of 128 values.  A band is
two smallest and two largest values of four different permutations.

1. equal sets become one class (named by its smallest id), so copies cost a row;
2. classes that share a band fall into a bucket, whose members are checked on
   their full sets against two leaders: the smallest id (the same in many buckets)
   and a random one (another in each bucket);
3. buckets that still hold several components are checked against a third leader,
   the member with the smallest share of own shingles (those that no other open
   member has), which stands nearest to the middle of a family of copies;
4. only members of a bucket that are still in different components and were not
   checked yet are paired; no pair is formed inside a component, and none twice: a pair
   meets in the smallest key that both share.  Own shingles bound the similarity to any
   other open member, and a pair whose bound stays below the threshold is not formed
   either.  Open members also get one bit of 1,024 further min-max values each; a pair
   whose bits put its similarity below 0.65 is not formed (at 0.75 the estimate has a
   standard deviation of 0.021, so this happens with probability below 1e-6);
5. components come from alternating large-star and small-star steps.

A link at similarity 0.75 shares none of the 32 bands with probability
``(1 - 0.75**4) ** 32 < 6e-6``.  Sizes that rule a link out are never compared.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import Words, materialise, mix64, text_chunks, utf8

SHINGLE = 5
PERMUTATIONS = 64
BANDS = 32
PERCENT = 75
SEED = 1105
#: One-bit signatures of open members: permutations (two bits each), the least estimate.
SKETCH, SKETCH_LEAST = 512, 0.65
_STEP = np.array([pow(0xC2B2AE3D27D4EB4F, j, 1 << 64) for j in range(1, 33)], np.uint64)


# --- one text --------------------------------------------------------------

def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all shingles, text after text, and each text's first."""
    n = np.diff(words.first)
    h = np.concatenate((words.hash, np.zeros(size, np.uint64)))
    mixed = np.zeros(len(words), np.uint64)
    left = (words.first[1:][words.doc] - np.arange(len(words))) if len(words) else np.zeros(0, np.int64)
    short = n[words.doc] < size if len(words) else np.zeros(0, bool)
    for j in range(size):
        inside = ~short | (left > j)  # a short text's shingle ends with the text
        mixed += np.where(inside, h[j:j + len(words)] * _STEP[j], np.uint64(0))
    mixed += np.minimum(left, size).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    whole = left >= size
    at_start = np.zeros(len(words), bool)
    at_start[words.first[:-1][n > 0]] = True
    use = whole | (short & at_start)
    first = np.searchsorted(words.doc[use], np.arange(len(n) + 1))
    return mix64(mixed[use]), first


def distinct_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = shingles(Words(texts, lower=True), size)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]


def signatures(h: np.ndarray, first: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value under each permutation, for texts with shingles."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low, high = (np.empty((len(first), PERMUTATIONS), np.uint64) for _ in range(2))
    for k in range(PERMUTATIONS):
        v = h * mult[k]
        v ^= v >> np.uint64(29)
        low[:, k], high[:, k] = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: two smallest and two largest values."""
    j = np.arange(BANDS)
    a, b = 2 * j, 2 * j + 1
    c, d = (a + PERMUTATIONS // 2) % PERMUTATIONS, (b + PERMUTATIONS // 2) % PERMUTATIONS
    key = low[:, a] * _STEP[0] + low[:, b] * _STEP[1] + high[:, c] * _STEP[2] + high[:, d] * _STEP[3]
    return mix64(key + _STEP[j] * np.uint64(3))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on whole sets."""
    lo, hi = sorted((len(a), len(b)))
    if not lo or 100 * lo < percent * hi:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (lo + hi - both)


# --- the corpus ------------------------------------------------------------

#: Of the two halves of a set's name: sums of its salted and mixed shingles.
SALTS = (0x1234567890ABCDEF, 0x0FEDCBA987654321)


def set_table(docs: DataFrame) -> DataFrame:
    """id, n_shingles, a 128-bit name of the set (h1, h2) and its band keys."""
    import pyarrow as pa

    def batches(it):
        for batch in it:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for at, part in text_chunks(texts):
                h, first = shingles(Words(part, lower=True))
                n = np.diff(first)
                size, names = np.zeros(len(part), np.int64), np.zeros((2, len(part)), np.uint64)
                keys = np.zeros((len(part), BANDS), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    keys[full] = band_keys(*signatures(h, first[:-1][full]))
                    owner = np.repeat(np.arange(len(part)), n)
                    order = np.lexsort((h, owner))
                    hs = h[order]  # owners are in order already
                    new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (owner[1:] != owner[:-1])))
                    size = np.bincount(owner[new], minlength=len(part))
                    start = np.searchsorted(owner[new], full)
                    for i, salt in enumerate(SALTS):
                        names[i, full] = np.add.reduceat(mix64(hs[new] + np.uint64(salt)), start)
                offsets = np.arange(0, (len(part) + 1) * BANDS, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), pa.array(size, pa.int64()), pa.array(names[0].view(np.int64)),
                     pa.array(names[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).ravel()))],
                    ["id", "n_shingles", "h1", "h2", "bands"])

    return docs.mapInArrow(batches, "id long, n_shingles long, h1 long, h2 long, bands array<long>")


def check_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, linked: the pairs' whole sets compared.  A leader in many pairs is a hot
    key of the second join, which AQE splits; its set is kept from row to row."""
    import pyarrow as pa

    def batches(it):
        name, kept = None, None
        for batch in it:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            right = utf8(batch.column(2))
            ok = []
            for at, part in text_chunks(right):
                for i, s in enumerate(distinct_sets(part), at):
                    if name is None or name[0] != a[i] or name[1] != (text := batch.column(3)[i]):
                        text = batch.column(3)[i]
                        name, kept = (a[i], text), distinct_sets([(text.as_py() or "").encode()])[0]
                    ok.append(linked(kept, s))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(ok)],
                                             ["a", "b", "linked"])

    texts_b = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    texts_a = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(texts_b, "b").join(texts_a, "a").select("a", "b", "text_b", "text_a")
    return rows.mapInArrow(batches, "a long, b long, linked boolean")


def own_shingles(members: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, h1, own: how many shingles of each member's set no other text of a member
    has.  An id with several texts has a row for each set; equal texts count their
    shingles again, which only loosens the bound."""
    import pyarrow as pa

    def batches(it):
        for b in it:
            for at, part in text_chunks(utf8(b.column(1))):
                found = distinct_sets(part)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
                names = np.array([np.add.reduce(mix64(x + np.uint64(SALTS[0]))) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(names),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["rep", "h1", "h"])

    texts = docs.join(members.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "text")
    each = texts.mapInArrow(batches, "rep long, h1 long, h array<long>").select("rep", "h1", F.explode("h").alias("h"))
    single = each.groupBy("h").agg(F.min("rep").alias("rep"), F.min("h1").alias("h1"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    return single.groupBy("rep", "h1").agg(F.count(F.lit(1)).alias("own"))


def sketches(h: np.ndarray, first: np.ndarray, seed: int = SEED + 1) -> np.ndarray:
    """One bit of the smallest and the largest value under each of ``SKETCH``
    permutations, for texts with shingles, as rows of 64-bit words."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = np.empty((len(first), 2 * SKETCH), np.uint8)
    for k in range(SKETCH):
        v = h * mult[k]
        v ^= v >> np.uint64(29)
        bits[:, 2 * k] = mix64(np.minimum.reduceat(v, first)) >> np.uint64(63)
        bits[:, 2 * k + 1] = mix64(np.maximum.reduceat(v, first)) >> np.uint64(63)
    return np.packbits(bits, axis=1).view(np.int64)


def sketch_table(members: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, h1, sketch (an array of 64-bit words) of each text of a member."""
    import pyarrow as pa

    def batches(it):
        for b in it:
            for at, part in text_chunks(utf8(b.column(1))):
                h, first = shingles(Words(part, lower=True))
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                found = sketches(h, first[:-1][full])
                names = np.array([np.add.reduce(mix64(np.unique(h[a:b]) + np.uint64(SALTS[0]))) for a, b in zip(first[:-1][full], first[1:][full])], np.uint64)
                offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)).take(pa.array(full)), pa.array(names.view(np.int64)),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], ["rep", "h1", "sketch"])

    texts = docs.join(members.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "text")
    return texts.mapInArrow(batches, "rep long, h1 long, sketch array<long>").dropDuplicates(["rep", "h1"])


def components(edges: DataFrame) -> DataFrame:
    """v, label: the smallest vertex reachable, for every vertex of an edge (u, v),
    by alternating large-star and small-star steps until all edges form stars."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.filter("v < u")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        own = least.select(F.col("u").alias("u"), F.col("m").alias("v")).filter("u != v")
        moved = near.filter("v > u") if large else near
        moved = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        return (moved if large else moved.union(own)).distinct()

    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    while True:
        e = materialise(star(star(e, True), False), "star-edges")
        # Done when every vertex has one edge, to a vertex that has none itself.
        inner = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
        if inner.isEmpty() and e.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a != b").isEmpty():
            break
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.union(roots).groupBy(F.col("u").alias("v")).agg(F.min("v").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id
    reachable over links) and kept (id = component_id).

    Texts without words (null, empty) are alone.  Rows with a null id are named by
    no component: theirs is null and they stay.  Equal ids are one vertex, so
    repeated rows share a component.  Other columns are not read."""
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    sets = materialise(set_table(src), "shingle-sets")
    named = sets.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = materialise(
        named.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "set-classes")
    # Equal ids with different texts tie their classes together.
    ties = named.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).filter("x != y")
    ties = named.join(ties.select("id"), "id").join(classes.select("h1", "h2", "n_shingles", "rep"), ["h1", "h2", "n_shingles"])
    edges = [materialise(ties.select(F.col("id").alias("u"), F.col("rep").alias("v")), "id-ties")]
    texts = src.filter("id IS NOT NULL")

    def checked(pairs: DataFrame) -> DataFrame:
        """Each pair once, smaller id first, without those whose sizes rule a link out."""
        pairs = pairs.filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
        pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        return pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")

    def settle(pairs: DataFrame) -> DataFrame:
        found = materialise(check_pairs(materialise(pairs, "candidate-pairs"), texts), "checked-pairs")
        edges.append(found.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        return found.select("a", "b")

    # All members against two leaders of their bucket.
    done = None
    flat = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    some = F.struct(F.xxhash64("key", "rep").alias("place"), "rep", "n")
    leads = flat.groupBy("key").agg(F.min(F.struct(F.col("rep").alias("place"), "rep", "n")).alias("x"), F.min(some).alias("y"),
                                    F.count(F.lit(1)).alias("members")).filter("members > 1")
    pairs = flat.join(leads, "key").withColumn("lead", F.explode(F.array("x", "y"))).filter("rep != lead.rep")
    done = settle(checked(pairs.select(F.col("lead.rep").alias("p"), F.col("rep").alias("q"), F.col("lead.n").alias("na"),
                                       F.col("n").alias("nb"))))
    label = materialise(components(reduce(DataFrame.union, edges)), "labels")
    # What no leader has settled: buckets of several components, across components only.
    flat = classes.select("rep", "h1", F.col("n_shingles").alias("n"), "bands").join(label.withColumnRenamed("v", "rep"), "rep", "left")
    flat = flat.select("rep", "h1", "n", F.coalesce("label", "rep").alias("label"), "bands").select("*", F.explode("bands").alias("key")).drop("bands")
    open_ = flat.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("members"))
    rest = materialise(flat.join(open_.filter("l0 != l1 AND members > 2").select("key"), "key"), "open-buckets")
    if not rest.isEmpty():
        members = materialise(rest.select("rep").distinct(), "open-ids")
        own = own_shingles(members, texts)
        rest = rest.join(own, ["rep", "h1"], "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0)))
        rest = materialise(rest, "open-members")
        # First against a third leader, the member with the smallest share of own shingles.
        central = rest.groupBy("key").agg(F.min(F.struct((-F.col("most") / F.col("n")).alias("place"), "rep", "n", "label")).alias("lead"))
        pairs = rest.join(central, "key").filter("label != lead.label")
        done = done.union(settle(checked(pairs.select(F.col("lead.rep").alias("p"), F.col("rep").alias("q"),
                                                      F.col("lead.n").alias("na"), F.col("n").alias("nb")))))
        label = materialise(components(reduce(DataFrame.union, edges)), "labels")
        rest = rest.drop("label").join(label.withColumnRenamed("v", "rep"), "rep", "left")
        rest = rest.withColumn("label", F.coalesce("label", "rep"))
        keys = classes.select("rep", "h1", F.array_sort("bands").alias("bands"))
        profile = materialise(sketch_table(members, texts).join(keys, ["rep", "h1"]), "open-sketches")
        rest = rest.join(profile, ["rep", "h1"])
        other = rest.select("key", F.col("rep").alias("q"), F.col("n").alias("nb"), F.col("label").alias("label_b"),
                            F.col("most").alias("most_b"), F.col("bands").alias("bands_b"), F.col("sketch").alias("sketch_b"))
        # The intersection holds no own shingle of either side.
        both = F.least("most", "most_b")
        near = (F.col("label") < F.col("label_b")) & (100 * both >= PERCENT * (F.col("n") + F.col("nb") - both))
        near = near & (100 * F.least("n", "nb") >= PERCENT * F.greatest("n", "nb"))
        unlike = sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH // 32))
        near = near & (1 - unlike / SKETCH >= SKETCH_LEAST)  # of 2 * SKETCH bits, half of those of unlike values agree
        near = near & (F.col("key") == F.array_min(F.array_intersect("bands", "bands_b")))
        pairs = rest.join(other.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & near)
        settle(checked(pairs.select(F.col("rep").alias("p"), "q", F.col("n").alias("na"), "nb")))
        label = components(reduce(DataFrame.union, edges))
    home = classes.select("h1", "h2", F.col("n_shingles").alias("n"), "rep").join(label.withColumnRenamed("v", "rep"), "rep", "left")
    home = home.select("h1", "h2", "n", F.coalesce("label", "rep").alias("component"))
    out = sets.select("id", "n_shingles", "h1", "h2").join(
        home.withColumnRenamed("n", "n_shingles"), ["h1", "h2", "n_shingles"], "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", found.alias("component_id"),
                      F.col("id").eqNullSafe(found).alias("kept"))
