"""Divergence of sources by one-hot level products.

Each language keeps the terms that enough of its documents hold.  A group is a (lang,
source) or a whole language; a term's smoothed rate in a group depends on the group and
on the term's count there, its *level*, alone.  So the divergence of two sources is a
sum over their joint table, the number of terms at each (level, level), priced once for
each cell in place of once for each term.

The joint tables of all pairs of sources are one matrix product: a row for each term, an
indicator column for each (source, level), multiplied by its transpose.  Terms are taken
in blocks of bounded size, the product of a block in tiles; its entries are whole numbers
up to the rows of a block, exact in single precision.  The tables of the blocks add up.

Level 0 needs no column.  With f(c, d) the price of levels c and d, a term counts as
  [f(c, d) - f(c, 0) - f(0, d) + f(0, 0)]  if both have it   (the joint table),
  [f(c, 0) - f(0, 0)] for the first, [f(0, d) - f(0, 0)] for the second  (the product's
  diagonal, how many terms a source has at each level),
  f(0, 0) always,
which adds up to its price whether it stands in both sources, in one or in none.
Prices are whole numbers throughout; nothing is rounded but by the floors of the rule.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.llm.common import materialise

#: What stands between terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Terms and entries of a block, cells of a product's tile.
BLOCK_TERMS, BLOCK_ENTRIES, TILE_CELLS = 256, 1 << 16, 1 << 22


# --- counts ----------------------------------------------------------------

def term_counts(docs: DataFrame) -> DataFrame:
    """lang, term, source, n (occurrences), docs (documents with the term), from lang,
    source and text.  A document's terms leave its row sorted, each with the one before
    it, so one pass counts both."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    terms = docs.select("lang", "source", F.sort_array(F.split(lower, BETWEEN)).alias("terms"))
    before = F.concat(F.array(F.lit("")), F.slice("terms", F.lit(1), F.size("terms") - 1))
    pairs = terms.select("lang", "source", F.inline(F.arrays_zip(F.col("terms").alias("term"), before.alias("before")))).filter("term != ''")
    first = F.when(F.col("term") != F.col("before"), 1).otherwise(0)
    return pairs.groupBy("lang", "term", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, levels (source and count wherever the term occurs) of the
    terms in enough documents of the language.  A term has as many levels as there
    are sources, of which every pair is a row of the result."""
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"),
                                              F.collect_list(F.struct("source", "n")).alias("levels"))
    return rows.filter(F.col("docs") >= least_docs).drop("docs")


# --- joint tables ----------------------------------------------------------

def blocks(size: np.ndarray, most_terms: int = BLOCK_TERMS, most_entries: int = BLOCK_ENTRIES) -> Iterator[tuple[int, int]]:
    """Runs of terms within both bounds (a term with more entries comes alone)."""
    at, entries = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and (i - at == most_terms or entries + n > most_entries):
            yield at, i
            at, entries = i, 0
        entries += n
    if at < len(size):
        yield at, len(size)


def level_product(term: np.ndarray, source: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """The joint tables of one block as (source, level, other source, other level,
    terms), source <= other: the indicator matrix's product with its transpose."""
    levels, place = np.unique(level, return_inverse=True)
    key, column = np.unique(source * len(levels) + place, return_inverse=True)
    hot = np.zeros((int(term.max()) + 1, len(key)), np.float32)
    hot[term, column] = 1
    found = []
    step = max(1, TILE_CELLS // len(key))
    for a in range(0, len(key), step):
        tile = hot[:, a:a + step].T @ hot[:, a:]
        i, j = np.nonzero(tile)
        upper = j >= i
        i, j = i[upper], j[upper]
        found.append((a + i, a + j, tile[i, j].astype(np.int64)))
    i, j, n = (np.concatenate(x) for x in zip(*found))
    a, c = np.divmod(key, len(levels))
    return a[i], levels[c[i]], a[j], levels[c[j]], n


def joint_tables(kept: DataFrame, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, a, level_a, b, level_b, terms for sources a <= b (in code points): how many
    terms stand at both levels.  The rows a = b have how many a source has at a level."""
    import pyarrow as pa

    def batches(it):
        for batch in it:
            if not batch.num_rows:
                continue
            lang, lists = batch.column(0).dictionary_encode(), batch.column(1)
            flat = lists.flatten()
            names = flat.field(0).dictionary_encode()
            order = sorted(range(len(names.dictionary)), key=lambda i, d=names.dictionary.to_pylist(): d[i])
            name_of = names.dictionary.take(pa.array(order, pa.int64()))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            source = rank[names.indices.to_numpy(zero_copy_only=False)]
            level = flat.field(1).to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            start = np.concatenate(([0], np.cumsum(size)))
            of = lang.indices.to_numpy(zero_copy_only=False)
            for k in range(len(lang.dictionary)):
                rows = np.flatnonzero(of == k)
                for x, y in blocks(size[rows], most_terms):
                    some = rows[x:y]
                    term = np.repeat(np.arange(y - x), size[some])
                    entry = np.repeat(start[some] - np.concatenate(([0], np.cumsum(size[some])[:-1])), size[some]) + np.arange(len(term))
                    a, c, b, d, n = level_product(term, source[entry], level[entry])
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(lang.dictionary[k], len(n)), name_of.take(pa.array(a)), pa.array(c), name_of.take(pa.array(b)), pa.array(d), pa.array(n)],
                        ["lang", "a", "level_a", "b", "level_b", "terms"])

    found = kept.select("lang", "levels").mapInArrow(batches, "lang string, a string, level_a long, b string, level_b long, terms long")
    return found.groupBy("lang", "a", "level_a", "b", "level_b").agg(F.sum("terms").alias("terms"))


# --- prices ----------------------------------------------------------------

def rate(count, total, kept, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 2) / (total + 2 * kept)); null where nothing is kept."""
    part = F.expr(f"CAST({scale} AS DECIMAL(18, 0)) * CAST({count} + 2 AS DECIMAL(19, 0)) DIV CAST({total} + 2 * {kept} AS DECIMAL(19, 0))")
    return F.when(F.col(kept) > 0, part + 1)


def price(p, q) -> Column:
    """floor((p - q)**2 / (p + q))."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV ({p} + {q})")


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n (the group's occurrences of kept terms), v (kept terms of the
    language), zero (the rate of a term that the group lacks) of every group."""
    groups = docs.select("lang", "source").distinct()
    n = kept.select("lang", F.inline("levels")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    rows = groups.join(n, ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["n", "v"])
    return rows.withColumn("zero", rate("0", "n", "v"))


def pair_values(kept: DataFrame, groups: DataFrame, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, item (each other source of the language), value."""
    def side(name: str) -> DataFrame:
        return groups.select("lang", *[F.col(c).alias(f"{c}_{name}") for c in ("source", "n", "v", "zero")])

    tables = materialise(joint_tables(kept, most_terms), "joint-tables")
    both = tables.filter("a < b").withColumnsRenamed({"a": "source_a", "b": "source_b"})
    both = both.join(side("a"), ["lang", "source_a"]).join(side("b"), ["lang", "source_b"])
    both = both.withColumn("p", rate("level_a", "n_a", "v_a")).withColumn("q", rate("level_b", "n_b", "v_b"))
    cell = price("p", "q") - price("p", "zero_b") - price("zero_a", "q") + price("zero_a", "zero_b")
    both = both.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), (F.col("terms") * cell).alias("value"))
    alone = tables.filter("a = b").withColumnRenamed("a", "source_a").join(side("a"), ["lang", "source_a"])
    alone = alone.withColumn("p", rate("level_a", "n_a", "v_a")).join(side("b"), "lang").filter("source_a != source_b")
    alone = alone.select("lang", F.least("source_a", "source_b").alias("source"), F.greatest("source_a", "source_b").alias("item"),
                         (F.col("terms") * (price("p", "zero_b") - price("zero_a", "zero_b"))).alias("value"))
    every = side("a").join(side("b"), "lang").filter("source_a < source_b").select(
        "lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"),
        F.coalesce(F.col("v_a") * price("zero_a", "zero_b"), F.lit(0)).alias("value"))
    half = both.unionByName(alone).unionByName(every).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return half.select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.*", "value")


def term_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each term with a higher rate in the group than in its whole
    language), value."""
    whole = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.max("v").alias("v_lang"))
    rows = kept.select("lang", "term", "total", F.inline("levels")).withColumnRenamed("n", "level")
    rows = rows.join(groups, ["lang", "source"]).join(whole, "lang")
    rows = rows.withColumn("p", rate("level", "n", "v")).withColumn("q", rate("total", "n_lang", "v_lang")).filter("p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), price("p", "q").alias("value"))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
                      least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank.  Part ``pair`` has each other source of the
    language with the divergence of the two, part ``term`` the ``top_terms`` terms that
    the source has most beyond its language.  Ranks go by value, then by item.

    A null text, language or source counts as the empty string.  Groups without terms
    are compared too, and a language that keeps no term gives pairs of value 0.
    Repeated rows count as often as they stand; other columns are not read."""
    src = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in
                        ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = materialise(kept_terms(term_counts(src), least_docs), "kept-terms")
    groups = materialise(group_table(src, kept), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups, most_terms).withColumn("rank", F.row_number().over(order))
    terms = term_values(kept, groups).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")
