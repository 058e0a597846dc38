"""Word segmentation of unspaced text by a dictionary.

A run of letters is cut where the sum of its words' weights, the logarithms of their
relative frequencies, is greatest; a letter on its own counts like a word seen once.
Of equally good paths the one with the longer first word is taken.

The dictionary is written once and its size checked.  Up to MOST_WORDS words of MOST_LETTERS
letters go to the tasks, where an Arrow function cuts each distinct run of a batch once:
nothing is shuffled.  A larger one stays a table: the substrings of every distinct run, up to
the longest word, are equi-joined with it; the hits come back as an array with one entry for
each letter, and a fold from the last letter to the first keeps the best weight of as many
letters to come as the longest word has, and the length of the word that begins here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.functions.columns import runs_of
from roamlens.session import cut_lineage, ship_package

#: What stands between runs: all but letters.
BETWEEN = r"\P{L}+"
#: A dictionary within both goes to the tasks (about 30 MB in each Python worker).
MOST_WORDS, MOST_LETTERS = 200_000, 2_000_000


def best_cut(run: str, weights: dict[str, float], alone: float, longest: int) -> list[str]:
    """The words of the best path of one run; ``alone`` is the weight of a single letter."""
    n = len(run)
    best, size = [0.0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        top = alone + best[i + 1]
        for k in range(1, min(longest, n - i) + 1):
            w = weights.get(run[i:i + k])
            if w is not None and w + best[i + k] >= top:
                top, size[i] = w + best[i + k], k
        best[i] = top
    out, i = [], 0
    while i < n:
        out.append(run[i:i + size[i]])
        i += size[i]
    return out


def _cutter(weights: dict[str, float], ln: float, longest: int):
    """Column function: arrays of runs to arrays of their words, null to null."""
    @F.arrow_udf("array<string>")
    def words(runs: pa.Array) -> pa.Array:
        def ends(lists):
            return np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))

        each = runs.flatten().dictionary_encode()
        cuts = pa.array([best_cut(r, weights, -ln, longest) for r in each.dictionary.to_pylist()], pa.list_(pa.string()))
        found = cuts.take(each.indices)
        at = pa.array(ends(found)[ends(runs)], pa.int32())
        return pa.ListArray.from_arrays(at, found.flatten(), mask=runs.is_null())

    return words


def _paths(runs: DataFrame, dictionary: DataFrame, run: str) -> DataFrame:
    """``run``, ``__len``: the word lengths of the best path of each distinct run."""
    stats = dictionary.agg(F.struct(F.max(F.length("word")).alias("longest"), F.log(F.sum("freq").cast("double")).alias("ln")))
    stats = stats.scalar()
    chars = runs.select(run, F.length(run).alias("__n")).withColumn("__s", stats)
    longest = F.greatest(F.coalesce(F.col("__s.longest"), F.lit(1)), F.lit(1))
    at = F.explode(F.sequence(F.lit(1), F.col("__n")))
    starts = chars.select(run, "__n", longest.alias("__most"), F.coalesce("__s.ln", F.lit(0.0)).alias("__ln"), at.alias("__i"))
    sizes = F.sequence(F.lit(1), F.least(F.col("__most"), F.col("__n") - F.col("__i") + 1))
    subs = starts.select("*", F.explode(sizes).alias("__l")).withColumn("__w", F.substring(F.col(run), F.col("__i"), F.col("__l")))
    known = dictionary.select(F.col("word").alias("__w"), F.log(F.col("freq").cast("double")).alias("__f"))
    hits = subs.join(known, "__w").select(run, "__i", F.struct((F.col("__f") - F.col("__ln")).alias("s"), F.col("__l").alias("l")).alias("__h"))
    alone = starts.select(run, "__i", F.struct((-F.col("__ln")).alias("s"), F.lit(1).alias("l")).alias("__h"))
    # A known letter is a hit as well; the greater of the two counts.
    each = hits.unionByName(alone).groupBy(run, "__i").agg(F.collect_list("__h").alias("__h"))
    lines = each.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("__i", "__h")), asc=False).alias("__a"))
    lines = lines.withColumn("__most", F.greatest(F.coalesce(stats["longest"], F.lit(1)), F.lit(1)))
    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array().cast("array<int>").alias("len"))

    def step(acc, x):
        top = F.array_max(F.transform(x["__h"], lambda h: F.struct((h["s"] + F.element_at(acc["best"], h["l"])).alias("s"), h["l"].alias("l"))))
        best = F.slice(F.concat(F.array(top["s"]), acc["best"]), F.lit(1), F.col("__most"))
        return F.struct(best.alias("best"), F.concat(F.array(top["l"]), acc["len"]).alias("len"))

    return lines.select(run, F.aggregate("__a", start, step)["len"].alias("__len"))


def _words(run: str, lens: str):
    """The words of a run from the lengths of the words that begin at its letters."""
    at = F.aggregate(F.sequence(F.lit(1), F.size(lens)), F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts")),
                     lambda acc, i: F.when(i == acc["next"], F.struct(
                         (i + F.element_at(lens, i)).alias("next"), F.concat(acc["starts"], F.array(i)).alias("starts"))).otherwise(acc))
    return F.transform(at["starts"], lambda i: F.substring(F.col(run), i, F.element_at(lens, i)))


def segment(df: DataFrame, key: str, text: str, dictionary: DataFrame, out: str = "words", word_col: str = "word",
            freq_col: str = "freq", most_words: int = MOST_WORDS) -> DataFrame:
    """``df`` with the words of ``text`` in ``out``.  ``key`` names a row.  ``dictionary`` has
    words and how often they were seen (a word given twice counts the sum; words of
    other characters than letters meet nothing).  One of more than ``most_words`` stays a table."""
    d = dictionary.select(F.lower(word_col).alias("word"), F.col(freq_col).alias("freq")).filter("word != '' AND freq > 0")
    d = cut_lineage(d.groupBy("word").agg(F.sum("freq").alias("freq")))
    size = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("letters"), F.max(F.length("word")).alias("longest"),
                 F.log(F.sum("freq").cast("double")).alias("ln")).first()
    if size.n <= most_words and (size.letters or 0) <= MOST_LETTERS:
        ship_package(df.sparkSession)
        weights = d.select("word", (F.log(F.col("freq").cast("double")) - F.lit(size.ln or 0.0)).alias("w"))
        cut = _cutter({r.word: r.w for r in weights.toLocalIterator()}, size.ln or 0.0, size.longest or 1)
        return df.withColumn(out, cut(runs_of(F.lower(text), BETWEEN)))
    runs = df.select(key, F.posexplode(runs_of(F.lower(text), BETWEEN)).alias("__p", "__run"))
    paths = _paths(runs.select("__run").distinct(), d, "__run")
    pieces = paths.select("__run", _words("__run", "__len").alias("__words"))
    parts = runs.join(pieces, "__run").groupBy(key).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("__p", "__words"))), lambda s: s["__words"])).alias(out))
    none = F.when(F.col(text).isNotNull(), F.array().cast("array<string>"))
    return df.drop(out).join(parts, key, "left").withColumn(out, F.coalesce(out, none))
