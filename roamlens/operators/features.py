"""Feature selection: bag of words, bigrams, chi-square scores, best words
(SURVEY N4–N9, W2, T2, T3, U2, F1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions.columns import chi_sq, col_, pmi, round6
from roamlens.operators.blocks import ends, runs
from roamlens.operators.ordering import top_k_per_group
from roamlens.session import ship_package


#: Tokens of the rows whose pairs are counted at once: a batch may hold thousands of documents.
AT_ONCE = 1 << 18


def bag_of_words(words) -> Column:
    """The set of words (``{word: True}``)."""
    return F.array_distinct(col_(words))


def bigrams(words) -> Column:
    """Adjacent pairs inside one token array (never across documents),
    as ``array<struct<w1,w2>>``; no shuffle."""
    w = col_(words)
    n = F.size(w)
    # arrays_zip + a positional struct cast stay in generated code (a
    # zip_with lambda would be interpreted per element)
    t = "array<struct<w1:string,w2:string>>"
    return F.when(n >= 2, F.arrays_zip(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1)).cast(t)) \
            .otherwise(F.array().cast(t))


def bigram_strings(words, sep: str = "_") -> Column:
    """Bigrams rendered as single feature strings ``w1_w2``."""
    return F.transform(bigrams(words), lambda b: F.concat_ws(sep, b["w1"], b["w2"]))


def word_and_bigram_features(words, sep: str = "_") -> Column:
    """Words ∪ bigram features."""
    return F.concat(col_(words), bigram_strings(words, sep))


def class_scores(df: DataFrame, features: str, label: str, positive=1, out: str = "score") -> DataFrame:
    """N7/N8 (+A13–A15): informativeness of each feature for the label =
    chi²(feature, positive class) + chi²(feature, negative class), from token
    counts.  Class totals are scalar subqueries over the (vocabulary-sized)
    count table."""
    ex = df.select(F.col(label).alias("__y"), F.explode(features).alias("word"))
    counts = ex.groupBy("word").agg(F.count(F.lit(1)).alias("n"),
                                    F.count(F.when(F.col("__y") == positive, 1)).alias("n_pos"))
    return _informativeness(counts, out)


def word_and_bigram_class_scores(df: DataFrame, words: str, label: str, positive=1, out: str = "score", sep: str = "_") -> DataFrame:
    """``class_scores`` of the features of ``word_and_bigram_features``: every word leaves
    its document once, with the word after it (null for the last), and words and bigrams
    are counted from the counts of pairs."""
    w = col_(words)
    after = F.slice(w, F.lit(2), F.size(w))
    ex = df.filter(F.size(w) > 0).select((F.col(label) == positive).alias("__y"), F.inline(F.arrays_zip(w.alias("w1"), after.alias("w2"))))
    pairs = ex.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__y"), 1)).alias("n_pos"))
    own = F.struct(F.col("w1").alias("word"), "n", "n_pos")
    both = F.struct(F.concat_ws(sep, "w1", "w2").alias("word"), "n", "n_pos")
    rows = pairs.select(F.inline(F.when(F.col("w2").isNull(), F.array(own)).otherwise(F.array(own, both))))
    return _informativeness(rows.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos")), out)


def _informativeness(counts: DataFrame, out: str) -> DataFrame:
    """Scores from ``word``, ``n``, ``n_pos``."""
    tot = counts.select(F.struct(F.sum("n").alias("N"), F.sum("n_pos").alias("P"))).scalar()
    s = (counts.withColumn("__t", tot)
         .withColumn("__N", F.col("__t.N")).withColumn("__P", F.col("__t.P")).drop("__t"))
    neg = F.col("n") - F.col("n_pos")
    score = (chi_sq("n_pos", "n", "__P", "__N") + chi_sq(neg, "n", F.col("__N") - F.col("__P"), "__N"))
    return s.select("word", "n", "n_pos", neg.alias("n_neg"), round6(score).alias(out))


def best_words(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The ``k`` highest-scoring features (ties by word) — TakeOrdered, a
    per-partition top-k merged on the driver, so bounded by k."""
    return scores.orderBy(F.desc(score), F.asc("word")).limit(k)


def best_word_features(df: DataFrame, key: str, words: str, best: DataFrame,
                       out: str = "features") -> DataFrame:
    """Each document's distinct features restricted to the selected set.
    The set (k words, a model parameter) is one scalar subquery, so a document is
    worked on in its own row and nothing is shuffled."""
    chosen = best.agg(F.collect_set("word").alias("w")).scalar()
    with_set = df.withColumn("__best", chosen)
    return with_set.withColumn(out, F.sort_array(F.array_intersect(words, "__best"))).drop("__best")


def _may_be_best(best: tuple[int, str], of, rank1, rank2, n_ii, n_ix, n_xi, n_xx) -> np.ndarray:
    """Places of the pairs that can be among the n best of their row ``of`` under a measure.
    Pairs of the same counts score the same, so only the first n of them in the order of
    their words can; and none whose score is below the n-th by more than rounding moves it."""
    n, score = best
    a, ix, xi, t = (x.astype(float) for x in (n_ii, n_ix, n_xi, n_xx))
    den = ix * (t - ix) * xi * (t - xi)
    with np.errstate(all="ignore"):
        s = np.where(den == 0, 0.0, t * (a * (t - ix - xi + a) - (ix - a) * (xi - a)) ** 2 / den) if score == "chi_sq" else np.log2(a * t / (ix * xi))

    def place(starts):
        """The number of rows since the last start."""
        return np.arange(len(starts)) - np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))

    def begins(*keys):
        return np.concatenate((np.ones(min(len(keys[0]), 1), bool), np.any([k[1:] != k[:-1] for k in keys], axis=0)))

    order = np.lexsort((rank2, rank1, n_xi, n_ix, n_ii, of))
    order = order[place(begins(*[k[order] for k in (of, n_ii, n_ix, n_xi)])) < n]
    order = order[np.lexsort((-s[order], of[order]))]
    nth = place(begins(of[order])) == n - 1
    least = np.full(int(of.max(initial=-1)) + 1, -np.inf)
    least[of[order][nth]] = s[order][nth]
    least = least[of[order]]
    return np.sort(order[s[order] >= np.where(np.isinf(least), least, least - 1e-5 - 1e-9 * np.abs(least))])


def _pairs_of_rows(rows: pa.Array, best: tuple[int, str] | None = None) -> pa.Array:
    """For each row, a list of token arrays, the counts of its distinct neighbours:
    structs w1, w2, n_ii, n_ix, n_xi, n_xx.  ``best`` (n, measure) leaves out pairs that
    cannot be among the n best of their row."""
    texts = rows.flatten()
    coded = texts.flatten().fill_null("").dictionary_encode()
    code, size = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
    text = np.repeat(np.arange(len(texts)), np.diff(ends(texts)))
    row = np.repeat(np.arange(len(rows)), np.diff(ends(rows)))[text]
    word, own, count = np.unique(row * size + code, return_inverse=True, return_counts=True)  # a row's words
    near = np.flatnonzero(text[1:] == text[:-1])
    pair, n_ii = np.unique(own[near] * max(len(word), 1) + own[near + 1], return_counts=True)
    first, second = pair // max(len(word), 1), pair % max(len(word), 1)
    of = word[first] // size
    if best is not None:
        rank = np.zeros(size, np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
        facts = rank[word[first] % size], rank[word[second] % size], n_ii, count[first], count[second], np.bincount(row, minlength=len(rows))[of]
        many = np.bincount(of, minlength=len(rows))[of] > best[0]  # else all of the row's are
        at = np.flatnonzero(many)
        at = np.sort(np.concatenate((np.flatnonzero(~many), at[_may_be_best(best, of[at], *[x[at] for x in facts])])))
        first, second, n_ii, of = first[at], second[at], n_ii[at], of[at]
    columns = {"w1": coded.dictionary.take(pa.array(word[first] % size)), "w2": coded.dictionary.take(pa.array(word[second] % size)),
               "n_ii": pa.array(n_ii, pa.int64()), "n_ix": pa.array(count[first], pa.int64()), "n_xi": pa.array(count[second], pa.int64()),
               "n_xx": pa.array(np.bincount(row, minlength=len(rows))[of], pa.int64())}
    found = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(rows) + 1)), pa.int32()), found)


def _row_pairs(lists, best: tuple[int, str] | None = None, size: int = AT_ONCE) -> Column:
    """Column form of ``_pairs_of_rows``, a run of rows of about ``size`` tokens at a time."""
    @F.arrow_udf("array<struct<w1:string,w2:string,n_ii:bigint,n_ix:bigint,n_xi:bigint,n_xx:bigint>>")
    def pairs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            for run in runs(rows, ends(rows.flatten())[ends(rows)], size):
                yield _pairs_of_rows(run, best)
    return pairs(lists)


def _measures(x) -> dict[str, Column]:
    """Both association measures, from a function that gives the counts by name."""
    counts = [x(c) for c in ("n_ii", "n_ix", "n_xi", "n_xx")]
    return {"chi_sq": round6(chi_sq(*counts)), "pmi": round6(pmi(*counts))}


def bigram_scores(df: DataFrame, words: str, by=None, documents: bool = False) -> DataFrame:
    """N5/F1 collocation scores over a corpus (or per ``by`` group): n_ii the
    pair count, n_ix / n_xi the unigram counts of w1 / w2, n_xx the number of
    words; chi-square and PMI.

    Every word leaves its document once, with the word after it ('' for the last), and
    one aggregation counts the pairs; the counts of words and their total are sums over
    them.  (No column can be null, so all uses share one exchange.)  Groups may be of any
    size, but few, as classes are: their totals are broadcast.

    ``documents``: the groups are many and each bounded, as a document is.  Then a group's
    token arrays meet in one row and its pairs are counted there, so the tokens alone are
    shuffled, once.  Either way a null group has no scores."""
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    if documents:
        ship_package(df.sparkSession)
        known = df.filter(F.size(words) > 0).dropna(subset=by)
        rows = known.groupBy(*by).agg(F.collect_list(words).alias("__w"))
        return rows.select(*by, F.inline(_row_pairs("__w"))).select("*", *[m.alias(n) for n, m in _measures(F.col).items()])
    w = col_(words)
    after = F.concat(F.slice(w, F.lit(2), F.size(w)), F.array(F.lit("")))
    ex = df.filter(F.size(w) > 0).select(*by, F.inline(F.arrays_zip(w.alias("w1"), after.alias("w2"))))
    solid = [F.coalesce(c, F.lit("")).alias(c) for c in ("w1", "w2")]
    counts = ex.select(*by, *solid).groupBy(*by, "w1", "w2").agg(F.count(F.lit(1)).alias("n_ii"))
    uni = counts.groupBy(*by, "w1").agg(F.sum("n_ii").alias("n_ix"))
    second = uni.select(*by, F.col("w1").alias("w2"), F.col("n_ix").alias("n_xi"))
    j = counts.join(uni, [*by, "w1"]).join(second, [*by, "w2"])
    if by:
        # one row for each class; a join on the class would put each into one task
        j = j.join(F.broadcast(counts.groupBy(*by).agg(F.sum("n_ii").alias("n_xx"))), by)
    else:
        j = j.withColumn("n_xx", counts.agg(F.sum("n_ii")).scalar())
    return j.select(*by, "w1", "w2", "n_ii", "n_ix", "n_xi", "n_xx", *[m.alias(n) for n, m in _measures(F.col).items()])


def top_bigrams(scores: DataFrame, n: int, by=None, score: str = "chi_sq") -> DataFrame:
    """N best bigrams (score desc, then bigram asc), overall or per group
    (a document's bigrams are bounded by the document)."""
    if by is None:
        return scores.orderBy(F.desc(score), "w1", "w2").limit(n)
    by = [by] if isinstance(by, str) else list(by)
    w = Window.partitionBy(*by).orderBy(F.desc(score), "w1", "w2")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _ranked_pairs(pairs, score: str, *more: str) -> Column:
    """A row's pairs by falling ``score``, then in the order of their words: structs ``s`` (the
    negative score), w1, w2 and ``more``."""
    return F.sort_array(F.transform(pairs, lambda p: F.struct((-_measures(lambda c: p[c])[score]).alias("s"), *[p[c].alias(c) for c in ("w1", "w2", *more)])))


def top_document_bigrams(df: DataFrame, words: str, by: str, n: int, score: str = "chi_sq") -> DataFrame:
    """N5 + T3: the ``n`` best bigrams of each document (``bigram_scores`` with ``documents``
    and ``top_bigrams``), chosen and ranked in the row where its token arrays meet, so the
    tokens alone are shuffled, once."""
    ship_package(df.sparkSession)
    rows = df.filter(F.size(words) > 0).dropna(subset=[by]).groupBy(by).agg(F.collect_list(words).alias("__w"))
    best = F.slice(_ranked_pairs("__p", score, "n_ii"), 1, n)
    ranked = rows.withColumn("__p", _row_pairs("__w", (n, score))).select(by, F.posexplode(best).alias("__r", "__b"))
    b = F.col("__b")
    return ranked.select(by, b["w1"].alias("w1"), b["w2"].alias("w2"), b["n_ii"].alias("n_ii"), (-b["s"]).alias(score), (F.col("__r") + 1).alias("rank"))


def best_bigram_features(df: DataFrame, key: str, words: str, n: int, score: str = "chi_sq", sep: str = "_",
                         out: str = "features") -> DataFrame:
    """Each document's words and the ``n`` best of its own bigrams under a measure
    (F1: ``chi_sq`` or ``pmi``), in order of their rank.  ``key`` names a document: the rows
    with one key share their bigrams, those without a key have none.  The rows of a key
    meet once, and all else happens in that row."""
    ship_package(df.sparkSession)
    rows = df.dropna(subset=[key]).groupBy(key).agg(F.collect_list(F.struct(*df.columns)).alias("__rows"))
    rows = rows.withColumn("__p", _row_pairs(F.transform("__rows", lambda r: r[words]), (n, score)))
    best = F.transform(F.slice(_ranked_pairs("__p", score), 1, n), lambda p: F.concat_ws(sep, p["w1"], p["w2"]))
    found = rows.select(best.alias("__b"), F.explode("__rows").alias("__r")).select(*[F.col("__r")[c].alias(c) for c in df.columns], "__b")
    bare = df.filter(F.col(key).isNull()).withColumn("__b", F.array().cast("array<string>"))
    return found.unionByName(bare).withColumn(out, F.concat(words, "__b")).drop("__b")


def class_collocations(df: DataFrame, label: str, words: str, n: int, score: str = "chi_sq") -> DataFrame:
    """The ``n`` best bigrams of each class's own text under a measure.  A class
    may hold most rows, so it is ranked in salted parts first."""
    scores = bigram_scores(df.select(label, words), words, by=label)
    return top_k_per_group(scores, [label], [F.desc(score), "w1", "w2"], n, "w1")


def collocation_word_scores(df: DataFrame, label: str, words: str, n: int, positive=1, score: str = "chi_sq", sep: str = "_") -> DataFrame:
    """Informativeness (N7) of the words and of each class's ``n`` best bigrams, of
    which a class counts each of its own once."""
    single = df.select((F.col(label) == positive).alias("__y"), F.explode(words).alias("word"))
    pairs = class_collocations(df, label, words, n, score)
    counts = single.unionByName(pairs.select((F.col(label) == positive).alias("__y"), F.concat_ws(sep, "w1", "w2").alias("word")))
    return class_scores(counts.withColumn("__f", F.array("word")).drop("word"), "__f", "__y", positive=True)
