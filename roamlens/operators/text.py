"""Tokens, stop words, frequencies, TF-IDF keywords, word-cloud weights and
dictionary (full-mode) segmentation (SURVEY N1–N3, N10, N11, A13–A15, P7, P8).

Tokens are ``array<string>`` columns produced by built-in regex functions, so
tokenising stays in whole-stage codegen; per-document arrays are bounded by
the document, and corpus-wide work is explode + groupBy (partial aggregation
before the shuffle)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roamlens.functions.columns import numeric_stop, round6, runs_of, tokens
from roamlens.operators.blocks import ends, runs
from roamlens.operators.ordering import top_k_per_group
from roamlens.operators.segment import MOST_LETTERS, MOST_WORDS, segment
from roamlens.session import cut_lineage, ship_package


def tokenize(df: DataFrame, text: str = "text", out: str = "words", mode: str = "words",
             n: int = 2, key: str | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """N1. ``words``: runs of letters (any script), lower-cased.
    ``alnum``: runs of letters or digits.  ``chars``: every letter on its own
    (unspaced scripts).  ``ngram``: overlapping letter n-grams inside each run.
    ``dictionary``: each run cut into words by the most likely path through the hits of
    a ``dictionary`` (``word``, ``freq``); ``key`` names a row."""
    if mode == "dictionary":
        if key is None or dictionary is None:
            raise ValueError("the dictionary mode needs a key and a dictionary")
        return segment(df, key, text, dictionary, out)
    t = F.lower(F.col(text))
    if mode == "words":
        c = tokens(text)
    elif mode == "alnum":
        c = runs_of(t, r"[^\p{L}\p{N}]+")
    elif mode == "chars":
        c = F.array_remove(F.split(F.regexp_replace(t, r"\P{L}+", ""), ""), "")
    elif mode == "ngram":
        runs = runs_of(t, r"\P{L}+")
        c = F.flatten(F.transform(runs, lambda r: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))),
            lambda i: F.substring(r, i, n))))
    else:
        raise ValueError(mode)
    # the letter-run patterns cannot produce empty tokens; only n-grams need
    # the (interpreted) higher-order filter
    if mode == "ngram":
        c = F.filter(c, lambda w: w != "")
    return df.withColumn(out, c)


def remove_stop_words(df: DataFrame, words: str, stop_words, out: str | None = None,
                      numeric: bool = False) -> DataFrame:
    """N3/P8 (+P7 with ``numeric``): order and duplicates are kept.

    ``stop_words`` is a bounded list (a literal array inside the expression,
    shipped with the plan) — for a large stop table use
    ``remove_stop_words_table``."""
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")

    def keep(w):
        k = ~F.array_contains(stop, w)
        return k & ~numeric_stop(w) if numeric else k
    return df.withColumn(out or words, F.filter(F.col(words), keep))


def remove_stop_words_table(df: DataFrame, key: str, words: str, stop: DataFrame,
                            word_col: str = "word", out: str | None = None) -> DataFrame:
    """P8 join form for a stop table of any size: explode with positions,
    anti-join (AQE chooses its form from the table's bytes), regroup per key in
    position order.  Groups are documents, so they are bounded."""
    ex = df.select(key, F.posexplode(words).alias("__p", "__w"))
    stop = stop.select(F.col(word_col).alias("__w")).distinct()
    kept = ex.join(stop, "__w", "left_anti")
    regrouped = (kept.groupBy(key)
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__w"))),
                                  lambda s: s["__w"]).alias(out or words)))
    base = df.drop(words) if (out or words) == words else df
    return (base.join(regrouped, key, "left")
            .withColumn(out or words, F.coalesce(F.col(out or words), F.array().cast("array<string>"))))


def word_counts(df: DataFrame, words: str, label: str | None = None, positive=1) -> DataFrame:
    """A13 (+A14 when ``label`` is given): corpus frequency of each word and,
    in the same shuffle, per-class frequencies."""
    ex = df.select(*( [label] if label else []), F.explode(words).alias("word"))
    aggs = [F.count(F.lit(1)).alias("n")]
    if label:
        aggs += [F.count(F.when(F.col(label) == positive, 1)).alias("n_pos"),
                 F.count(F.when(F.col(label) != positive, 1)).alias("n_neg")]
    return ex.groupBy("word").agg(*aggs)


def tfidf_keywords(df: DataFrame, group: str, doc: str, words: str, k: int = 100) -> DataFrame:
    """N10 + T4: TF-IDF keyword weights per group, top ``k`` per group.

    tf = count(word in group) / tokens in group;
    idf = ln((N + 1) / (df + 1)) with N documents and df documents holding
    the word (learned from the corpus itself).  Ranking happens on the
    (group, word) aggregate with the salted two-phase top-k, so a dominant
    group (one language) is ranked by many tasks."""
    # document frequency from each row's distinct words, term frequency from
    # all words: both are partial aggregations, so the shuffles carry at most
    # one row per word per task, never the (doc, word) pairs
    n_docs = df.select(F.count_distinct(doc)).scalar()
    dfreq = (df.select(F.explode(F.array_distinct(words)).alias("word"))
             .groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    tf = df.select(group, F.explode(words).alias("word")).groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))
    tot = tf.groupBy(group).agg(F.sum("n").alias("total"))
    s = (tf.join(tot, group).join(dfreq, "word")
         .withColumn("weight", round6(F.col("n") / F.col("total") *
                                      F.log((n_docs + 1) / (F.col("df") + 1)))))
    return (top_k_per_group(s, [group], [F.desc("weight"), F.asc("word")], k, "word")
            .select(group, "word", "n", "df", "weight", "rank"))


def cloud_weights(df: DataFrame, group: str, words: str, n: int = 100) -> DataFrame:
    """Word-cloud weights — frequency / the group's top frequency, top
    ``n`` (salted two-phase top-k; the top frequency is the rank-1 row)."""
    c = df.select(group, F.explode(words).alias("word")).groupBy(group, "word").agg(
        F.count(F.lit(1)).alias("n"))
    top = top_k_per_group(c, [group], [F.desc("n"), F.asc("word")], n, "word")
    w = Window.partitionBy(group)
    return top.withColumn("weight", round6(F.col("n") / F.max("n").over(w)))


#: Code points, letters of the texts that are searched at once, and entries of a trie that is laid out as a table.
POINTS, AT_ONCE, DENSE = 0x110000, 1 << 20, 1 << 22


@lru_cache(maxsize=1)
def _letters(spark: SparkSession) -> np.ndarray:
    """Where runs of letters begin and end among the code points, as the engine's ``\\p{L}`` has them."""
    points = spark.range(POINTS).filter("id NOT BETWEEN 55296 AND 57343").filter(
        F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").rlike(r"^\p{L}$"))
    is_letter = np.zeros(POINTS + 1, np.int8)
    is_letter[points.toArrow()["id"].to_numpy()] = 1
    return np.flatnonzero(np.diff(is_letter, prepend=0))


class _Trie:
    """The words as a trie over classes of code points; class 0 is in no word, node 0 the root."""

    def __init__(self, words: list[str]):
        points = sorted({ord(c) for w in words for c in w})
        self.kinds, self.longest = len(points) + 1, max(map(len, words), default=0)
        self.kind = np.zeros(POINTS, np.int32)
        self.kind[points] = np.arange(1, self.kinds)
        edges, self.word = {}, [-1]
        for k, w in enumerate(words):
            node = 0
            for c in w:
                node = edges.setdefault(node * self.kinds + int(self.kind[ord(c)]), len(self.word))
                if node == len(self.word):
                    self.word.append(-1)
            self.word[node] = k
        self.word = np.array(self.word)
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.table = None
        if len(self.word) * self.kinds <= DENSE:
            self.table = np.zeros(len(self.word) * self.kinds, np.int32)
            self.table[self.keys] = self.to

    def step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes below, 0 where there is none."""
        key = node * self.kinds + kind
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)


@lru_cache(maxsize=2)
def _trie(words: tuple[str, ...]) -> _Trie:
    return _Trie(list(words))


def _search(texts: pa.Array, trie: _Trie, words: pa.Array, letter: np.ndarray | None) -> pa.Array:
    """For each text, where words stand in it and, with the table ``letter`` of code points,
    its letters that are in none of them: structs start, len, word."""
    listed = [t or "" for t in texts.to_pylist()]
    size = np.array([len(t) + 1 for t in listed], np.int64)  # a text is followed by a mark of no class
    begin = np.concatenate(([0], np.cumsum(size)))
    point = np.frombuffer("\0".join([*listed, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = trie.kind[point]
    kind[begin[1:] - 1] = 0
    at = np.flatnonzero((trie.step(np.int64(0), np.arange(trie.kinds)) > 0)[kind])
    node, found = np.zeros(len(at), np.int64), [(np.empty(0, np.int64),) * 3]
    for n in range(1, trie.longest + 1):
        node = trie.step(node, kind[at + n - 1]).astype(np.int64)
        at, node = at[node > 0], node[node > 0]
        hit = trie.word[node] >= 0
        found.append((at[hit], np.full(int(hit.sum()), n), trie.word[node[hit]]))
    start, length, word = (np.concatenate(x) for x in zip(*found))
    if letter is not None:
        change = np.bincount(start, minlength=len(point) + 1) - np.bincount(start + length, minlength=len(point) + 1)
        bare = letter[point] & (np.cumsum(change[:-1]) == 0)
        bare[begin[1:] - 1] = False
        alone = np.flatnonzero(bare)
        sign = np.zeros(POINTS, bool)
        sign[point[alone]] = True
        signs, which = np.flatnonzero(sign), (np.cumsum(sign, dtype=np.int32) - 1)[point[alone]]
        start, length = np.concatenate((start, alone)), np.concatenate((length, np.ones(len(alone), np.int64)))
        word, words = np.concatenate((word, len(words) + which)), pa.concat_arrays([words, pa.array([chr(c) for c in signs], pa.string())])
    order = np.argsort(start, kind="stable")
    start, length, word = start[order], length[order], word[order]
    cut = np.searchsorted(start, begin)
    hits = pa.StructArray.from_arrays([pa.array((start - np.repeat(begin[:-1], np.diff(cut)) + 1).astype(np.int32)), pa.array(length.astype(np.int32)),
                                       words.take(pa.array(word))], ["start", "len", "word"])
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), hits)


def _in_runs(rows, texts: pa.Array, words: tuple[str, ...], letters: np.ndarray | None, size: int = AT_ONCE):
    """Slices of ``rows`` of about ``size`` letters of their ``texts``, with what is found there."""
    trie, known, letter = _trie(words), pa.array(words, pa.string()), None
    if letters is not None:
        letter = np.zeros(POINTS + 1, np.int8)
        letter[letters] = 1
        letter = np.cumsum(letter, dtype=np.int64)[:-1] % 2 == 1
    long, lo = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), 0
    for run in runs(rows, np.concatenate(([0], np.cumsum(long, dtype=np.int64))), size):
        yield run, _search(texts.slice(lo, len(run)), trie, known, letter)
        lo += len(run)


def _finder(words: list[str]):
    """Column function: where each of the words stands in a text."""
    words = tuple(words)

    @F.arrow_udf("array<struct<start:int,len:int,word:string>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for _, hits in _in_runs(texts, texts, words, None):
                yield hits

    return found


def _found_rows(t: DataFrame, key: str, words: list[str], letters: np.ndarray) -> DataFrame:
    """A row (``key``, start, len, word) for each hit in the texts ``__t`` and for each of their
    letters (``letters``: where runs of them begin and end among the code points) in no hit."""
    words = tuple(words)

    def rows(batches):
        for x in batches:
            for run, found in _in_runs(x, x["__t"], words, letters):
                of = np.repeat(np.arange(len(run)), np.diff(ends(found)))
                yield pa.RecordBatch.from_arrays([run["__k"].take(pa.array(of)), *found.flatten().flatten()], [key, "start", "len", "word"])

    return t.select("__k", "__t").mapInArrow(rows, T.StructType([
        T.StructField(key, t.schema["__k"].dataType), *[T.StructField(n, k) for n, k in (("start", T.IntegerType()), ("len", T.IntegerType()), ("word", T.StringType()))]]))


def _hits_by_join(t: DataFrame, d: DataFrame, longest: int) -> DataFrame:
    """``__k``, start, len, word of the words of ``d`` in the texts ``__t``."""
    c = t.select("__k", F.split("__t", "").alias("__c"))
    at = F.sequence(F.lit(1), F.size("__c"))
    windows = F.transform(at, lambda i: F.array_join(F.slice("__c", i, longest), ""))
    sub = c.select("__k", F.posexplode(windows).alias("__i", "__w"))
    sub = sub.select("__k", (F.col("__i") + 1).alias("start"), "__w",
                     F.explode(F.sequence(F.lit(1), F.length("__w"))).alias("len"))
    return sub.withColumn("word", F.substring("__w", F.lit(1), F.col("len"))).join(d, "word").select("__k", "start", "len", "word")


def dictionary_segments(df: DataFrame, key: str, text: str, dictionary: DataFrame,
                        word_col: str = "word", max_len: int | None = None, most_words: int = MOST_WORDS) -> DataFrame:
    """N2 full-mode segmentation: every dictionary word found in the text
    (overlaps included), as (start, length, word); letters covered by no
    dictionary word are emitted on their own.

    A dictionary within MOST_WORDS and MOST_LETTERS goes to the tasks and a text is searched
    in its row; if its key is its alone, its other letters come from there too and nothing is
    shuffled.  With a larger one, a text's substrings up to the longest word leave the row
    as narrow (start, length, word) rows and are equi-joined with the dictionary.  The hits of
    the texts of a key then come back together (a bounded group), where one hash-based
    ``array_except`` gives the letters outside their spans."""
    d = dictionary.select(F.lower(F.col(word_col)).alias("word")).filter("word != ''").distinct()
    if max_len is not None:
        d = d.filter(F.length("word") <= max_len)
    d = cut_lineage(d)
    size = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("letters"), F.max(F.length("word")).alias("longest")).first()
    t = df.select(F.col(key).alias("__k"), F.lower(F.col(text)).alias("__t")).filter("__t != ''")
    lone = None
    if size.n <= most_words and (size.letters or 0) <= MOST_LETTERS:
        ship_package(df.sparkSession)
        words = [r.word for r in d.toLocalIterator()]
        again = cut_lineage(df.groupBy(F.col(key).alias("__j")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__j"))
        several, same = not again.isEmpty(), F.col("__k").eqNullSafe(F.col("__j"))
        lone = _found_rows(t.join(again, same, "left_anti") if several else t, key, words, _letters(df.sparkSession))
        if not several:
            return lone
        t = t.join(again, same, "left_semi")
        hits = t.select("__k", F.inline(_finder(words)("__t")))
    else:
        hits = _hits_by_join(t, d, size.longest)
    spans = hits.groupBy("__k").agg(F.collect_set(F.struct("start", "len")).alias("__s"))
    docs = t.join(spans.withColumnRenamed("__k", "__j"), F.col("__k").eqNullSafe(F.col("__j")), "left").withColumn("__c", F.split("__t", ""))
    covered = F.flatten(F.transform("__s", lambda h: F.sequence(h["start"], h["start"] + h["len"] - 1)))
    letters = F.filter(F.transform("__c", lambda c, i: F.when(c.rlike(r"^\p{L}$"), i + 1)), lambda i: i.isNotNull())
    left = F.array_except(letters, F.coalesce(covered, F.array().cast("array<int>")))
    ones = F.transform(left, lambda i: F.struct(i.alias("start"), F.lit(1).alias("len"), F.element_at("__c", i).alias("word")))
    single = docs.select("__k", F.inline(ones))
    out = hits.unionByName(single).withColumnRenamed("__k", key)
    return out if lone is None else lone.unionByName(out)
