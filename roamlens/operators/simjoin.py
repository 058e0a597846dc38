"""String similarity joins: exact, by equi-joins on index keys.

``above`` yields the pairs of an edit-distance score above a threshold.  Characters
become tokens (character, how often it stood before), ordered rarest first.  A score
above t leaves at least o = ceil((t + 0.5) / 100 * longer length) tokens in common, so
both strings share two tokens among their first length - o + 2, and are joined on pairs
of such tokens.  Only strings so short that one common character suffices at t are also
joined on one.

``top_matches`` finds the best choices of each query at falling thresholds: whoever has
enough results above one of them is done, as all results above it are known, and only
the others go on to the next.  Where the texts are so alike that the keys of a threshold
would form more than a share of all pairs, the queries still open are compared with all
choices in blocks (``editblocks``), which costs far less a pair and needs no key.  Scores
of the best window (``partial_similarity``) are found there too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.functions.columns import normalise_name, partial_similarity, similarity
from roamlens.operators import editblocks
from roamlens.session import cut_lineage

#: Falling thresholds of a top-n search; 0 finds every positive score.
FALLING = (85, 70, 65, 60, 50, 40, 20, 0)
#: A pair formed by a join on keys takes about as long as so many pairs in blocks.
PAIRS_IN_BLOCKS = 50


# ------------------------------------------------------------------ tokens
def _occurrences(c: Column) -> Column:
    """'aba' -> a0, b0, a1: character and how often it stood before."""
    chars = F.split(c, "")
    return F.transform(chars, lambda ch, i: F.concat(
        ch, F.size(F.filter(F.slice(chars, 1, i), lambda x: x == ch)).cast("string")))


def _token_rank(*frames: DataFrame) -> DataFrame:
    """tok, r: all tokens of the ``tokens`` columns, rarest first.  One row for each
    character of the alphabet and repeat."""
    every = frames[0].select(F.explode("tokens").alias("tok"))
    for f in frames[1:]:
        every = every.unionByName(f.select(F.explode("tokens").alias("tok")))
    counted = every.groupBy("tok").agg(F.count(F.lit(1)).alias("f"))
    return counted.select("tok", F.row_number().over(Window.orderBy("f", "tok")).alias("r"))


def _ranked(df: DataFrame, rank: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: each text's tokens as sorted ranks."""
    found = (df.select(text, F.explode("tokens").alias("tok")).join(F.broadcast(rank), "tok")  # rank: bounded by the alphabet
             .groupBy(text).agg(F.array_sort(F.collect_list("r")).alias(out)))
    return df.drop("tokens").join(found, text)


def normalised(queries: DataFrame, choices: DataFrame, q: str = "q", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """The distinct queries (``q``, ``__qn``) and the choices (their columns, ``__cn``)
    with their normalised texts, those without one left out."""
    return (queries.select(q).distinct().withColumn("__qn", normalise_name(q)).filter("__qn != ''"),
            choices.withColumn("__cn", normalise_name(name)).filter("__cn != ''"))


def prepare(queries: DataFrame, choices: DataFrame, q: str = "q", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """The distinct queries (``q``, ``__qn``, ``__qt``) and the choices (their columns,
    ``__cn``, ``__ct``) with their normalised texts and ranked tokens, each written once."""
    qn, cn = normalised(queries, choices, q, name)
    qt = qn.select("__qn").distinct().withColumn("tokens", _occurrences(F.col("__qn")))
    ct = cn.select("__cn").distinct().withColumn("tokens", _occurrences(F.col("__cn")))
    rank = cut_lineage(_token_rank(qt, ct))
    qn = qn.join(_ranked(qt, rank, "__qn", "__qt"), "__qn")
    cn = cn.join(_ranked(ct, rank, "__cn", "__ct"), "__cn")
    return cut_lineage(qn), cut_lineage(cn)


# ------------------------------------------------------------------ edit distance
def _shared_at_least(length: Column, threshold: int) -> Column:
    """Tokens in common that a score above the threshold needs, for the longer length."""
    return F.greatest(F.ceil((threshold + 0.5) / 100.0 * length).cast("int"), F.lit(1))


def _with_keys(df: DataFrame, tokens: str, threshold: int) -> DataFrame:
    """A row for each pair of prefix tokens; for each token alone where a string can
    be in a pair that needs only one in common.  ``__two`` tells which."""
    n = F.size(tokens)
    least = _shared_at_least(n, threshold)
    rows = df.withColumn("__pre2", F.slice(tokens, F.lit(1), F.least(n, n - least + 2)))
    pairs = F.flatten(F.transform("__pre2", lambda x, i: F.transform(
        F.slice("__pre2", i + 2, F.size("__pre2")), lambda y: F.struct(x.alias("k1"), y.alias("k2")))))
    alone = F.when(least == 1, F.transform(tokens, lambda x: F.struct(x.alias("k1"), F.lit(0).alias("k2"))))
    keys = F.concat(pairs, F.coalesce(alone, F.array().cast("array<struct<k1:int,k2:int>>")))
    return rows.select(*df.columns, F.inline(keys))


def above(qn: DataFrame, cn: DataFrame, threshold: int, open_: Column | None = None, known: int | None = None) -> DataFrame:
    """The pairs of prepared queries and choices that can score above the threshold,
    without those that could score above ``known`` as well.

    A pair meets under several keys and is kept under the first two tokens it shares
    (the only one, where one suffices): a condition on the joined row, no dedup shuffle.
    ``open_`` further restricts them (a condition on columns of both sides)."""
    shared = F.array_intersect("__qt", "__ct")  # sorted, as both are
    longer = F.greatest(F.size("__qt"), F.size("__ct"))
    least = _shared_at_least(longer, threshold)
    first = F.col("k1") == shared[0]
    once = F.when(F.col("k2") > 0, (least > 1) & first & (F.col("k2") == shared[1])).otherwise((least == 1) & first)
    keep = (F.size(shared) >= least) & once
    if known is not None:
        keep = keep & (F.size(shared) < _shared_at_least(longer, known))
    left, right = _with_keys(qn, "__qt", threshold), _with_keys(cn, "__ct", threshold)
    return left.join(right, ["k1", "k2"]).filter(keep if open_ is None else open_ & keep).drop("k1", "k2")


def _joined(qn: DataFrame, cn: DataFrame, threshold: int) -> int:
    """The rows that the join of ``above`` forms before its conditions."""
    left, right = (_with_keys(df.select(t), t, threshold).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias(n))
                   for df, t, n in ((qn, "__qt", "__l"), (cn, "__ct", "__r")))
    return left.join(right, ["k1", "k2"]).agg(F.coalesce(F.sum(F.col("__l") * F.col("__r").cast("decimal(20,0)")), F.lit(0)).cast("double")).first()[0]


# ------------------------------------------------------------------ joins
SCORERS = (similarity, partial_similarity)


def candidates(queries: DataFrame, choices: DataFrame, q: str = "q", name: str = "name",
               threshold: int = 0, scorer=similarity) -> DataFrame:
    """Pairs (distinct query, choice) with score > ``threshold``, with the score.
    ``scorer`` is one of ``SCORERS``.  ``choices`` keeps its other columns."""
    if scorer not in SCORERS:
        raise ValueError("the scorer has no index")
    if scorer is partial_similarity:
        return editblocks.partial(*map(cut_lineage, normalised(queries, choices, q, name)), threshold)
    return _scored(above(*prepare(queries, choices, q, name), threshold), threshold)


def _scored(pairs: DataFrame, threshold: int) -> DataFrame:
    return (pairs.withColumn("score", similarity("__qn", "__cn")).filter(F.col("score") > threshold)
            .drop("__qn", "__qt", "__cn", "__ct"))


def top_matches(queries: DataFrame, choices: DataFrame, limit: int = 1, q: str = "q",
                name: str = "name", by=("level",), threshold: int = 0, scorer=similarity,
                falling: tuple[int, ...] = FALLING) -> DataFrame:
    """The ``limit`` best choices per query and list (the columns ``by`` name
    the list a choice belongs to): score desc, then choice order ``ord``; only scores
    above ``threshold``.

    A query that has ``limit`` results above one of the ``falling`` thresholds in a
    list is done there: nothing below can enter.  The lists a query is done with (there
    are few lists) travel in its row, so the next join does not form their pairs, and no
    join forms a pair again.  Between the joins at most ``limit`` results are kept for
    each query and list.  The first join that would form more than one pair in
    ``PAIRS_IN_BLOCKS`` is not made: its queries meet all choices in blocks."""
    if scorer not in SCORERS:
        raise ValueError("the scorer has no index")
    by = list(by)
    if scorer is not similarity:
        return _best(candidates(queries, choices, q, name, threshold, scorer), q, by, limit)
    qn, cn = prepare(queries, choices, q, name)
    steps = [t for t in falling if t > threshold] + [threshold]
    cn = cn.withColumn("__list", F.xxhash64(F.struct(*by)) if by else F.lit(0).cast("long"))
    lists, all_choices = cn.agg(F.count_distinct("__list"), F.count(F.lit(1))).first()
    none = F.array().cast("array<bigint>")
    qn, best = qn.withColumn("__done", none), None
    for k, t in enumerate(steps):
        left = qn.filter(F.size("__done") < lists) if k else qn
        if _joined(left, cn, t) * PAIRS_IN_BLOCKS > left.count() * all_choices:
            got = editblocks.nearest(left, cn, limit, threshold).filter(~F.array_contains("__done", F.col("__list")))
            if best is not None:  # what was found of an open list is found again
                known = best.drop("rank").join(qn.select(q, "__done"), q).filter(F.array_contains("__done", F.col("__list")))
                got = got.unionByName(known)
            best = _best(got.drop("__done"), q, [*by, "__list"], limit)
            break
        pairs = above(left, cn, t, ~F.array_contains("__done", F.col("__list")), steps[k - 1] if k else None)
        got = _scored(pairs.drop("__done"), threshold)
        best = _best(got if best is None else best.drop("rank").unionByName(got), q, [*by, "__list"], limit)
        if k == len(steps) - 1:
            break
        best = cut_lineage(best)
        full = best.filter((F.col("rank") == limit) & (F.col("score") > t)).groupBy(q).agg(F.collect_set("__list").alias("__now"))
        qn = qn.drop("__done").join(full, q, "left").withColumn("__done", F.coalesce("__now", none)).drop("__now")
        if qn.filter(F.size("__done") < lists).isEmpty():
            break
    return best.drop("__list")


def _best(rows: DataFrame, q: str, by: list[str], limit: int) -> DataFrame:
    """The ``limit`` best rows of each query and list, with their rank."""
    if limit == 1:  # partial aggregation before the shuffle
        rest = [c for c in rows.columns if c not in [q, *by]]
        best = rows.groupBy(q, *by).agg(F.max_by(F.struct(*rest), F.struct(F.col("score"), -F.col("ord"))).alias("__b"))
        return best.select(q, *by, *[F.col("__b")[c].alias(c) for c in rest]).withColumn("rank", F.lit(1))
    order = Window.partitionBy(q, *by).orderBy(F.desc("score"), F.asc("ord"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
