"""Lexicon sentiment.

Semantics kept from the analysed scripts:
  * a word's position is its LAST occurrence in the token list (Q8);
  * precedence when a word is in several lists: degree > negation > sentiment;
    negation weight is -1 (N12);
  * score = sum_k s_k * prod(modifier weights strictly after the FIRST
    sentiment word and before word k); modifiers before the first sentiment
    word are ignored and the multiplier never resets (N13).
The fold runs per document over its lexicon hits only (a bounded array), as
a built-in ``aggregate`` higher-order function — no Python per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.operators.ordering import global_row_number

KIND_PRIORITY = {"deg": 0, "not": 1, "sen": 2}


def merge_lexicon(lexicon: DataFrame) -> DataFrame:
    """One row per word, the highest-precedence kind winning; negation
    weight forced to -1.  Input columns (word, kind, weight[, ord]); for
    duplicate words of one kind the last by ``ord`` wins (S10)."""
    pr = (F.when(F.col("kind") == "deg", 0).when(F.col("kind") == "not", 1).otherwise(2))
    order = F.col("ord") if "ord" in lexicon.columns else F.lit(0)
    best = (lexicon.withColumn("__pr", pr).withColumn("__o", order)
            .groupBy("word")
            .agg(F.min_by(F.struct("kind", "weight"), F.struct(F.col("__pr"), -F.col("__o"))).alias("v")))
    return best.select("word", F.col("v.kind").alias("kind"),
                       F.when(F.col("v.kind") == "not", F.lit(-1.0)).otherwise(F.col("v.weight"))
                       .cast("double").alias("weight"))


def last_positions(df: DataFrame, key: str, words: str) -> DataFrame:
    """The last (0-based) position of every distinct word of each document."""
    ex = df.select(key, F.posexplode(words).alias("pos", "word"))
    return ex.groupBy(key, "word").agg(F.max("pos").alias("pos"))


def lexicon_hits(df: DataFrame, key: str, words: str, lexicon: DataFrame,
                 all_occurrences: bool = False) -> DataFrame:
    """(key, word, pos, kind, weight) for every lexicon word of each
    document, at its last position (or every position with
    ``all_occurrences``).  The words meet the merged lexicon in a join whose form AQE
    picks from the lexicon's bytes; only hits go on."""
    lex = merge_lexicon(lexicon)
    ex = df.select(key, F.posexplode(words).alias("pos", "word")).join(lex, "word")
    if all_occurrences:
        return ex.select(key, "word", "pos", "kind", "weight")
    return (ex.groupBy(key, "word")
            .agg(F.max("pos").alias("pos"), F.first("kind").alias("kind"), F.first("weight").alias("weight")))


def fold_score(hits) -> F.Column:
    """N13 fold over ``array<struct<pos,kind,weight>>`` sorted by pos."""
    init = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("score"), F.lit(False).alias("seen"))

    def step(acc, h):
        is_sen = h["kind"] == "sen"
        new_score = F.when(is_sen, acc["score"] + acc["w"] * h["weight"]).otherwise(acc["score"])
        new_w = F.when(~is_sen & acc["seen"],
                       acc["w"] * F.when(h["kind"] == "not", F.lit(-1.0)).otherwise(h["weight"])
                       ).otherwise(acc["w"])
        return F.struct(new_w.alias("w"), new_score.alias("score"), (acc["seen"] | is_sen).alias("seen"))
    return F.aggregate(F.array_sort(hits), init, step, lambda acc: acc["score"])


def lexicon_score(df: DataFrame, key: str, words: str, lexicon: DataFrame, out: str = "score") -> DataFrame:
    """N13 per document (documents without hits score 0)."""
    hits = lexicon_hits(df, key, words, lexicon)
    per_doc = hits.groupBy(key).agg(
        fold_score(F.collect_list(F.struct("pos", "kind", "weight"))).alias(out))
    return (df.select(key).join(per_doc, key, "left")
            .withColumn(out, F.round(F.coalesce(F.col(out), F.lit(0.0)), 6)))


def score_rank(scores: DataFrame, key: str, score: str = "score", out: str = "rank") -> DataFrame:
    """1..n over scores sorted descending (ties by key), distributed."""
    return global_row_number(scores, [F.desc(score), F.asc(key)], out=out)


def score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Corpus sentiment summary."""
    return scores.agg(F.count(score).alias("n_docs"), F.round(F.avg(score), 6).alias("mean"),
                      F.min(score).alias("min"), F.max(score).alias("max"),
                      F.count(F.when(F.col(score) > 0, 1)).alias("n_positive"),
                      F.count(F.when(F.col(score) < 0, 1)).alias("n_negative"))


def lexicon_score_window(df: DataFrame, key: str, words: str, lexicon: DataFrame,
                         out: str = "score") -> DataFrame:
    """W4 form of N13 on the hits table: the multiplier in front of hit k is
    ``product(factor)`` over the preceding hits of the document, where a
    modifier's factor is its weight (-1 for negation) once a sentiment word
    has been seen, else 1.  Windows are partitioned by document (bounded)."""
    from pyspark.sql import Window
    hits = lexicon_hits(df, key, words, lexicon)
    doc = Window.partitionBy(key)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    first_sen = F.min(F.when(F.col("kind") == "sen", F.col("pos"))).over(doc)
    factor = F.when((F.col("kind") != "sen") & (F.col("pos") > first_sen), F.col("weight")).otherwise(F.lit(1.0))
    w = hits.withColumn("__f", factor).withColumn("__w", F.coalesce(F.product("__f").over(before), F.lit(1.0)))
    per_doc = w.groupBy(key).agg(F.sum(F.when(F.col("kind") == "sen", F.col("__w") * F.col("weight"))
                                       .otherwise(F.lit(0.0))).alias(out))
    return (df.select(key).join(per_doc, key, "left")
            .withColumn(out, F.round(F.coalesce(F.col(out), F.lit(0.0)), 6)))
