"""Naive Bayes as tables.

The model of two classes is a table with a row for each feature, of any vocabulary
size, and one row of class totals; a document's score is a join and a sum, and nothing
is gathered on the driver.  A margin is log P(positive | x) - log P(negative | x):

  Bernoulli    prior + sum over the vocabulary of ln(1 - t1) - ln(1 - t0)
                     + sum over present features of [ln t1 - ln(1 - t1)] - [ln t0 - ln(1 - t0)]
  multinomial  prior + sum over occurrences of [ln(c1 + s) - ln(T1 + s V)] - [ln(c0 + s) - ln(T0 + s V)]

A feature's own term depends on its counts alone; only sums over the vocabulary depend
on which features are used.  So many feature sets (the methods of the grid, the
dimensions of the sweep) are scored in one pass: conditional sums over one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ("bernoulli", "multinomial")


def feature_table(train: DataFrame, label: str, words: str, positive=1, binary: bool = True, smoothing: float = 1.0,
                  only: DataFrame | None = None) -> DataFrame:
    """The sufficient statistics: ``word``, ``c1``, ``c0`` (documents of either class
    with the word, or its occurrences if not ``binary``), the class sizes ``n1``, ``n0``
    and the terms of the margins, one row for each feature of the training rows.
    ``only`` (its column ``word``; a bounded number of features) leaves out all others
    before anything is counted or shuffled."""
    taken = F.array_distinct(words) if binary else F.col(words)
    ex = train.select((F.col(label) == positive).alias("__y"), F.explode(taken).alias("word"))
    if only is not None:
        ex = ex.join(F.broadcast(only.select("word")), "word", "left_semi")
    counts = ex.groupBy("word").agg(F.count(F.when(F.col("__y"), 1)).alias("c1"), F.count(F.when(~F.col("__y"), 1)).alias("c0"))
    y = F.col(label) == positive
    sizes = train.select(F.struct(F.count(F.when(y, 1)).alias("n1"), F.count(F.when(~y, 1)).alias("n0"))).scalar()
    rows = counts.withColumn("__n", sizes).select("word", "c1", "c0", "__n.n1", "__n.n0")

    def rate(c: str, n: str) -> Column:
        return (F.col(c) + smoothing) / (F.col(n) + 2 * smoothing)

    t1, t0 = rate("c1", "n1"), rate("c0", "n0")
    absent = F.log(1 - t1) - F.log(1 - t0)
    return rows.select("*", (F.log(t1) - F.log(t0) - absent).alias("present"), absent.alias("absent"),
                       (F.log(F.col("c1") + smoothing) - F.log(F.col("c0") + smoothing)).alias("occurs"))


def set_totals(table: DataFrame, sets: dict[str, Column], smoothing: float = 1.0) -> DataFrame:
    """One row: ``prior``, and for each set ``i`` the sum of its absent terms (``a{i}``)
    and the difference of its logarithms of smoothed totals (``t{i}``)."""
    use = list(sets.values())
    sums = [F.struct(F.sum(F.when(u, F.col("absent"))).alias("a"), F.sum(F.when(u, F.col("c1"))).alias("c1"),
                     F.sum(F.when(u, F.col("c0"))).alias("c0"), F.count(F.when(u, 1)).alias("v")).alias(f"s{i}") for i, u in enumerate(use)]
    one = table.agg(F.first("n1").alias("n1"), F.first("n0").alias("n0"), *sums)

    def total(i: int, c: str) -> Column:
        return F.log(F.coalesce(F.col(f"s{i}.{c}"), F.lit(0)) + smoothing * F.greatest(F.col(f"s{i}.v"), F.lit(1)))

    return one.select((F.log(F.col("n1") + smoothing) - F.log(F.col("n0") + smoothing)).alias("prior"),
                      *[F.coalesce(F.col(f"s{i}.a"), F.lit(0.0)).alias(f"a{i}") for i in range(len(use))],
                      *[(total(i, "c1") - total(i, "c0")).alias(f"t{i}") for i in range(len(use))])


def margins(rows: DataFrame, key: str, words: str, table: DataFrame, totals: DataFrame, sets: dict[str, Column], binary: bool = True,
            models: tuple[str, ...] = MODELS, keep: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """``key`` (naming a row), ``keep``, ``method`` (a key of ``sets``), ``model``, ``margin`` for
    every row of ``rows``, those without a known feature included.  ``few``: the table has
    a bounded number of features, so it goes to the rows, and only hits are shuffled."""
    taken = F.array_distinct(words) if binary else F.col(words)
    facts = table.select("word", "present", "occurs", *[u.alias(f"u{i}") for i, u in enumerate(sets.values())])
    hits = rows.select(key, F.explode(taken).alias("word")).join(F.broadcast(facts) if few else facts, "word")
    n = len(sets)
    sums = hits.groupBy(key).agg(*[F.sum(F.when(F.col(f"u{i}"), F.col("present"))).alias(f"p{i}") for i in range(n)],
                                 *[F.sum(F.when(F.col(f"u{i}"), F.col("occurs"))).alias(f"o{i}") for i in range(n)],
                                 *[F.count(F.when(F.col(f"u{i}"), 1)).alias(f"k{i}") for i in range(n)])
    every = rows.select(key, *keep).join(sums, key, "left").withColumn("__t", totals.select(F.struct("*")).scalar())

    def margin(i: int, model: str) -> Column:
        if model == "bernoulli":
            return F.col("__t.prior") + F.col(f"__t.a{i}") + F.coalesce(f"p{i}", F.lit(0.0))
        return F.col("__t.prior") + F.coalesce(f"o{i}", F.lit(0.0)) - F.coalesce(f"k{i}", F.lit(0)) * F.col(f"__t.t{i}")

    found = [F.struct(F.lit(name).alias("method"), F.lit(m).alias("model"), margin(i, m).alias("margin"))
             for i, name in enumerate(sets) for m in models]
    return every.select(key, *keep, F.inline(F.array(*found)))


def probability(margin="margin") -> Column:
    """P(positive | x)."""
    return 1 / (1 + F.exp(-F.col(margin)))


def accuracies(scored: DataFrame, label: str, positive=1) -> DataFrame:
    """``method``, ``model``, ``accuracy`` from the margins of labelled rows."""
    right = (F.col("margin") > 0) == (F.col(label) == positive)
    return scored.groupBy("method", "model").agg(F.avg(right.cast("double")).alias("accuracy"))


def save(table: DataFrame, totals: DataFrame, path: str) -> None:
    """The model as two Parquet tables."""
    table.write.parquet(f"{path}/features")
    totals.write.parquet(f"{path}/totals")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/totals")
