"""Mixing sources to target weights.

Every document gets a hash-random key.  Within a source the keys are cut into
equal ranges (as many as the source has blocks of rows), each range is summed,
the sums are summed up over the ranges before, and inside a range a running sum
gives each document's place in its source's random order.  A source takes as
many whole epochs as its target holds, and of one more epoch exactly the words
that remain, cut inside the document at the budget's end.

A hot source is spread over its ranges; the only unsplit windows hold one row
for each source, or one for each range of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roamlens.llm.common import materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 20177
#: Rows of a source in one range of keys.
RANGE_ROWS = 4_000
#: Sources (rows of five numbers) that may be broadcast.
MOST_BROADCAST = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """Per source: n_rows, source_size, weight, target.  Sources by code point,
    null last, take the weights in turn; a target is its weight's share of all
    words, but at most ``most`` times its source, what is above being shared again.

    The level ``words / weight`` that sources below their cap reach is found on
    the sources sorted by ``cap / weight``: exact integer sums, one division."""
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", w.cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most)
    order = [F.col("cap") / F.col("weight"), F.col("place")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (per.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
           .withColumn("shares", F.sum("weight").over(rest)))
    # The first source whose cap lies above the level of itself and all after it.
    fits = F.col("cap") * F.col("shares") >= F.col("weight") * F.col("left")
    first = F.min(F.when(fits, F.struct(order[0].alias("a"), order[1].alias("b"),
                                        F.col("left").alias("l"), F.col("shares").alias("s")))).over(everything)
    level = F.col("weight") * first["l"] / first["s"]
    return per.withColumn("target", F.least(F.col("cap").cast("double"), level.cast("double"))).select(
        "source", "n_rows", "source_size", "weight", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights=WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED, range_rows: int = RANGE_ROWS,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, taken (words the
    mix takes of it, repeats counted), and the columns named in ``keep``.

    Null texts have size 0, a null source is a source of its own, null ids and
    repeated rows are documents like any other (ties of the key go by id, size
    and text hash; equal rows are interchangeable)."""
    sized = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"),
                        word_count(docs[text_col]).alias("size"), F.md5(docs[text_col]).alias("h"),
                        *[docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)])
    narrow = materialise(sized.select("id", "source", "size", "h"), "document-sizes")  # the texts are counted once
    goal = materialise(source_targets(narrow, weights, most).withColumnRenamed("source", "of"), "source-targets")
    few = goal.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST

    def keyed(rows: DataFrame) -> DataFrame:
        # One row for each source: broadcast if they are few, else merged (AQE splits hot sources).
        rows = rows.join(goal.hint("broadcast" if few else "merge"), F.col("source").eqNullSafe(F.col("of")), "inner").drop("of")
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
        part = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("n_rows") / range_rows)
        return rows.withColumn("key", key).withColumn("range", F.floor(part / F.lit(2.0 ** 32)).cast("long"))

    sums = keyed(narrow).groupBy(F.col("source").alias("s"), F.col("range").alias("r")).agg(F.sum("size").alias("range_size"))
    sums = sums.withColumn("range_start", F.coalesce(
        F.sum("range_size").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("source", "range").orderBy("key", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    both = keyed(sized if keep else narrow)
    # Both sides are dealt by (source, range) already: merged where they lie, never broadcast.
    placed = both.withColumn("place", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        sums.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")), "inner")
    placed = placed.withColumn("place", F.col("place") + F.col("range_start"))
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    part = budget - epochs * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), part - F.col("place")))
    taken = (epochs * F.col("size") + more).cast("long")
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"),
                         *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def copies(mixed: DataFrame, text_col: str = "text", word: str = WORD) -> DataFrame:
    """The mix as rows: a document stands once for each whole repeat, and once more
    cut after its last taken word if it was cut at the budget's end."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    rows = mixed.withColumn("words", F.explode(F.concat(
        F.array_repeat(F.lit(None).cast("int"), whole.cast("int")),
        F.when(rest > 0, F.array(rest.cast("int"))).otherwise(F.array().cast("array<int>")))))
    prefix = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(rf"([\x20\x09-\x0D]*{word})"), 1),
                                  1, F.coalesce("words", F.lit(1))), "")
    return rows.withColumn(text_col, F.when(F.col("words").isNull(), F.col(text_col)).otherwise(prefix)).drop("words")
