"""Relational operators: joins, popularity semi-join, counts, means, pivots,
grouping sets, histogram, update-from, melt (SURVEY §2.3–§2.5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Column
from pyspark.sql import functions as F

from roamlens.functions.columns import col_, round6


# ----------------------------------------------------------------- J3 / A1
def popular_keys(comments: DataFrame, key: str = "poi_id", min_count: int = 10) -> DataFrame:
    """A1: keys with more than ``min_count`` non-null occurrences.

    Partial (map-side) aggregation makes this safe under a hot key: every
    task pre-counts before the shuffle, so the exchange carries one row per
    key per task."""
    return (comments.groupBy(key).agg(F.count(key).alias("__n"))
            .filter(F.col("__n") > min_count).select(key))


def popular_join(poi: DataFrame, comments: DataFrame, key: str = "poi_id",
                 min_count: int = 10) -> DataFrame:
    """J1 + J3: POI ⋈ comment restricted to POIs with more than ``min_count``
    comments, counted on the comment table before the join (Q16).

    The popular-key set is one row per key; AQE turns the semi join into a
    broadcast join at run time when that set is small and splits skewed
    partitions otherwise."""
    keep = popular_keys(comments, key, min_count)
    return poi.join(comments, key).join(keep, key, "left_semi")


# ----------------------------------------------------------------- A2 / A3 / A11 / A12
def value_counts(df: DataFrame, c: str, out: str = "n") -> DataFrame:
    """A2: count per non-null value (pandas ``value_counts`` drops nulls)."""
    return df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias(out))


def counts_by(df: DataFrame, *keys, out: str = "n") -> DataFrame:
    """Group sizes (nulls form their own group, like ``groupby().size``
    with ``dropna=False``)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def distinct_keys(df: DataFrame, *keys) -> DataFrame:
    """Distinct key set."""
    return df.select(*keys).distinct()


# ----------------------------------------------------------------- A4 / A5
def group_mean(df: DataFrame, key, value: str, out: str = "mean") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(round6(F.avg(value)).alias(out))


# ----------------------------------------------------------------- A9
def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max] with the last bin closed
    (numpy/pandas ``hist`` semantics); a constant column spans min±0.5.

    min/max are one aggregate row used through scalar subqueries, so the
    data side never moves."""
    stats = (df.agg(F.min(value).alias("__lo0"), F.max(value).alias("__hi0"))
             .select(F.when(F.col("__lo0") == F.col("__hi0"), F.col("__lo0") - 0.5)
                     .otherwise(F.col("__lo0")).alias("__lo"),
                     F.when(F.col("__lo0") == F.col("__hi0"), F.col("__hi0") + 0.5)
                     .otherwise(F.col("__hi0")).alias("__hi")))
    st = stats.select(F.struct("__lo", "__hi")).scalar()
    df = df.withColumn("__st", st)
    lo, hi = F.col("__st.__lo"), F.col("__st.__hi")
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    x = (df.filter(F.col(value).isNotNull())
         .withColumn("__lo", lo).withColumn("__hi", hi).withColumn("bin", b))
    return (x.groupBy("bin", "__lo", "__hi").agg(F.count(F.lit(1)).alias("n"))
            .select("bin",
                    round6(F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("lo"),
                    round6(F.col("__lo") + (F.col("bin") + 1) * (F.col("__hi") - F.col("__lo")) / bins).alias("hi"),
                    "n"))


# ----------------------------------------------------------------- A6 / A7 / A8
def pivot_count(df: DataFrame, index, pivot_col: str, values, count_col: str | None = None,
                fill: int | None = None) -> DataFrame:
    """Counts unstacked to one column per pivot value.

    ``values`` is passed explicitly (no extra distinct job, stable schema).
    ``count_col`` counts its non-nulls (``pivot_table(aggfunc='count')``);
    rows with a null index or pivot key are dropped (pandas groupby default).
    ``fill=None`` leaves missing cells null (``unstack``); ``fill=0`` fills."""
    index = [index] if isinstance(index, str) else list(index)
    agg = F.count(count_col) if count_col else F.count(F.lit(1))
    src = df
    for c in index + [pivot_col]:
        src = src.filter(F.col(c).isNotNull())
    out = src.groupBy(*index).pivot(pivot_col, list(values)).agg(agg)
    if fill is not None:
        out = out.na.fill(fill, subset=[str(v) for v in values])
    return out


# ----------------------------------------------------------------- A22
def grouping_sets_overview(df: DataFrame, sets: list[list[str]], measure: str,
                           out_count: str = "n", out_mean: str = "mean") -> DataFrame:
    """One pass computing count and mean for several groupings
    (``GROUPING SETS``) plus the grouping id."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return (df.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
            .agg(F.count(F.lit(1)).alias(out_count), round6(F.avg(measure)).alias(out_mean),
                 F.grouping_id(*cols).alias("gid")))


# ----------------------------------------------------------------- A10 / P11
def bundle_per_group(df: DataFrame, key: str, order_cols, keep) -> DataFrame:
    """A10: the rows of each group laid out contiguously and in order, with
    their position inside the group.

    Long form on purpose: a list-per-group column would put a hot group into a
    single row and task.  Consumers that need one string per group for a
    small group can ``array_join`` a ``collect_list`` of this output."""
    from roamlens.operators.ordering import group_ordinal
    return group_ordinal(df.select(key, *keep, *[c for c in order_cols if c not in keep]),
                         [key], order_cols, out="pos")


def join_texts(df: DataFrame, key: str, order_col: str, text: str, sep: str = ".",
               out: str = "joined") -> DataFrame:
    """P11 per group, for bounded groups (a document's sentences, a POI's
    short comment list in tests): ordered text joined with ``sep``."""
    return (df.groupBy(key)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_col, text))),
                                          lambda s: s[text]), sep).alias(out)))


# ----------------------------------------------------------------- J4 / J9 / X15 / U5
def anti_frontier(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct ids with no row in ``known``."""
    return ids.select(key).distinct().join(known.select(key), key, "left_anti")


def update_from(target: DataFrame, updates: DataFrame, key: str, col: str, order: str | None = None) -> DataFrame:
    """``UPDATE target SET col = u.col FROM updates u WHERE key`` —
    unmatched rows and null updates keep the old value.  Of several updates of a
    key the last one by ``order`` that is not null counts (the greatest without
    an order), whatever order the rows arrive in."""
    u = updates.filter(F.col(col).isNotNull()).groupBy(key).agg(
        F.max_by(col, F.struct(order, col) if order else F.col(col)).alias("__new"))
    return (target.join(u, key, "left")
            .withColumn(col, F.coalesce(F.col("__new"), F.col(col))).drop("__new"))


# ----------------------------------------------------------------- P9 / P10
def melt(df: DataFrame, ids, values, var: str = "variable", val: str = "value") -> DataFrame:
    """Long form by id (``pd.melt``)."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    return df.unpivot(ids, list(values), var, val)


def dropna_all(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows where every (subset) column is null."""
    return df.na.drop(how="all", subset=subset)


def with_null_column(df: DataFrame, name: str, dtype: str = "string") -> DataFrame:
    """P10."""
    return df.withColumn(name, F.lit(None).cast(dtype))


def strict_int(c) -> Column:
    """ANSI cast — malformed input raises, as the pandas cast does."""
    return col_(c).cast("int")


def union_all(frames) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b), frames)
