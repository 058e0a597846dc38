"""Fuzzy gazetteer resolution.

Queries are the distinct home-town strings, matched by the similarity joins of
``simjoin``; results are joined back to the users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roamlens.functions.columns import col_
from roamlens.operators.simjoin import top_matches
from roamlens.session import cut_lineage

LEVELS = {1: "province", 2: "city", 3: "county"}
THRESHOLD = 60


# ------------------------------------------------------------------ gazetteer
def flatten_gazetteer_list(df: DataFrame, col: str = "value") -> DataFrame:
    """S12 list shape ``[{province: [{city: [county, ...]}, ...]}, ...]`` ->
    (ord, level, name, province) in file (traversal) order."""
    p = df.select(F.posexplode(col).alias("pi", "pm")).select("pi", F.explode("pm").alias("province", "cities"))
    c = p.select("pi", "province", F.posexplode("cities").alias("ci", "cm")) \
         .select("pi", "province", "ci", F.explode("cm").alias("city", "counties"))
    k = c.select("pi", "province", "ci", "city", F.posexplode("counties").alias("ki", "county"))
    return _ordered(p.select("pi", "province"), c.select("pi", "province", "ci", "city"),
                    k.select("pi", "province", "ci", "ki", "county"))


def flatten_gazetteer_map(df: DataFrame, col: str = "value") -> DataFrame:
    """S12/Q6 map shape ``{province: {city: [county, ...]}}`` (what the text
    parser writes); map entries keep their file order."""
    p = df.select(F.posexplode(F.map_entries(col)).alias("pi", "e")) \
          .select("pi", F.col("e.key").alias("province"), F.col("e.value").alias("cities"))
    c = p.select("pi", "province", F.posexplode(F.map_entries("cities")).alias("ci", "e")) \
         .select("pi", "province", "ci", F.col("e.key").alias("city"), F.col("e.value").alias("counties"))
    k = c.select("pi", "province", "ci", "city", F.posexplode("counties").alias("ki", "county"))
    return _ordered(p.select("pi", "province"), c.select("pi", "province", "ci", "city"),
                    k.select("pi", "province", "ci", "ki", "county"))


def _ordered(p, c, k):
    # traversal order: province, then each city followed by its counties
    big = 1 << 20
    p, c, k = (x.withColumn("pi", F.col("pi").cast("long")) for x in (p, c, k))
    rows = (p.select((F.col("pi") * big * big).alias("o"), F.lit(1).alias("level"),
                     F.col("province").alias("name"), "province")
            .unionByName(c.select((F.col("pi") * big * big + (F.col("ci") + 1) * big).alias("o"),
                                  F.lit(2).alias("level"), F.col("city").alias("name"), "province"))
            .unionByName(k.select((F.col("pi") * big * big + (F.col("ci") + 1) * big + F.col("ki") + 1).alias("o"),
                                  F.lit(3).alias("level"), F.col("county").alias("name"), "province")))
    return rows.select(F.col("o").cast("long").alias("ord"), "level", "name", "province")


def parse_gazetteer_text(df: DataFrame, col: str = "value") -> DataFrame:
    """A whole-text gazetteer ``/province/city: county county ...`` ->
    the map shape ``{province: {city: [county, ...]}}`` (one row).  Lines blank
    after trimming are dropped; pieces alternate province name / body."""
    parts = df.select(F.posexplode(F.split(col, "/")).alias("i", "piece"))
    names = parts.filter((F.col("i") % 2 == 1)).select((F.col("i") + 1).alias("j"), F.col("piece").alias("province"))
    bodies = parts.filter((F.col("i") % 2 == 0) & (F.col("i") > 0)).select(F.col("i").alias("j"), "piece")
    lines = (names.join(bodies, "j")
             .select("j", "province", F.posexplode(F.split("piece", "\n")).alias("li", "line"))
             .filter(F.trim("line") != "")
             .withColumn("kv", F.split("line", ":", 2))
             .select("j", "province", "li", F.element_at("kv", 1).alias("city"),
                     F.split(F.trim(F.element_at("kv", 2)), " ").alias("counties")))
    per_prov = (lines.groupBy("j", "province")
                .agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("li", "city", "counties"))),
                                                    lambda s: F.struct(s["city"], s["counties"]))).alias("cities")))
    by_j = F.array_sort(F.collect_list(F.struct("j", "province", "cities")),
                        lambda a, b: F.when(a["j"] < b["j"], -1).when(a["j"] > b["j"], 1).otherwise(0))
    return per_prov.agg(F.map_from_entries(F.transform(by_j, lambda s: F.struct(s["province"], s["cities"]))).alias(col))


def name_to_province(gazetteer: DataFrame) -> DataFrame:
    """Each name -> the first province (file order) whose own name, a
    city or a county equals it."""
    return gazetteer.groupBy("name").agg(F.min_by("province", "ord").alias("province"))


# ------------------------------------------------------------------ decision
def decide(p_score, c_score, k_score, threshold: int = THRESHOLD) -> Column:
    """Which level's top-1 is taken: province if 100 or (the maximum and
    > threshold); else city by the same rule; else county; else none."""
    p, c, k = (F.coalesce(col_(x), F.lit(0)) for x in (p_score, c_score, k_score))
    m = F.greatest(p, c, k)
    return (F.when((p == 100) | ((p == m) & (p > threshold)), 1)
            .when((c == 100) | ((c == m) & (c > threshold)), 2)
            .when((k == 100) | ((k == m) & (k > threshold)), 3))


def first_token(c, max_len: int = 3) -> Column:
    """P6 + N16: strings longer than ``max_len`` characters are tokenised and
    only the first token that is not blank or '-' is matched; shorter
    strings are matched whole; null stays null."""
    c = col_(c)
    toks = F.filter(F.split(c, r"[\s,，、;；/]+"), lambda t: ~F.trim(t).isin("", "-"))
    return F.when(c.isNull(), F.lit(None).cast("string")) \
            .when(F.length(c) > max_len, F.element_at(toks, 1)) \
            .otherwise(F.when(~F.trim(c).isin("", "-"), c))


def dictionary_token(towns: DataFrame, names: DataFrame, town: str, name: str = "name",
                     max_len: int = 3, out: str = "token") -> DataFrame:
    """P6 + N16 for unspaced strings: a town longer than ``max_len`` characters is
    matched by its first word, the longest name that it begins with (blanks, dashes
    and separators before it skipped); without one, by its first separated token.

    The towns' prefixes (no longer than the longest name) are equi-joined with the
    names, so a town meets only names it begins with."""
    d = names.select(F.col(name).alias("__n")).filter(F.length("__n") > 0).distinct()
    longest = d.agg(F.max(F.length("__n"))).scalar()
    lead = F.regexp_replace(F.col(town), r"^[\s,，、;；/-]+", "")
    t = towns.select(town).distinct().withColumn("__t", lead).withColumn("__max", longest)
    pre = t.filter((F.length(town) > max_len) & (F.length("__t") > 0) & (F.col("__max") > 0))
    pre = pre.select(town, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("__t"), F.col("__max"))),
                                                 lambda n: F.substring(F.col("__t"), F.lit(1), n))).alias("__n"))
    found = pre.join(d, "__n").groupBy(town).agg(F.max_by("__n", F.length("__n")).alias("__w"))
    return (t.drop("__t", "__max").join(found, town, "left")
            .select(town, F.coalesce("__w", first_token(town, max_len)).alias(out)))


def resolve(queries: DataFrame, gazetteer: DataFrame, q: str = "q", threshold: int = THRESHOLD) -> DataFrame:
    """N15 + J7 on distinct query strings: (q, p/c/k top-1 name and score,
    chosen level, matched name, province)."""
    # Only scores above the threshold can decide (N15), so candidates are
    # generated with the exact prefix filter for that threshold.
    top = top_matches(queries, gazetteer.select("ord", "level", "name"), 1, q, "name", threshold=threshold)
    wide = top.groupBy(q).agg(
        *[F.max(F.when(F.col("level") == lv, F.col("score"))).alias(f"s{lv}") for lv in (1, 2, 3)],
        *[F.max(F.when(F.col("level") == lv, F.col("name"))).alias(f"n{lv}") for lv in (1, 2, 3)])
    base = queries.select(q).distinct().join(wide, q, "left")
    lv = decide("s1", "s2", "s3", threshold)
    chosen = (base.withColumn("level", lv)
              .withColumn("matched", F.when(lv == 1, F.col("n1")).when(lv == 2, F.col("n2"))
                          .when(lv == 3, F.col("n3")))
              .withColumn("score", F.when(lv == 1, F.col("s1")).when(lv == 2, F.col("s2"))
                          .when(lv == 3, F.col("s3"))))
    n2p = name_to_province(gazetteer)
    return chosen.join(n2p.withColumnRenamed("name", "matched"), "matched", "left")


def resolve_users(users: DataFrame, gazetteer: DataFrame, town: str = "custom_cty",
                  key: str = "custom_id", target: str = "custom_province",
                  threshold: int = THRESHOLD) -> DataFrame:
    """N17 whole flow: the distinct towns get their token (P6/N16), the distinct
    tokens are resolved once (three-level top-1 -> N15 -> J7), and the users take the
    result over their town (J9: unmatched users keep their value)."""
    towns = cut_lineage(dictionary_token(users.filter(F.col(town).isNotNull()), gazetteer, town, out="__q"))
    res = resolve(towns.select("__q").filter(F.col("__q").isNotNull()), gazetteer, "__q", threshold)
    hit = F.col("__new").isNotNull()
    found = (towns.join(res.select("__q", "level", "matched", "score", F.col("province").alias("__new")), "__q")
             .filter(hit).select(F.col(town), "__new", F.col("level").alias("match_level"),
                                 F.col("matched").alias("match_name"), F.col("score").alias("match_score")))
    return (users.join(found, town, "left")
            .withColumn(target, F.coalesce("__new", target)).drop("__new"))
