"""Fuzzy home-town resolution queries.

Stand-in gazetteer (file order = key order): provinces = regions, cities =
nations under their region, counties = suppliers under their nation.
Home towns are edited names derived per user from the same tables (exact
city, misspelt province, reformatted city, junk, a '-'-led token list), all
ASCII because the oracle's levenshtein counts bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.functions.columns import partial_similarity
from roamlens.operators import fuzzy as FZ
from roamlens.operators import simjoin as SJ
from roamlens.plans.registry import register
from roamlens.plans.standins import Tables

BIG = 1_000_000


def gazetteer(t):
    r, n, s = t["region"], t["nation"], t["supplier"]
    prov = r.select((F.col("r_regionkey").cast("long") * BIG * BIG).alias("ord"), F.lit(1).alias("level"),
                    F.col("r_name").alias("name"), F.col("r_name").alias("province"))
    city = (n.join(r, n.n_regionkey == r.r_regionkey)
            .select((F.col("r_regionkey").cast("long") * BIG * BIG + (F.col("n_nationkey") + 1) * BIG).alias("ord"),
                    F.lit(2).alias("level"), F.col("n_name").alias("name"), F.col("r_name").alias("province")))
    county = (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
              .select((F.col("r_regionkey").cast("long") * BIG * BIG + (F.col("n_nationkey") + 1) * BIG
                       + F.col("s_suppkey") + 1).alias("ord"),
                      F.lit(3).alias("level"), F.col("s_name").alias("name"), F.col("r_name").alias("province")))
    return prov.unionByName(city).unionByName(county)


def users(t):
    c, n, r = t["customer"], t["nation"], t["region"]
    seg = F.col("c_mktsegment")
    town = (F.when(seg == "AUTOMOBILE", F.col("n_name"))
            .when(seg == "BUILDING", F.concat(F.expr("substr(r_name, 1, length(r_name) - 1)"), F.lit("x")))
            .when(seg == "FURNITURE", F.concat(F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))), F.lit("a")))
            .when((seg == "HOUSEHOLD") & (F.col("c_custkey") % 2 == 0), F.concat("n_name", F.lit("town")))  # unspaced
            .when(seg == "HOUSEHOLD", F.col("c_name"))
            .otherwise(F.concat(F.lit("- "), F.col("n_name"))))
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("c_custkey").alias("custom_id"), town.alias("custom_cty"),
                    F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("OLD_"), F.col("r_name")))
                    .alias("custom_province")))


SQL_GAZ = f"""
g AS (SELECT CAST(r_regionkey AS BIGINT) * {BIG} * {BIG} AS ord, 1 AS level, r_name AS name, r_name AS province FROM region
      UNION ALL
      SELECT CAST(r.r_regionkey AS BIGINT) * {BIG} * {BIG} + (n.n_nationkey + 1) * {BIG}, 2, n.n_name, r.r_name
      FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
      UNION ALL
      SELECT CAST(r.r_regionkey AS BIGINT) * {BIG} * {BIG} + (n.n_nationkey + 1) * {BIG} + s.s_suppkey + 1, 3, s.s_name, r.r_name
      FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

SQL_USERS = r"""
u0 AS (SELECT c.c_custkey AS custom_id,
         CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN n.n_name
              WHEN c.c_mktsegment = 'BUILDING' THEN substr(r.r_name, 1, length(r.r_name) - 1) || 'x'
              WHEN c.c_mktsegment = 'FURNITURE' THEN lower(replace(n.n_name, '_', ' ')) || 'a'
              WHEN c.c_mktsegment = 'HOUSEHOLD' AND c.c_custkey % 2 = 0 THEN n.n_name || 'town'
              WHEN c.c_mktsegment = 'HOUSEHOLD' THEN c.c_name
              ELSE '- ' || n.n_name END AS custom_cty,
         CASE WHEN c.c_acctbal > 5000 THEN 'OLD_' || r.r_name END AS custom_province
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
u1 AS (SELECT *, CASE WHEN length(custom_cty) > 3 THEN (SELECT arg_max(g.name, length(g.name)) FROM g
             WHERE starts_with(regexp_replace(u0.custom_cty, '^[\s,，、;；/-]+', ''), g.name)) END AS word FROM u0),
u AS (SELECT custom_id, custom_cty, custom_province, CASE WHEN custom_cty IS NULL THEN NULL
                     WHEN word IS NOT NULL THEN word
                     WHEN length(custom_cty) > 3 THEN list_filter(regexp_split_to_array(custom_cty, '[\s,，、;；/]+'),
                                                        lambda x: trim(x) NOT IN ('', '-'))[1]
                     WHEN trim(custom_cty) NOT IN ('', '-') THEN custom_cty END AS q FROM u1)"""

NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _sim(a, b):
    m = f"greatest(length({a}), length({b}))"
    return f"(CASE WHEN {m} = 0 THEN 100 ELSE CAST(round(100.0 * (1 - levenshtein({a}, {b}) / {m})) AS INTEGER) END)"


SQL_PAIRS = f"""WITH {SQL_GAZ.strip()},
{SQL_USERS.strip()},
qs AS (SELECT DISTINCT q FROM u WHERE q IS NOT NULL),
qn AS (SELECT q, {NORM.format('q')} AS qn FROM qs WHERE {NORM.format('q')} <> ''),
gn AS (SELECT *, {NORM.format('name')} AS cn FROM g WHERE {NORM.format('name')} <> ''),
pairs AS (SELECT q, level, name, ord, {_sim('qn', 'cn')} AS score FROM qn, gn),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q, level ORDER BY score DESC, ord) AS rank
           FROM pairs WHERE score > 0)"""


def _words_and_names(t):
    """The matched word of each home town, and the names it is matched with."""
    words = FZ.dictionary_token(users(t), gazetteer(t), "custom_cty", out="q").select("q").filter(F.col("q").isNotNull())
    return words, gazetteer(t).select("ord", "level", "name")


@register("fuzzy_top1", ids="N14 J6 T5", sql=SQL_PAIRS + """
SELECT q, level, name, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 1""")
def fuzzy_top1(spark, sf_dir):
    return SJ.top_matches(*_words_and_names(Tables(spark, sf_dir)), 1).select(
        "q", "level", "name", "score", "rank")


@register("fuzzy_topn", ids="T5 F4 N14", sql=SQL_PAIRS + """
SELECT q, level, name, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3""")
def fuzzy_topn(spark, sf_dir):
    return SJ.top_matches(*_words_and_names(Tables(spark, sf_dir)), 3).select(
        "q", "level", "name", "score", "rank")


@register("fuzzy_partial", ids="N14 J6", sql=SQL_PAIRS + f""",
sized AS (SELECT *, CASE WHEN length(qn) <= length(cn) THEN qn ELSE cn END AS s, CASE WHEN length(qn) <= length(cn) THEN cn ELSE qn END AS l
          FROM qn, gn),
windows AS (SELECT q, level, name, ord, s, substr(l, CAST(unnest(range(1, length(l) - length(s) + 2)) AS INTEGER), length(s)) AS w FROM sized)
SELECT q, level, name, ord, max({_sim('s', 'w')}) AS score FROM windows GROUP BY ALL HAVING max({_sim('s', 'w')}) > {FZ.THRESHOLD}""")
def fuzzy_partial(spark, sf_dir):
    return SJ.candidates(*_words_and_names(Tables(spark, sf_dir)), threshold=FZ.THRESHOLD, scorer=partial_similarity).select(
        "q", "level", "name", "ord", "score")


@register("gazetteer_lookup", ids="J7", sql=f"""WITH {SQL_GAZ.strip()}
SELECT name, arg_min(province, ord) AS province FROM g GROUP BY name""")
def gazetteer_lookup(spark, sf_dir):
    return FZ.name_to_province(gazetteer(Tables(spark, sf_dir)))


@register("resolve_region", ids="N15 N16 N17 J6 J7 J9 P6 A16", sql=SQL_PAIRS + """,
top AS (SELECT * FROM ranked WHERE rank = 1),
wide AS (SELECT q, max(score) FILTER (WHERE level = 1) AS s1, max(score) FILTER (WHERE level = 2) AS s2,
                max(score) FILTER (WHERE level = 3) AS s3, max(name) FILTER (WHERE level = 1) AS n1,
                max(name) FILTER (WHERE level = 2) AS n2, max(name) FILTER (WHERE level = 3) AS n3
         FROM top GROUP BY q),
base AS (SELECT qs.q, coalesce(s1, 0) AS p, coalesce(s2, 0) AS c, coalesce(s3, 0) AS k, n1, n2, n3, s1, s2, s3
         FROM qs LEFT JOIN wide ON wide.q = qs.q),
dec AS (SELECT *, CASE WHEN p = 100 OR (p = greatest(p, c, k) AND p > 60) THEN 1
                       WHEN c = 100 OR (c = greatest(p, c, k) AND c > 60) THEN 2
                       WHEN k = 100 OR (k = greatest(p, c, k) AND k > 60) THEN 3 END AS lv FROM base),
ch AS (SELECT q, lv, CASE lv WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 END AS matched,
              CASE lv WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 END AS score FROM dec),
n2p AS (SELECT name, arg_min(province, ord) AS province FROM g GROUP BY name),
res AS (SELECT ch.*, n2p.province FROM ch LEFT JOIN n2p ON n2p.name = ch.matched),
upd AS (SELECT u.custom_id, res.lv, res.matched, res.score, res.province FROM u JOIN res ON res.q = u.q
        WHERE res.province IS NOT NULL)
SELECT u.custom_id, u.custom_cty, COALESCE(upd.province, u.custom_province) AS custom_province,
       upd.lv AS match_level, upd.matched AS match_name, upd.score AS match_score
FROM u LEFT JOIN upd ON upd.custom_id = u.custom_id""")
def resolve_region(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return FZ.resolve_users(users(t), gazetteer(t)).select(
        "custom_id", "custom_cty", "custom_province", "match_level", "match_name", "match_score")
