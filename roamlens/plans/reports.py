"""Relational reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from roamlens.functions.columns import year_of, date_rest
from roamlens.operators import relational as R
from roamlens.plans.registry import register
from roamlens.plans.standins import (POPULAR_MIN, PROVINCES, SEXES, SQL_POPULAR,
                                     SQL_POPULAR_USERS, Tables)


def popular_comments(t: Tables):
    return R.popular_join(t.poi, t.comments, "poi_id", POPULAR_MIN)


def popular_users(t: Tables):
    keep = R.popular_keys(t.comments, "poi_id", POPULAR_MIN)
    return (t.poi.join(t.user_comments, "poi_id").join(t.users, "custom_id")
            .join(keep, "poi_id", "left_semi")
            .withColumn("year", year_of("comment_time"))
            .withColumn("another_date", date_rest("comment_time")))


SQL_USERS_Y = f"""WITH base AS ({SQL_POPULAR_USERS}),
m AS (SELECT *, split_part(comment_time, '-', 1) AS year FROM base)"""


@register("popular_poi_comments", sql=SQL_POPULAR, ids="S1 J1 J3 A1 T6 P1")
def popular_poi_comments(spark, sf_dir):
    return popular_comments(Tables(spark, sf_dir)).select(
        "scene_spot_name", "poi_id", "order_key", "line_no", "comment_time", "comment_star")


@register("popular_poi_comments_users", sql=SQL_POPULAR_USERS, ids="S2 J2 J3")
def popular_poi_comments_users(spark, sf_dir):
    return popular_users(Tables(spark, sf_dir)).select(
        "scene_spot_name", "poi_id", "order_key", "line_no", "comment_time", "comment_star",
        "custom_id", "custom_cty", "custom_sex", "custom_province")


@register("province_counts", ids="A2", sql=f"""{SQL_USERS_Y}
SELECT custom_province, count(*) AS n FROM m WHERE custom_province IS NOT NULL GROUP BY 1""")
def province_counts(spark, sf_dir):
    return R.value_counts(popular_users(Tables(spark, sf_dir)), "custom_province")


@register("sex_counts", ids="A2", sql=f"""{SQL_USERS_Y}
SELECT custom_sex, count(*) AS n FROM m WHERE custom_sex IS NOT NULL GROUP BY 1""")
def sex_counts(spark, sf_dir):
    return R.value_counts(popular_users(Tables(spark, sf_dir)), "custom_sex")


@register("year_counts", ids="A3 P3", sql=f"""{SQL_USERS_Y}
SELECT year, count(*) AS n FROM m GROUP BY 1""")
def year_counts(spark, sf_dir):
    return R.counts_by(popular_users(Tables(spark, sf_dir)), "year")


@register("date_split", ids="P3", sql=f"""{SQL_USERS_Y}
SELECT order_key, line_no, year,
       CASE WHEN strpos(comment_time, '-') > 0 THEN substr(comment_time, strpos(comment_time, '-') + 1) END AS another_date
FROM m""")
def date_split(spark, sf_dir):
    return popular_users(Tables(spark, sf_dir)).select("order_key", "line_no", "year", "another_date")


@register("poi_mean_star", ids="A5", sql=f"""{SQL_USERS_Y}
SELECT poi_id, round(avg(comment_star), 6) AS mean_star FROM m GROUP BY 1""")
def poi_mean_star(spark, sf_dir):
    return R.group_mean(popular_users(Tables(spark, sf_dir)), "poi_id", "comment_star", "mean_star")


@register("spot_mean_star", ids="A4", sql=f"""{SQL_USERS_Y}
SELECT scene_spot_name, round(avg(comment_star), 6) AS mean_star FROM m GROUP BY 1""")
def spot_mean_star(spark, sf_dir):
    return R.group_mean(popular_users(Tables(spark, sf_dir)), "scene_spot_name", "comment_star",
                        "mean_star")


@register("star_histogram", ids="A9", sql=f"""{SQL_USERS_Y},
pm AS (SELECT poi_id, round(avg(comment_star), 6) AS v FROM m GROUP BY 1),
st AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM pm),
b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, lo, hi FROM pm, st)
SELECT bin, round(lo + bin * (hi - lo) / 10, 6) AS lo, round(lo + (bin + 1) * (hi - lo) / 10, 6) AS hi,
       count(*) AS n FROM b GROUP BY bin, b.lo, b.hi""")
def star_histogram(spark, sf_dir):
    pm = R.group_mean(popular_users(Tables(spark, sf_dir)), "poi_id", "comment_star", "v")
    return R.histogram(pm, "v", bins=10)


def _filter_cols(pivot, vals, count_expr, null_if_zero):
    out = []
    for v in vals:
        e = f"{count_expr} FILTER (WHERE {pivot} = '{v}')"
        out.append(f"NULLIF({e}, 0) AS \"{v}\"" if null_if_zero else f"{e} AS \"{v}\"")
    return ",\n       ".join(out)


@register("pivot_year_sex_province", ids="A8", sql=f"""{SQL_USERS_Y}
SELECT year, custom_sex,
       {_filter_cols('custom_province', PROVINCES, 'count(comment_star)', False)}
FROM m WHERE year IS NOT NULL AND custom_sex IS NOT NULL AND custom_province IS NOT NULL
GROUP BY year, custom_sex""")
def pivot_year_sex_province(spark, sf_dir):
    return R.pivot_count(popular_users(Tables(spark, sf_dir)), ["year", "custom_sex"],
                         "custom_province", PROVINCES, count_col="comment_star", fill=0)


@register("province_sex_unstack", ids="A6", sql=f"""{SQL_USERS_Y}
SELECT custom_province,
       {_filter_cols('custom_sex', SEXES, 'count(custom_sex)', True)}
FROM m WHERE custom_province IS NOT NULL AND custom_sex IS NOT NULL GROUP BY custom_province""")
def province_sex_unstack(spark, sf_dir):
    return R.pivot_count(popular_users(Tables(spark, sf_dir)), ["custom_province"], "custom_sex",
                         SEXES, count_col="custom_sex", fill=None)


@register("year_province_sex_unstack", ids="A7", sql=f"""{SQL_USERS_Y}
SELECT year, custom_province,
       {_filter_cols('custom_sex', SEXES, 'count(custom_sex)', True)}
FROM m WHERE year IS NOT NULL AND custom_province IS NOT NULL AND custom_sex IS NOT NULL
GROUP BY year, custom_province""")
def year_province_sex_unstack(spark, sf_dir):
    return R.pivot_count(popular_users(Tables(spark, sf_dir)), ["year", "custom_province"],
                         "custom_sex", SEXES, count_col="custom_sex", fill=None)


@register("overview_grouping_sets", ids="A22", sql=f"""{SQL_USERS_Y}
SELECT custom_province, custom_sex, year, poi_id, count(*) AS n,
       round(avg(comment_star), 6) AS mean,
       grouping_id(custom_province, custom_sex, year, poi_id) AS gid
FROM m GROUP BY GROUPING SETS ((custom_province), (custom_sex), (year), (poi_id), ())""")
def overview_grouping_sets(spark, sf_dir):
    return R.grouping_sets_overview(
        popular_users(Tables(spark, sf_dir)),
        [["custom_province"], ["custom_sex"], ["year"], ["poi_id"], []], "comment_star")


@register("poi_comment_bundle", ids="A10 P11 J8", sql=f"""WITH b AS ({SQL_POPULAR})
SELECT poi_id, scene_spot_name, comment_time, order_key, line_no,
       row_number() OVER (PARTITION BY poi_id ORDER BY comment_time, order_key, line_no) AS pos
FROM b""")
def poi_comment_bundle(spark, sf_dir):
    b = popular_comments(Tables(spark, sf_dir))
    return R.bundle_per_group(b, "poi_id", ["comment_time", "order_key", "line_no"],
                              ["scene_spot_name"]).select(
        "poi_id", "scene_spot_name", "comment_time", "order_key", "line_no", "pos")


@register("melt_long", ids="P9", sql="""
SELECT s_suppkey, 's_nationkey' AS variable, CAST(s_nationkey AS DOUBLE) AS value FROM supplier
UNION ALL
SELECT s_suppkey, 's_acctbal' AS variable, s_acctbal AS value FROM supplier""")
def melt_long(spark, sf_dir):
    s = Tables(spark, sf_dir)["supplier"]
    s = s.select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal")
    return R.melt(s, ["s_suppkey"], ["s_nationkey", "s_acctbal"])


@register("dropna_all", ids="P9", sql="""
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE NOT (l.quality IS NULL AND l.toxic IS NULL)""")
def dropna_all(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t["documents"].select("doc_id").join(t["labels"], "doc_id", "left")
    return R.dropna_all(j, subset=["quality", "toxic"])


@register("distinct_keys", ids="S5 A12", sql="SELECT DISTINCT o_custkey AS custom_id FROM orders")
def distinct_keys(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"].select(F.col("o_custkey").alias("custom_id"))
    return R.distinct_keys(o, "custom_id")


@register("group_sizes", ids="A11", sql="""
SELECT o_custkey AS custom_id, count(*) AS n FROM orders GROUP BY 1""")
def group_sizes(spark, sf_dir):
    o = Tables(spark, sf_dir)["orders"].select(F.col("o_custkey").alias("custom_id"))
    return R.counts_by(o, "custom_id")


@register("strict_star", ids="P2", sql="""
SELECT l_orderkey AS order_key, l_linenumber AS line_no,
       CAST(CAST(l_linenumber AS VARCHAR) AS INTEGER) AS comment_star FROM lineitem""")
def strict_star(spark, sf_dir):
    li = Tables(spark, sf_dir)["lineitem"]
    return li.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
                     R.strict_int(F.col("l_linenumber").cast("string")).alias("comment_star"))


@register("null_blank_filter", ids="P4", sql="""
SELECT doc_id FROM documents WHERE text IS NOT NULL AND trim(text) <> ''""")
def null_blank_filter(spark, sf_dir):
    from roamlens.functions.columns import not_blank
    return Tables(spark, sf_dir)["documents"].filter(not_blank("text")).select("doc_id")


@register("null_column", ids="P10 P5", sql="""
SELECT c_custkey AS custom_id, c_mktsegment AS custom_sex, CAST(NULL AS VARCHAR) AS province FROM customer""")
def null_column(spark, sf_dir):
    c = Tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("custom_id"),
                                                 F.col("c_mktsegment").alias("custom_sex"))
    return R.with_null_column(c, "province")


@register("frontier_anti", ids="X15 J4 U5", sql="""
SELECT DISTINCT d.doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def frontier_anti(spark, sf_dir):
    """Items seen in the crawl (documents) that have no stored profile (labels)."""
    t = Tables(spark, sf_dir)
    return R.anti_frontier(t["documents"], t["labels"], "doc_id")


@register("update_from", ids="J9", sql="""
WITH u AS (SELECT c.c_custkey, 'REGION_' || CAST(n.n_regionkey AS VARCHAR) AS seg
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1)
SELECT c.c_custkey AS custom_id, c.c_name AS custom_name, COALESCE(u.seg, c.c_mktsegment) AS custom_province
FROM customer c LEFT JOIN u ON u.c_custkey = c.c_custkey""")
def update_from(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c, n = t["customer"], t["nation"]
    target = c.select(F.col("c_custkey").alias("custom_id"), F.col("c_name").alias("custom_name"),
                      F.col("c_mktsegment").alias("custom_province"))
    upd = (c.join(n, c.c_nationkey == n.n_nationkey).filter(F.col("n_regionkey") == 1)
           .select(F.col("c_custkey").alias("custom_id"),
                   F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")).alias("custom_province")))
    return R.update_from(target, upd, "custom_id", "custom_province")


@register("poi_names", ids="S3 P4", sql="""
SELECT p_name AS scene_spot_name FROM part WHERE p_name IS NOT NULL AND trim(p_name) <> ''""")
def poi_names(spark, sf_dir):
    """S3: the POI-name projection that feeds the name dictionary."""
    from roamlens.functions.columns import not_blank
    return Tables(spark, sf_dir).poi.select("scene_spot_name").filter(not_blank("scene_spot_name"))


@register("user_towns", ids="S3", sql="""
SELECT c.c_custkey AS custom_id, n.n_name AS custom_cty
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def user_towns(spark, sf_dir):
    """S3: user id + home town projection (input of the region resolution)."""
    return Tables(spark, sf_dir).users.select("custom_id", "custom_cty")
