"""Stand-in mapping of the driver tables onto the travel-review data model
(SURVEY §2.14): part = POI, lineitem = comment (star = l_linenumber,
time = l_shipdate), orders + customer = user (sex = c_mktsegment,
home town = nation, province = region), documents + labels = labelled
reviews, pages = raw HTML, events = event stream."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamlens.functions.columns import ts_text
from roamlens.sources.tables import load_table

POPULAR_MIN = 30   # mean is 30 comments per part at sf0.01

# Pivot columns of the stand-in dimensions (TPC-H region names
# and market segments), passed explicitly so the pivot schema is stable.
PROVINCES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEXES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


class Tables:
    """Lazy per-query access to driver tables and the stand-in views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = load_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    # ---- stand-ins
    @cached_property
    def poi(self) -> DataFrame:
        return self["part"].select(F.col("p_partkey").alias("poi_id"),
                                   F.col("p_name").alias("scene_spot_name"))

    @cached_property
    def comments(self) -> DataFrame:
        li = self["lineitem"]
        return li.select(F.col("l_partkey").alias("poi_id"),
                         F.col("l_orderkey").alias("order_key"),
                         F.col("l_linenumber").alias("line_no"),
                         ts_text("l_shipdate").alias("comment_time"),
                         F.col("l_linenumber").alias("comment_star"))

    @cached_property
    def user_comments(self) -> DataFrame:
        o = self["orders"].select(F.col("o_orderkey").alias("order_key"),
                                  F.col("o_custkey").alias("custom_id"))
        return self.comments.join(o, "order_key")

    @cached_property
    def users(self) -> DataFrame:
        c, n, r = self["customer"], self["nation"], self["region"]
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                 .join(r, n.n_regionkey == r.r_regionkey)
                 .select(F.col("c_custkey").alias("custom_id"),
                         F.col("n_name").alias("custom_cty"),
                         F.col("c_mktsegment").alias("custom_sex"),
                         F.col("r_name").alias("custom_province")))


# ---- oracle fragments (DuckDB) mirroring the stand-ins
SQL_COMMENT_COLS = """l.l_partkey AS poi_id, l.l_orderkey AS order_key, l.l_linenumber AS line_no,
       strftime(l.l_shipdate, '%Y-%m-%d %H:%M:%S') AS comment_time, l.l_linenumber AS comment_star"""

# places with more comments than the threshold
SQL_POPULAR_IN = f"""EXISTS (SELECT 1 FROM lineitem same WHERE same.l_partkey = l.l_partkey
       GROUP BY same.l_partkey HAVING count(*) > {POPULAR_MIN})"""

SQL_POPULAR = f"""SELECT p.p_name AS scene_spot_name, {SQL_COMMENT_COLS}
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey
WHERE {SQL_POPULAR_IN}"""

SQL_POPULAR_USERS = f"""SELECT p.p_name AS scene_spot_name, {SQL_COMMENT_COLS},
       o.o_custkey AS custom_id, n.n_name AS custom_cty, c.c_mktsegment AS custom_sex,
       r.r_name AS custom_province
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE {SQL_POPULAR_IN}"""
