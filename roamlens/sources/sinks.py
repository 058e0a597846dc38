"""Sinks.  Writers never collect to the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.functions.columns import not_blank


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, UTF-8 (non-ASCII characters are kept as is)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_comments(df: DataFrame, path: str, key: str = "poi_id", buckets: int = 64) -> None:
    """Append-only search-index sink, partitioned by a POI bucket so a
    hot POI spreads over files of one bucket directory."""
    (df.withColumn("poi_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
       .write.mode("append").partitionBy("poi_bucket").parquet(path))


def write_names(df: DataFrame, col: str, path: str) -> None:
    """One name per line (null and blank names skipped — Q10)."""
    df.filter(not_blank(col)).select(F.col(col).alias("value")).write.mode("overwrite").text(path)


def write_scores(df: DataFrame, key: str, p_pos: str, p_neg: str, path: str) -> None:
    """``"<p_pos> <p_neg>"`` per line, plus a parquet twin keeping the key."""
    line = F.concat_ws(" ", F.col(p_pos).cast("string"), F.col(p_neg).cast("string")).alias("value")
    df.orderBy(key).select(line).write.mode("overwrite").text(os.path.join(path, "text"))
    df.select(key, p_pos, p_neg).write.mode("overwrite").parquet(os.path.join(path, "parquet"))


def write_polygon(lines: DataFrame, path: str) -> None:
    """The ordered polygon export (header, areas, vertices, footer);
    range-sorted so the part files concatenate in order."""
    lines.orderBy("area_ord", "kind", "i").select(F.col("line").alias("value")).write.mode("overwrite").text(path)
