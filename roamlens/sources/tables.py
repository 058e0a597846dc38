"""Driver tables: one parquet file per table, read with a declared schema."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from roamlens.schemas import TABLES

def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan with the declared schema; column pruning and filter
    pushdown reach the scan because everything downstream is declarative."""
    return spark.read.schema(TABLES[name]).parquet(table_path(sf_dir, name))


def load_tables(spark: SparkSession, sf_dir: str, names=None, views: bool = False) -> dict[str, DataFrame]:
    out = {}
    for n in names or TABLES:
        out[n] = load_table(spark, sf_dir, n)
        if views:
            out[n].createOrReplaceTempView(n)
    return out
