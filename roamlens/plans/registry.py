"""Registry of named queries: each has a Spark builder ``(spark, sf_dir) ->
DataFrame`` and, where SQL can express it, a DuckDB oracle string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None, str]] = {}


def register(name: str, sql: str | None = None, ids: str = ""):
    """Decorator: ``@register('key', sql=ORACLE, ids='J1 J3')``."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query key {name}")
        REGISTRY[name] = (fn, sql, ids)
        return fn
    return deco
