"""roamlens — travel-review analytics expressed as Spark DataFrame/SQL/MLlib jobs.

Sub-packages:
  sources/    readers and sinks (parquet, text, JSON, keyed-upsert tables)
  operators/  DataFrame -> DataFrame operators (relational, extraction, text, ML)
  functions/  Column -> Column helpers (association measures, similarity, ...)
  plans/      the registered queries (Spark side + DuckDB oracle SQL)
  streaming/  Structured Streaming jobs (comment events, upserts, dedup)
"""

__version__ = "0.1.0"
