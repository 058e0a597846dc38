"""Streaming queries: the events table replayed as a file stream with an
availableNow trigger; the result table is read back (SURVEY R1–R4).  The
oracle is the static SQL equivalent."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from roamlens.operators.upsert import current_version
from roamlens.plans.registry import register
from roamlens.schemas import TABLES
from roamlens.streaming import comments as ST


def _events_stream(spark, sf_dir):
    s = ST.file_stream(spark, os.path.join(sf_dir, "events.parq*"), TABLES["events"])
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_upsert", ids="R1 R2 S16", sql="""
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type, value FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def stream_upsert(spark, sf_dir):
    run = ST.new_run_dir(spark, "stream_upsert")
    table = os.path.join(run, "table")
    # the table dealt into files that arrive one by one: several micro-batches
    arriving = os.path.join(run, "events")
    static = spark.read.schema(TABLES["events"]).parquet(os.path.join(sf_dir, "events.parquet"))
    static.repartition(4, "event_id").write.parquet(arriving)
    s = ST.file_stream(spark, arriving, TABLES["events"], max_files_per_trigger=1)
    s = s.withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "ts", "event_type", "value")
    ST.run_available_now(ST.upsert_sink(s, table, ["user_id"], ["ts", "event_id"], os.path.join(run, "ckpt")))
    out = current_version(spark, table)
    return out.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                      "event_type", "value")


@register("stream_dedup", ids="R4 R3 S17", sql="""
SELECT event_id, user_id, event_type FROM events""")
def stream_dedup(spark, sf_dir):
    run = ST.new_run_dir(spark, "stream_dedup")
    a = _events_stream(spark, sf_dir)
    b = _events_stream(spark, sf_dir)   # the same events delivered twice
    d = ST.dedup_events(a.unionByName(b), "event_id", "ts", "1 hour").select("event_id", "user_id", "event_type")
    out = os.path.join(run, "out")
    ST.run_available_now(ST.append_sink(d, out, os.path.join(run, "ckpt")))
    return spark.read.parquet(out)


@register("stream_daily_stats", ids="R1 A3 A5", sql="""
WITH b AS (SELECT date_trunc('day', ts) AS ws, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, n, mean_value FROM b""")
def stream_daily_stats(spark, sf_dir):
    run = ST.new_run_dir(spark, "stream_daily")
    d = ST.daily_stats(_events_stream(spark, sf_dir), "ts", "value", "1 hour")
    out = os.path.join(run, "out")
    ST.run_available_now(ST.update_sink(d, out, ["window_start"], os.path.join(run, "ckpt")))
    return current_version(spark, out).select("window_start", "window_end", "n", "mean_value")


COMMENT_EVENT_JSON = ("event_id string, poi_id string, custom_id string, comment_text string, "
                      "comment_time timestamp, comment_star int")


@register("stream_comment_events", ids="S21 R1 R3", sql="""
SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS event_id,
       CAST(l.l_partkey AS VARCHAR) AS poi_id, CAST(o.o_custkey AS VARCHAR) AS custom_id,
       l.l_returnflag || l.l_linestatus AS comment_text,
       strftime(l.l_shipdate, '%Y-%m-%d %H:%M:%S') AS comment_time, l.l_linenumber AS comment_star
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def stream_comment_events(spark, sf_dir):
    """S21 + R1: comment records leave as one JSON document each (files instead
    of datagrams), a JSON file stream types them back, an append sink stores them."""
    from roamlens.plans.standins import Tables
    t = Tables(spark, sf_dir)
    li, o = t["lineitem"], t["orders"]
    ev = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"),
        F.col("l_partkey").cast("string").alias("poi_id"), F.col("o_custkey").cast("string").alias("custom_id"),
        F.concat("l_returnflag", "l_linestatus").alias("comment_text"),
        F.col("l_shipdate").cast("timestamp").alias("comment_time"), F.col("l_linenumber").alias("comment_star"))
    run = ST.new_run_dir(spark, "stream_comment_events")
    ST.emit_json(ev, os.path.join(run, "events"))
    raw = spark.readStream.format("text").load(os.path.join(run, "events"))
    typed = ST.parse_json_events(raw, COMMENT_EVENT_JSON)
    out = os.path.join(run, "out")
    ST.run_available_now(ST.append_sink(typed, out, os.path.join(run, "ckpt")))
    return spark.read.parquet(out).withColumn("comment_time", F.date_format("comment_time", "yyyy-MM-dd HH:mm:ss"))
