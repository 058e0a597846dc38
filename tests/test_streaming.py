"""Streaming twins of the batch operators with availableNow triggers."""

import json
import os

from pyspark.sql import functions as F

from roamlens import schemas as S
from roamlens.operators.upsert import current_version
from roamlens.streaming import comments as ST


def _emit(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        for r in rows:
            f.write(json.dumps(r, ensure_ascii=False) + "\n")


def ev(i, poi, user, text, t, star):
    return {"event_id": i, "poi_id": poi, "custom_id": user, "comment_text": text,
            "comment_time": t, "comment_star": star}


def test_comment_stream_upsert_and_dedup(spark, tmp):
    src = os.path.join(tmp, "in")
    _emit(src, "b1.json", [ev("e1", "p1", "u1", "好", "2018-07-01 10:00:00", 5),
                           ev("e2", "p1", "u2", "差", "2018-07-01 11:00:00", 1),
                           ev("e1", "p1", "u1", "好", "2018-07-01 10:00:00", 5)])      # duplicate event
    _emit(src, "b2.json", [ev("e3", "p1", "u1", "更好", "2018-07-02 09:00:00", 4),      # newer row for u1
                           ev("e4", "p2", "u3", "旧", "2018-06-01 09:00:00", 3)])       # late event
    stream = ST.file_stream(spark, src, S.COMMENT_EVENT, fmt="json", max_files_per_trigger=1)
    table = os.path.join(tmp, "users")
    ST.run_available_now(ST.upsert_sink(stream, table, ["custom_id"], ["comment_time", "event_id"],
                                        os.path.join(tmp, "ck1")))
    got = {r.custom_id: r.comment_text for r in current_version(spark, table).collect()}
    assert got == {"u1": "更好", "u2": "差", "u3": "旧"}
    d = ST.dedup_events(ST.file_stream(spark, src, S.COMMENT_EVENT, fmt="json"), "event_id", "comment_time", "1 day")
    out = os.path.join(tmp, "dedup")
    ST.run_available_now(ST.append_sink(d, out, os.path.join(tmp, "ck2")))
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["e1", "e2", "e3", "e4"]


def test_upsert_writes_follow_the_batch(spark, tmp):
    from roamlens.operators.upsert import compact, upsert_to_path
    size = lambda d: sum(os.path.getsize(os.path.join(d, f)) for f in os.listdir(d) if f.endswith(".parquet"))
    big = spark.range(20000).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("ingest_seq"))
    one = spark.createDataFrame([("7", "b", 2)], "k string, v string, ingest_seq int")
    first = upsert_to_path(spark, big, tmp, ["k"], version=1)
    second = upsert_to_path(spark, one, tmp, ["k"], version=2)
    assert size(second) < size(first) / 20
    upsert_to_path(spark, one.withColumn("v", F.lit("replayed")), tmp, ["k"], version=2)
    for _ in range(2):
        t = current_version(spark, tmp)
        assert t.count() == 20000 and t.filter("k = '7'").first().v == "b"
        compact(spark, tmp)
    upsert_to_path(spark, one.withColumn("ingest_seq", F.lit(2)).withColumn("v", F.lit("c")), tmp, ["k"], version=3)
    assert current_version(spark, tmp).filter("k = '7'").first().v == "c"


def test_restart_resumes(spark, tmp):
    src = os.path.join(tmp, "in")
    _emit(src, "b1.json", [ev("e1", "p1", "u1", "a", "2018-07-01 10:00:00", 5)])
    out, ck = os.path.join(tmp, "out"), os.path.join(tmp, "ck")
    ST.run_available_now(ST.append_sink(ST.file_stream(spark, src, S.COMMENT_EVENT, fmt="json"), out, ck))
    _emit(src, "b2.json", [ev("e2", "p1", "u2", "b", "2018-07-01 11:00:00", 4)])
    ST.run_available_now(ST.append_sink(ST.file_stream(spark, src, S.COMMENT_EVENT, fmt="json"), out, ck))
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["e1", "e2"]


def test_emit_and_parse_json(spark, tmp):
    df = spark.createDataFrame([("e1", "p1", "u1", "好", None, 5)], S.COMMENT_EVENT)
    ST.emit_json(df, os.path.join(tmp, "ev"))
    raw = spark.read.text(os.path.join(tmp, "ev"))
    back = ST.parse_json_events(raw, S.COMMENT_EVENT).first()
    assert (back.event_id, back.comment_text, back.comment_star) == ("e1", "好", 5)
