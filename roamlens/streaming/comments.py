"""Comment-event streams: file source -> typed rows -> upsert / append /
dedup / windowed stats sinks.  Every sink has a checkpoint in the shared
checkpoint folder, so a restarted query resumes where it stopped; the upsert
sink versions its table by batch id, so a replayed batch is a no-op."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roamlens.operators.upsert import latest_by_key, upsert_to_path
from roamlens.session import scratch_path


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for one streaming run."""
    return scratch_path(spark, name)


# ------------------------------------------------------------------ sources
def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Rows arriving as files (parquet or JSON lines), declared schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def emit_json(df: DataFrame, path: str) -> None:
    """One JSON document per record (the event datagram as a file line)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def parse_json_events(raw: DataFrame, schema, col: str = "value") -> DataFrame:
    """R1 for a text/JSON-lines stream: typed columns from the JSON value."""
    return raw.select(F.from_json(col, schema).alias("__e")).select("__e.*")


# ------------------------------------------------------------------ sinks
def upsert_sink(stream: DataFrame, table_path: str, keys, order_cols, checkpoint: str):
    """R2: continuous last-writer-wins upsert.  Each micro-batch is reduced to
    its latest row per key and written as the delta ``batch_id + 1``; a replayed
    batch finds its delta present, and the bytes written follow the batch alone."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols = list(order_cols)
    seq = "__seq"

    def merge(batch: DataFrame, batch_id: int):
        b = batch.withColumn(seq, F.struct(*[F.col(c) for c in order_cols]))
        upsert_to_path(batch.sparkSession, latest_by_key(b, keys, [seq]), table_path, keys, seq,
                       version=batch_id + 1)

    return (stream.writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint))


def update_sink(stream: DataFrame, table_path: str, keys, checkpoint: str):
    """An aggregated stream in update mode: each batch's changed groups as a delta
    keyed by the group, so windows that are still open are in the table too."""
    def put(batch: DataFrame, batch_id: int):
        upsert_to_path(batch.sparkSession, batch.withColumn("__batch", F.lit(batch_id)), table_path, keys, "__batch",
                       version=batch_id + 1)

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)


def append_sink(stream: DataFrame, path: str, checkpoint: str, partition_by=None):
    """Append-only sink (exactly-once via the file sink log)."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    return w


def run_available_now(writer) -> None:
    """Process everything available, then stop (tests, backfills)."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


# ------------------------------------------------------------------ operators (R4, windows)
def _event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP (session time zone); NTZ columns are cast."""
    if dict(stream.dtypes)[ts] == "timestamp_ntz":
        return stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream

def dedup_events(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeated events (same key) arriving within the watermark delay."""
    return _event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_stats(stream: DataFrame, ts: str, value: str, delay: str = "1 hour",
                window: str = "1 day") -> DataFrame:
    """Extension of A3/A5 to streams: per-window count and mean (``update_sink``
    gives every window, ``append_sink`` those the watermark has closed)."""
    w = _event_time(stream, ts).withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
        "n", F.round("mean_value", 6).alias("mean_value"))
