"""Keyed upsert, last writer wins.

The latest row per key is a ``max_by`` aggregate over an explicit sequence,
so partial aggregation runs before the shuffle: a key holding a third of the
rows costs one pre-aggregated row per task, not one task for the key."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Batches that a reader merges before they are compacted into a base.
MAX_DELTAS = 16
#: Marks a row that says its key was deleted.
DELETED = "__deleted"


def latest_by_key(df: DataFrame, keys, order_cols) -> DataFrame:
    """The whole row with the greatest ``order_cols`` per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order_cols)).alias("__r"))
    return best.select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def upsert(existing: DataFrame, updates: DataFrame, keys, seq: str = "ingest_seq") -> DataFrame:
    """Union the current table with new records and keep the last
    writer per key (whole-row replace)."""
    return latest_by_key(existing.unionByName(updates, allowMissingColumns=True), keys, [seq])


def upsert_to_path(spark, updates: DataFrame, path: str, keys, seq: str = "ingest_seq",
                   version: int | None = None, max_deltas: int = MAX_DELTAS) -> str:
    """S16 on storage without a MERGE-capable catalog: the batch's latest row per
    key is written as the delta ``v=<version>``; the table itself is not read or
    rewritten.  A delta counts once its ``_SUCCESS`` marker exists, so a write that
    died half-way is redone on replay and a replayed batch is a no-op, also after it went
    into a base.  Without ``version`` the writer claims the next free number, which no
    other writer can claim.  Beyond ``max_deltas`` deltas the batch compacts them, so a
    read merges a bounded number of batches however many there were.

    A table keeps the keys and the sequence of its first batch; others are an error."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if not _committed(spark, path, "meta"):
        spark.createDataFrame([(keys, seq)], "keys array<string>, seq string").coalesce(1).write.mode(
            "overwrite").parquet(os.path.join(path, "meta=0"))
    meta = spark.read.parquet(os.path.join(path, "meta=0")).first()
    if list(meta["keys"]) != keys or meta["seq"] != seq:
        raise ValueError(f"the table is keyed by {list(meta['keys'])} in the order of {meta['seq']}")
    base = _committed(spark, path, "base")[-1:]
    nxt = version if version is not None else _claim(spark, path, max([-1, *_committed(spark, path, "v"), *base]) + 1)
    target = os.path.join(path, f"v={nxt}")
    if nxt in _committed(spark, path, "v") or base and nxt <= base[0]:
        return target
    latest_by_key(updates, keys, [seq]).write.mode("overwrite").parquet(target)
    if len([v for v in _committed(spark, path, "v") if not base or v > base[0]]) > max_deltas:
        compact(spark, path)
    return target


def delete_from_path(spark, gone: DataFrame, path: str, keys, seq: str = "ingest_seq", version: int | None = None,
                     max_deltas: int = MAX_DELTAS) -> str:
    """A batch of deletions: the key and sequence columns of the rows that go.  A later
    row of the key (by sequence) brings it back, an earlier one that arrives late does not."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    marks = gone.select(*keys, seq, F.lit(True).alias(DELETED))
    return upsert_to_path(spark, marks, path, keys, seq, version, max_deltas)


def _merged(spark, path: str) -> DataFrame:
    """The latest row of every key, deletions included, of the last base and the deltas
    after it (ties of the sequence to the later batch)."""
    meta = spark.read.parquet(os.path.join(path, "meta=0")).first()
    base = _committed(spark, path, "base")[-1:]
    deltas = [v for v in _committed(spark, path, "v") if not base or v > base[0]]
    parts = [("base", b) for b in base] + [("v", v) for v in deltas]
    frames = [spark.read.parquet(os.path.join(path, f"{kind}={n}")).withColumn("__v", F.lit(n)) for kind, n in parts]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return latest_by_key(rows, list(meta["keys"]), [meta["seq"], "__v"]).drop("__v")


def current_version(spark, path: str) -> DataFrame:
    """The table: the last compacted base and the deltas after it, merged on read,
    without the deleted keys."""
    rows = _merged(spark, path)
    return rows.filter(~F.coalesce(DELETED, F.lit(False))).drop(DELETED) if DELETED in rows.columns else rows


def compact(spark, path: str) -> str:
    """Merge all deltas so far into one base; readers go on with the old files until the
    base is committed, and after it, as ``vacuum`` alone removes files."""
    last = max([*_committed(spark, path, "v"), *_committed(spark, path, "base")])
    target = os.path.join(path, f"base={last}")
    if last not in _committed(spark, path, "base"):
        _merged(spark, path).write.mode("overwrite").parquet(target)
    return target


def vacuum(spark, path: str, keep: int = 2) -> list[str]:
    """Remove what no reader of the last ``keep`` bases needs: older bases, and the deltas
    up to the oldest base that is kept.  Returns the names of the folders removed."""
    bases = _committed(spark, path, "base")
    if keep < 1 or len(bases) < keep:
        return []
    oldest = bases[-keep]
    old = [f"base={b}" for b in bases if b < oldest] + [f"v={v}" for v in _committed(spark, path, "v") if v <= oldest]
    for name in old:
        p, fs = _fs(spark, os.path.join(path, name))
        fs.delete(p, True)
    return old


def _claim(spark, path: str, first: int) -> int:
    """The first free number from ``first`` on, claimed by creating a file that only one
    writer can create."""
    n = first
    while True:
        p, fs = _fs(spark, os.path.join(path, "claims", str(n)))
        if fs.createNewFile(p):
            return n
        n += 1


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _committed(spark, path: str, kind: str) -> list[int]:
    """Numbers ``n`` of the folders ``kind=n`` whose write job committed (``_SUCCESS``)."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    jvm = spark.sparkContext._jvm
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=")[1]))
    return sorted(out)
