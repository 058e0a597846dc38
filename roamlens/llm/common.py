"""Shared helpers: table loading, the shared folder, and vectorised word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from roamlens.session import ship_package

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a lookup by byte.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def prepare(spark: SparkSession) -> None:
    """What every operator needs of the session: the package on the executors, and
    Arrow batches of few rows, as rows hold whole texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone (any store that Spark can read)."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only a local
    session may go without; there a temporary folder is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not yet created) under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and
    a lost executor costs no more than re-reading its files."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of a multiplier modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            t = np.full(max(n, 2 * len(self.table)), self.base, np.uint64)
            t[0] = 1
            self.table = np.cumprod(t, dtype=np.uint64)
        return self.table[:n]


_POW, _POW_INV = _Powers(_P), _Powers(_P_INV)


def sequence_hash(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run of ``values`` (what lies between two runs
    counts to the first, and must be 0)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(values)
    h = np.add.reduceat(values * _POW.upto(n), start) * _POW_INV.upto(n)[start]
    return mix64(h + length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


class Words:
    """The words of several texts, laid out flat: ``start``/``end`` are byte
    positions in ``data``, ``doc`` the index of the text, ``hash`` 64 bits.
    ``space`` (a lookup by byte, true for a line feed) can name other separators."""

    def __init__(self, texts: list[bytes], lower: bool = False, space: np.ndarray = _SPACE):
        self.texts = texts
        buf = b"\n".join(texts) + b"\n"
        data = np.frombuffer(buf, np.uint8)
        if lower:
            data = _LOWER[data]
        self.data = data
        solid = ~space[data]
        edge = np.diff(solid.astype(np.int8), prepend=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)  # the buffer ends with white space
        lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc_start = np.concatenate(([0], np.cumsum(lens)))
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        v = (data.astype(np.uint64) + np.uint64(1)) * solid
        self.hash = sequence_hash(v, self.start, self.end - self.start)

    def __len__(self) -> int:
        return len(self.start)


def text_chunks(texts: list[bytes], most: int = 600_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``most`` bytes (a longer text comes alone)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def utf8(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class Kept:
    """A dictionary of two generations: what was not asked for in a whole generation goes."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def missing(self, keys) -> list[str]:
        """Those of ``keys`` that are not kept; afterwards the others are in ``now``."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now
        keys = keys.difference(self.now)
        found = keys.intersection(self.old) if self.old else ()
        self.now.update((k, self.old[k]) for k in found)
        return list(keys.difference(found))
