"""Keyed tables over many batches: bounded reads, deletions, old files, writers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from roamlens.operators import upsert as U

SCHEMA = "k int, v string, ingest_seq int"


def folders(path, kind):
    return sorted(int(f.split("=")[1]) for f in os.listdir(path) if f.startswith(f"{kind}="))


def test_reads_stay_bounded_over_many_batches(spark, tmp):
    rng, want = random.Random(1), {}
    for i in range(60):
        rows = [(rng.randint(0, 30), f"{i}-{j}", i) for j in range(3)]
        if i % 7 == 3:
            gone = spark.createDataFrame([(rows[0][0], i)], "k int, ingest_seq int")
            U.delete_from_path(spark, gone, tmp, "k", version=i, max_deltas=8)
            want.pop(rows[0][0], None)
        else:
            U.upsert_to_path(spark, spark.createDataFrame(rows[:1], SCHEMA), tmp, "k", version=i, max_deltas=8)
            want[rows[0][0]] = rows[0][1]
        if i % 20 == 19:
            U.vacuum(spark, tmp)
    t = U.current_version(spark, tmp)
    assert {r.k: r.v for r in t.collect()} == want
    assert t.columns == ["k", "v", "ingest_seq"]
    last = folders(tmp, "base")[-1]
    assert len([v for v in folders(tmp, "v") if v > last]) <= 8
    assert len({os.path.dirname(f) for f in t.inputFiles()}) <= 9


def test_deletions_follow_the_sequence(spark, tmp):
    row = lambda k, v, s: spark.createDataFrame([(k, v, s)], SCHEMA)
    U.upsert_to_path(spark, row(1, "a", 1).union(row(2, "b", 1)), tmp, "k")
    U.delete_from_path(spark, row(1, None, 5), tmp, "k")
    U.upsert_to_path(spark, row(1, "late", 3), tmp, "k")
    assert {r.k for r in U.current_version(spark, tmp).collect()} == {2}
    U.compact(spark, tmp)
    U.upsert_to_path(spark, row(1, "later still", 4), tmp, "k")  # the base remembers the deletion
    assert {r.k for r in U.current_version(spark, tmp).collect()} == {2}
    U.upsert_to_path(spark, row(1, "back", 6), tmp, "k")
    assert {(r.k, r.v) for r in U.current_version(spark, tmp).collect()} == {(1, "back"), (2, "b")}


def test_readers_are_undisturbed(spark, tmp):
    for i in range(4):
        U.upsert_to_path(spark, spark.createDataFrame([(i, "x", i)], SCHEMA), tmp, "k", version=i)
    before = U.current_version(spark, tmp)
    U.compact(spark, tmp)
    assert U.vacuum(spark, tmp) == []  # the only base; a reader may still merge the deltas
    assert before.count() == 4
    U.upsert_to_path(spark, spark.createDataFrame([(9, "x", 9)], SCHEMA), tmp, "k", version=4)
    U.compact(spark, tmp)
    assert set(U.vacuum(spark, tmp)) == {"v=0", "v=1", "v=2", "v=3"}
    assert set(U.vacuum(spark, tmp, keep=1)) == {"base=3", "v=4"}
    U.upsert_to_path(spark, spark.createDataFrame([(0, "replayed", 99)], SCHEMA), tmp, "k", version=2)  # went into the base
    assert {r.k: r.v for r in U.current_version(spark, tmp).collect()} == {k: "x" for k in (0, 1, 2, 3, 9)}


def test_writers_claim_their_numbers(spark, tmp):
    assert [U._claim(spark, tmp, 0) for _ in range(3)] == [0, 1, 2]
    target = U.upsert_to_path(spark, spark.createDataFrame([(1, "a", 1)], SCHEMA), tmp, "k")
    assert target.endswith("v=3")


def test_other_keys_are_an_error(spark, tmp):
    df = spark.createDataFrame([(1, "a", 1)], SCHEMA)
    U.upsert_to_path(spark, df, tmp, "k")
    for keys, seq in ((["k", "v"], "ingest_seq"), ("k", "v")):
        with pytest.raises(ValueError):
            U.upsert_to_path(spark, df, tmp, keys, seq)
    assert U.current_version(spark, tmp).select(F.count(F.lit(1))).first()[0] == 1
