"""A stored state that is verified again: only what changed is done and written anew."""

import os

from pyspark.sql import functions as F

from sessionloom.operators import finish, state


def listing(path):
    return {d: sorted((f, os.path.getmtime(f"{path}/{d}/{f}")) for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


def test_unchanged_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "state")
    items = spark.createDataFrame([(f"s{k}", "D1", "decision", "keep src/a.py", "active") for k in range(20)] + [("s0", "D2", "decision", "old src/b.py", "dropped")], "session_key string, id string, kind string, text string, status string")
    files = spark.createDataFrame([(f"s{k}", "src/a.py", False, 1, False) for k in range(20)], "session_key string, path string, deleted boolean, edits int, inferred boolean")
    first = files.where("session_key <> 's3'").select("session_key", "path")
    none = first.limit(0)
    both = lambda there: state.verified(items, state.reconcile(files, there, none)).unionByName(items.where("status <> 'active'").withColumn("verified", F.lit("unchecked")))
    finish.store(both(first), finish.digests(files.select("session_key", "path", "deleted", "edits"), first, none), path, 8)
    before = listing(path)
    rows = lambda df: sorted((r["session_key"], r["id"], r["verified"]) for r in df.collect())
    after, n = finish.verify(spark, path, files, first, none, 8)
    assert n == 0 and listing(path) == before and rows(after) == rows(both(first))
    moved = first.where("session_key <> 's0'").unionByName(files.where("session_key = 's3'").select("session_key", "path"))
    after, n = finish.verify(spark, path, files, moved, none, 8)
    touched = {f"bucket={r[0]}" for r in spark.createDataFrame([("s0",), ("s3",)], "s string").select(finish._bucket(F.col("s"), 8)).collect()}
    now = listing(path)
    assert n == 2 and {d for d in now if now[d] != before[d]} == touched and rows(after) == rows(both(moved))
    assert ("s0", "D1", "stale") in rows(after) and ("s3", "D1", "verified") in rows(after) and ("s0", "D2", "unchecked") in rows(after)


def test_samples(spark):
    got = spark.createDataFrame([(["a"],), (["a", "b", "c"],), (["a", "b", "c", "d", "e"],), ([],)], "v array<string>").select(finish.sample(F.col("v"))).collect()
    assert [r[0] for r in got] == ["a", "a, b, c", "a, b, c, and 2 more", ""]
