"""The end of a session against a later snapshot: actions that are done, findings in order, and a stored state that is verified again when the snapshot moves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators import state

SAMPLE, STALE_SHARE, BUCKETS = 3, 0.25, 64


def with_resolved(items: DataFrame, done: DataFrame) -> DataFrame:
    """The items, with those that ``done`` (see ``state.satisfied``) says are satisfied resolved by the event that did it."""
    hit = done.select("session_key", "id", F.col("evt").alias("_evt"))
    both = items.join(hit, ["session_key", "id"], "left")
    over = F.col("_evt").isNotNull()
    return both.withColumns({"status": F.when(over, "resolved").otherwise(F.col("status")), "detail": F.when(over, F.col("_evt").cast("string")).otherwise(F.col("detail"))}).select(items.columns)


def sample(values: Column, most: int = SAMPLE) -> Column:
    """The first of an array's texts, shortened, and how many more there are."""
    shown = F.array_join(F.transform(F.slice(values, 1, most), lambda v: X.truncate_middle(v, 60)), ", ")
    return F.when(F.size(values) > most, F.concat(shown, F.lit(", and "), (F.size(values) - most).cast("string"), F.lit(" more"))).otherwise(shown)


def findings(sessions: DataFrame, reconciled: DataFrame, gone: DataFrame, verified: DataFrame, errors: DataFrame) -> DataFrame:
    """session_key, rank, kind, text: what speaks against a session's record, in a fixed order, at most one of each kind.

    ``sessions``: session_key, later (subjects of commits after its end, newest first), uncommitted (changes in the working tree); ``reconciled``: see ``state.reconcile``; ``gone``: see
    ``state.missing_commits``; ``verified``: see ``state.verified``; ``errors``: session_key, status, occurrences, sig, example.  Of files that are missing only those count that look
    like work: logs, packages and temporary files are read, not made.
    """
    paths = lambda which, ok: F.array_sort(F.collect_list(F.when((F.col("finding") == which) & ok, F.col("path")))).alias(which)
    files = reconciled.groupBy("session_key").agg(paths("contradicted", F.lit(True)), paths("missing", state.looks_like_work(F.col("path"))))
    lost = gone.groupBy("session_key").agg(F.array_sort(F.collect_set("sha")).alias("lost"))
    checked = verified.groupBy("session_key").agg(F.count_if(F.col("verified") == "stale").alias("stale"), F.count_if(F.col("verified") != "unchecked").alias("checked"), F.count_if(F.col("kind") == "next_action").alias("actions"))
    worst = errors.where("status = 'unresolved'").groupBy("session_key").agg(F.min_by("example", F.struct(-F.col("occurrences"), F.col("sig"))).alias("worst"))
    all_ = sessions
    for part in (files, lost, checked, worst):
        all_ = all_.join(part, "session_key", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    text = lambda c: c.cast("string")
    share = F.col("stale") / F.greatest("checked", F.lit(1))
    kinds = [
        ("moved on", n("later") > 0, F.concat(text(n("later")), F.lit(" commit(s) came after this session, the newest: "), X.truncate_middle(F.get("later", F.lit(0)), 80))),
        ("contradicted", n("contradicted") > 0, F.concat(text(n("contradicted")), F.lit(" file(s) said to be deleted are there: "), sample(F.col("contradicted")))),
        ("missing", n("missing") > 0, F.concat(text(n("missing")), F.lit(" file(s) that were worked on are gone: "), sample(F.col("missing")))),
        ("unreachable", n("lost") > 0, F.concat(text(n("lost")), F.lit(" recorded commit(s) can't be reached any more: "), sample(F.col("lost")))),
        ("uncommitted", F.coalesce("uncommitted", F.lit(0)) > 0, F.concat(text(F.col("uncommitted")), F.lit(" change(s) lie uncommitted in the working tree"))),
        ("stale", F.coalesce("stale", F.lit(0)) > 0, F.concat(F.when(share >= STALE_SHARE, "Most").otherwise("Some"), F.lit(" of what was checked no longer holds: "), text(F.col("stale")), F.lit(" of "), text(F.col("checked")))),
        ("unresolved", F.col("worst").isNotNull() & (F.coalesce("actions", F.lit(0)) > 0), F.concat(F.lit("the session ended with an open failure: "), X.truncate_middle(F.col("worst"), 120))),
    ]
    each = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(k).alias("rank"), F.lit(name).alias("kind"), said.alias("text"))) for k, (name, when, said) in enumerate(kinds)]))
    return all_.select("session_key", F.inline(each))


# ---- a stored state, verified again


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digests(*parts: DataFrame) -> DataFrame:
    """session_key, digest: of each session's rows in all of the tables, whatever their order."""
    out = None
    for k, df in enumerate(parts):
        own = df.select("session_key", F.xxhash64(F.lit(k), *[F.col(c) for c in df.columns]).alias("h"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("session_key").agg(F.struct(F.bit_xor("h").alias("x"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y")).cast("string").alias("digest"))


def store(verified: DataFrame, seen: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the items (session_key and others) with the digest of what they were verified against (see ``digests``), in partitions of sessions."""
    rows = verified.join(seen, "session_key", "left").withColumn("bucket", _bucket(F.col("session_key"), buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def verify(spark: SparkSession, path: str, files: DataFrame, snapshot: DataFrame, changed: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """Verify a stored state against a newer snapshot: the whole state afterwards, and how many sessions were done again.

    Only sessions whose digest differs are reconciled, and only partitions that hold one are written; the others keep their files.  The new rows are written next to the
    store first, then put in place partition by partition, so a run that is killed leaves old or new partitions, and a second run mends the rest.
    """
    stored = spark.read.parquet(path)
    now = digests(files.select("session_key", "path", "deleted", "edits"), snapshot.select("session_key", "path"), changed.select("session_key", "path"))
    before = stored.groupBy("session_key").agg(F.first("digest").alias("_before"))
    moved = before.join(now, "session_key", "left").where(~F.col("_before").eqNullSafe(F.col("digest"))).select("session_key", "digest")
    fresh = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    moved.write.parquet(f"{fresh}/moved")
    moved = spark.read.parquet(f"{fresh}/moved")
    n = moved.count()
    if n:
        touched = [r[0] for r in moved.select(_bucket(F.col("session_key"), buckets)).distinct().collect()]  # ``buckets`` at most
        held = stored.where(F.col("bucket").isin(touched))
        items = held.join(moved.select("session_key"), "session_key", "left_semi").drop("digest", "verified")
        of_moved = lambda df: df.join(moved.select("session_key"), "session_key", "left_semi")
        against = state.reconcile(of_moved(files), of_moved(snapshot), of_moved(changed))
        again = state.verified(items, against).unionByName(items.where("status <> 'active'").withColumn("verified", F.lit("unchecked"))).join(moved, "session_key")
        kept = held.join(moved.select("session_key"), "session_key", "left_anti")
        kept.select(stored.columns).unionByName(again.select(stored.columns)).write.parquet(f"{fresh}/state")
        rows = spark.read.parquet(f"{fresh}/state").repartition("bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return spark.read.parquet(path), n
