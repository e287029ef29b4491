"""Event-sourced session state: operations are checked, applied in order and kept; nothing is ever deleted.

State depends on every operation before it, so a session's batches are folded in order (see ``fold``); sessions are independent.
An operation is a JSON object: op (add, update, supersede, resolve, drop, merge, confirm) and its fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators import fold
from sessionloom.operators.fold import LIMIT, PREFIX


def items(batches: DataFrame) -> DataFrame:
    """The items of each session from its batches (session_key, chunk, evt_start, evt_end, visible, human, paths, ops: a JSON text)."""
    return fold.items_of(fold.replayed(batches))


def rejections(batches: DataFrame) -> DataFrame:
    """session_key, chunk, op_index, op, reason of the operations that were refused."""
    return fold.rejections_of(fold.replayed(batches))


def active_items(found: DataFrame) -> DataFrame:
    """Active items by importance, then by id as text."""
    rank = F.array_position(F.array(*map(F.lit, PREFIX)), F.col("kind"))
    return found.where("status = 'active'").orderBy("session_key", rank, "id")


def active_limit(found: DataFrame) -> DataFrame:
    """Items (session_key, kind, seq) with ``kept``: the newest of each limited kind."""
    limit = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in LIMIT.items()], F.lit((1 << 31) - 1))
    w = Window.partitionBy("session_key", "kind").orderBy(F.desc("seq"))
    return found.withColumn("kept", F.row_number().over(w) <= limit)


def reconcile(found: DataFrame, repo_files: DataFrame, changed: DataFrame) -> DataFrame:
    """session_key, path, finding of a file ledger against a snapshot (session_key, path) and the paths changed since the session's end.

    contradicted: said to be deleted but there; missing: not there; changed: edited and changed since; known: there.
    """
    own = found.where("NOT inferred").select("session_key", "path", "deleted", "edits")
    there = repo_files.select("session_key", "path").distinct().withColumn("there", F.lit(True))
    later = changed.select("session_key", "path").distinct().withColumn("later", F.lit(True))
    both = own.join(there, ["session_key", "path"], "left").join(later, ["session_key", "path"], "left")
    exists = F.coalesce("there", F.lit(False))
    finding = F.when(F.col("deleted") & exists, "contradicted").when(~F.col("deleted") & ~exists, "missing").when((F.col("edits") > 0) & F.coalesce("later", F.lit(False)), "changed").otherwise("known")
    return both.select("session_key", "path", finding.alias("finding"))


def missing_commits(commits: DataFrame, repo_commits: DataFrame) -> DataFrame:
    """The session's commits (session_key, sha: 7 digits and more) that the repository (session_key, sha) doesn't have."""
    short = lambda df: df.withColumn("_s", F.left("sha", F.lit(7)))
    known = short(commits).alias("c").join(short(repo_commits).select("session_key", "_s", F.col("sha").alias("full")), ["session_key", "_s"]).where(F.startswith("full", F.col("sha")))
    return commits.join(known.select("session_key", "sha"), ["session_key", "sha"], "left_anti")


def verified(found: DataFrame, findings: DataFrame) -> DataFrame:
    """Active items with ``verified``: contradicted, stale, verified or unchecked, by the paths that they mention."""
    words = F.filter(F.transform(F.split(F.trim("text"), r"\s+"), lambda w: F.regexp_replace(w, F.lit("^[`'\",;:()\\[\\]]+|[`'\",;:()\\[\\]]+$"), F.lit(""))), lambda w: F.contains(w, F.lit("/")) & F.contains(w, F.lit(".")) & ~F.contains(w, F.lit("://")))
    each = found.where("status = 'active'").select("session_key", "id", F.explode(words).alias("word"))
    hit = each.join(findings, "session_key").where(F.contains("path", F.col("word"))).groupBy("session_key", "id").agg(F.collect_set("finding").alias("f"))
    mark = F.when(F.array_contains("f", "contradicted"), "contradicted").when(F.arrays_overlap("f", F.array(F.lit("missing"), F.lit("changed"))), "stale").when(F.array_contains("f", "known"), "verified").otherwise("unchecked")
    return found.where("status = 'active'").join(hit, ["session_key", "id"], "left").withColumn("verified", mark).drop("f")


def satisfied(found: DataFrame, runs: DataFrame, least: int = 5) -> DataFrame:
    """session_key, id, evt, command: next actions whose text names a command that succeeded after them; the first such run."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, F.lit(r"\s+"), F.lit(" "))))
    after = F.coalesce(F.array_max(F.transform("sources", lambda r: r["end"])), F.col("last_confirmed"))
    actions = found.where("kind = 'next_action' AND status = 'active'").select("session_key", "id", flat(F.col("text")).alias("t"), after.alias("after"))
    good = runs.where("NOT failed").select("session_key", "evt", "normalized", flat(F.col("normalized")).alias("c")).where(F.length("c") >= least)
    both = actions.join(good, "session_key").where((F.col("evt") > F.col("after")) & F.contains("t", F.col("c")))
    return both.groupBy("session_key", "id").agg(F.min("evt").alias("evt"), F.min_by("normalized", "evt").alias("command"))


def derived_step(found: DataFrame, plans: DataFrame, runs: DataFrame) -> DataFrame:
    """session_key, text, evt for sessions without an active current step: the plan's step in progress, else the last command (one that can be run, if any)."""
    sessions = runs.select("session_key").unionByName(plans.select("session_key")).distinct()
    open_ = sessions.join(found.where("kind = 'current_step' AND status = 'active'"), "session_key", "left_anti")
    step = F.get(F.filter("items", lambda i: i["status"].isin("in_progress", "active")), F.lit(0))["text"]
    own = plans.select("session_key", F.concat(F.lit("from the plan: "), step).alias("p"), F.col("evt").alias("p_evt")).where("p IS NOT NULL")
    fine = ~F.contains("normalized", F.lit("\n")) & ~F.contains("normalized", F.lit("<<")) & (F.length("normalized") <= 200)
    last = runs.groupBy("session_key").agg(F.coalesce(F.max_by(F.struct("normalized", "evt", "status"), F.when(fine, F.col("evt"))), F.max_by(F.struct("normalized", "evt", "status"), "evt")).alias("l"))
    said = F.concat(F.lit("last command: "), X.truncate_middle(F.regexp_extract("l.normalized", "^[^\n]*", 0), 80), F.lit(" — "), F.col("l.status"))
    both = open_.join(own, "session_key", "left").join(last, "session_key", "left")
    return both.select("session_key", F.coalesce("p", said).alias("text"), F.coalesce("p_evt", "l.evt").alias("evt")).where("text IS NOT NULL")


def looks_like_work(path: F.Column) -> F.Column:
    # Parts of paths that are read while working, not worked on.
    return ~F.regexp_like(F.lower(path), F.lit(r"/logs/|_logs|\.log|/node_modules/|/\.npm/|/tmp/"))


def evt_range(start: F.Column, end: F.Column) -> F.Column:
    """``evt A`` or ``evt A–B``, whichever bound comes first."""
    low, high = F.least(start, end), F.greatest(start, end)
    return F.when(low == high, F.format_string("evt %d", low)).otherwise(F.format_string("evt %d–%d", low, high))


def provenance(sources: F.Column) -> F.Column:
    """All ranges of an item in brackets; empty without sources."""
    shown = F.array_join(F.transform(sources, lambda r: evt_range(r["start"], r["end"])), ", ")
    return F.when(F.size(sources) > 0, F.concat(F.lit("["), shown, F.lit("]"))).otherwise("")


def span(sources: F.Column) -> F.Column:
    """The widest range that an item cites, as (start, end); null without sources."""
    low = F.array_min(F.transform(sources, lambda r: F.least(r["start"], r["end"])))
    return F.when(F.size(sources) > 0, F.struct(low.alias("start"), F.array_max(F.transform(sources, lambda r: F.greatest(r["start"], r["end"]))).alias("end")))
