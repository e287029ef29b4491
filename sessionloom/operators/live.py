"""Which part of a session's history is live: paths up a tree of entries, roots of chains, and turns that rollbacks took back.

Entries that follow their parent directly are runs; only the links between runs are walked, by pointer doubling, so the rounds are the logarithm of the branches that
a path crosses, whatever its length.  A session's rows meet in windows only, which spill; none is ever held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.operators.steps import Steps


def runs(entries: DataFrame) -> DataFrame:
    """``entries`` (session_key, id, pos, up: the parent's id or null; ids are unique in a session) with run: the number of the run, and head: whether it begins here."""
    w = Window.partitionBy("session_key").orderBy("pos")
    head = ~F.coalesce(F.col("up") == F.lag("id").over(w), F.lit(False))
    return entries.withColumn("head", head).withColumn("run", F.sum(F.col("head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _links(entries: DataFrame) -> DataFrame:
    """session_key, run, to, at: the run that each run's first entry hangs on, and the place there."""
    above = entries.select("session_key", F.col("id").alias("up"), F.col("run").alias("to"), F.col("pos").alias("at"))
    return entries.where("head AND up IS NOT NULL").select("session_key", "run", "up").join(above, ["session_key", "up"]).select("session_key", "run", "to", "at")


def _doubled(links: DataFrame) -> DataFrame:
    further = links.select("session_key", F.col("run").alias("to"), F.col("to").alias("_to"), F.col("at").alias("_at"))
    return links.join(further, ["session_key", "to"]).select("session_key", "run", F.col("_to").alias("to"), F.col("_at").alias("at"))


def on_path(entries: DataFrame, leaves: DataFrame, steps: Steps) -> DataFrame:
    """session_key, id of the entries (see ``runs``; without gaps in ``up``) on the way from each session's leaf (session_key, id) up; a circle ends where it closes."""
    own = steps.once("path-entries", lambda: runs(entries))
    jump = _links(own)
    seen = leaves.join(own, ["session_key", "id"]).select("session_key", "run", F.col("pos").alias("at"))
    n, k = None, 0
    while jump.take(1):
        k += 1
        step = lambda seen=seen, jump=jump: seen.unionByName(seen.select("session_key", "run").join(jump, ["session_key", "run"]).select("session_key", F.col("to").alias("run"), "at")).groupBy("session_key", "run").agg(F.max("at").alias("at"))
        grown = steps.once(f"path-{k}", step)
        # a circle may come to a run again further on: the sum of the places grows, too
        size = grown.agg(F.count("*"), F.sum("at")).first()
        if tuple(size) == n:
            break
        seen, n = grown, tuple(size)
        jump = steps.once(f"path-links-{k}", lambda jump=jump: _doubled(jump))
    reached = seen.groupBy("session_key", "run").agg(F.max("at").alias("at"))
    return own.join(reached, ["session_key", "run"]).where("pos <= at").select("session_key", "id")


def roots(entries: DataFrame, steps: Steps) -> DataFrame:
    """session_key, id, root: the entry without parent that each entry's chain ends at.  Parents come before their children."""
    own = steps.once("roots-entries", lambda: runs(entries))
    firsts = own.where("head").select("session_key", "run", F.col("id").alias("root"))
    links = steps.once("roots-links-0", lambda: own.where("head").select("session_key", "run").join(_links(own).drop("at"), ["session_key", "run"], "left").select("session_key", "run", F.coalesce("to", "run").alias("to")))
    k = 0
    while True:
        k += 1
        further = links.select("session_key", F.col("run").alias("to"), F.col("to").alias("_to"))
        doubled = steps.once(f"roots-links-{k}", lambda links=links, further=further: links.join(further, ["session_key", "to"]).select("session_key", "run", F.col("_to").alias("to"), (F.col("_to") != F.col("to")).alias("moved")))
        links = doubled.drop("moved")
        if not doubled.where("moved").take(1):
            break
    of_run = links.join(firsts.withColumnRenamed("run", "to"), ["session_key", "to"]).select("session_key", "run", "root")
    return own.join(of_run, ["session_key", "run"]).select("session_key", "id", "root")


def with_survivors(rows: DataFrame, starts: Column, back: Column, order: list[str]) -> DataFrame:
    """``rows`` with survives: turns form a stack; a start puts one on it, a rollback takes as many off as it says, as long as there are any, and what follows belongs
    to the turn then on top.  The height of a stack that stops at its floor is the running sum less its least value so far below zero."""
    upto = Window.partitionBy("session_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("session_key").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    summed = rows.withColumn("_sum", F.sum(F.when(starts, 1).otherwise(0).cast("long") - F.coalesce(back, F.lit(0)).cast("long")).over(upto))
    level = summed.withColumn("_level", F.col("_sum") - F.least(F.min("_sum").over(upto), F.lit(0)))
    return level.withColumn("survives", back.isNull() & (F.min("_level").over(on) >= F.col("_level"))).drop("_sum", "_level")
