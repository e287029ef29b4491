"""Masked rows to episodes, chunks, a recent tail, digests and pages.

Sums that restart can't be window frames.  They fold a session's rows, collected as one sorted array of narrow structs (no texts), with the
``aggregate`` function: one shuffle by session, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as X

CHUNK, TAIL, EPISODE, DIGEST = 24_000, 12_000, 1_500, 60_000


def positions(rows: DataFrame) -> DataFrame:
    """The rows with ``pos``, their ordinal in the session."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("session_key").orderBy("evt")) - 1)


def raw_episodes(rows: DataFrame) -> DataFrame:
    """pos, evt, tokens, episode of each row: every human turn but a first row starts one."""
    w = Window.partitionBy("session_key").orderBy("evt")
    numbered = rows.withColumn("pos", F.row_number().over(w) - 1)
    return numbered.withColumn("episode", F.sum(F.when((F.col("pos") > 0) & F.col("is_human_turn"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


_RANGE = "array<struct<start:int,end:int,tokens:bigint>>"


def _session_array(spans: DataFrame, *fields: str) -> DataFrame:
    return spans.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("a"))


def _open_close(items: Column, closes) -> Column:
    """Fold spans (start, end, tokens) into larger ones: ``closes(open, next)`` tells whether the open one ends before the next."""
    empty = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(0).cast("bigint").alias("tokens"))
    state = F.struct(empty.alias("open"), F.array().cast(_RANGE).alias("out"))

    def step(s: Column, x: Column) -> Column:
        o = s["open"]
        shut = o["start"].isNotNull() & closes(o, x)
        joined = F.struct(F.when(shut | o["start"].isNull(), x["start"]).otherwise(o["start"]).alias("start"), x["end"].alias("end"), F.when(shut, x["tokens"]).otherwise(o["tokens"] + x["tokens"]).alias("tokens"))
        return F.struct(joined.alias("open"), F.when(shut, F.concat(s["out"], F.array(o))).otherwise(s["out"]).alias("out"))

    return F.aggregate(items, state, step, lambda s: F.when(s["open"]["start"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["open"]))))


def episodes(rows: DataFrame, least: int = EPISODE) -> DataFrame:
    """session_key, episode, row_start, row_end (included), tokens: short episodes join the next one, a short rest the last."""
    raw = raw_episodes(rows).groupBy("session_key", "episode").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.sum("tokens").alias("tokens"))
    folded = _session_array(raw, "start", "end", "tokens").select("session_key", _open_close(F.col("a"), lambda o, x: o["tokens"] >= least).alias("e"))
    n = F.size("e")
    last, before = F.get("e", n - 1), F.get("e", n - 2)
    both = F.array(F.struct(before["start"].alias("start"), last["end"].alias("end"), (before["tokens"] + last["tokens"]).alias("tokens")))
    merged = F.when((n > 1) & (last["tokens"] < least), F.concat(F.slice("e", 1, F.greatest(n - 2, F.lit(0))), both)).otherwise(F.col("e"))
    return _listed(folded.select("session_key", merged.alias("e")), "episode")


def _listed(arrays: DataFrame, name: str) -> DataFrame:
    each = arrays.select("session_key", F.posexplode("e").alias(name, "x"))
    return each.select("session_key", name, F.col("x.start").alias("row_start"), F.col("x.end").alias("row_end"), F.col("x.tokens").alias("tokens"))


def split_oversized(rows: DataFrame, found: DataFrame, budget: int = CHUNK) -> DataFrame:
    """The episodes with those beyond the budget cut once they have reached it, never before a tool's result; numbered anew."""
    own = positions(rows).select("session_key", "pos", "tokens", F.startswith(F.col("tier"), F.lit("tool_result")).alias("result"))
    each = own.join(found.select("session_key", "row_start", "row_end", F.col("tokens").alias("whole")), "session_key").where("pos BETWEEN row_start AND row_end")
    big = each.groupBy("session_key", "row_start", "whole").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("start"), F.col("pos").alias("end"), "tokens", "result"))).alias("a"))
    cut = _open_close(F.col("a"), lambda o, x: (F.col("whole") > budget) & (o["tokens"] >= budget) & ~x["result"])
    parts = big.select("session_key", F.explode(cut).alias("x")).select("session_key", F.col("x.start").alias("row_start"), F.col("x.end").alias("row_end"), F.col("x.tokens").alias("tokens"))
    number = F.row_number().over(Window.partitionBy("session_key").orderBy("row_start")) - 1
    return parts.select("session_key", number.alias("episode"), "row_start", "row_end", "tokens")


def tail(found: DataFrame, budget: int = TAIL) -> DataFrame:
    """The episodes with ``in_tail``: from the end whole episodes while they fit, one at least; the sums only grow, so this is a frame."""
    w = Window.partitionBy("session_key").orderBy(F.desc("episode")).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("tokens").over(w)
    before = upto - F.col("tokens")
    own = (before == 0) | ((upto <= budget) & (before < budget))
    held = found.withColumn("own", own)
    return held.withColumn("in_tail", F.min(F.col("own").cast("int")).over(w) == 1).drop("own")


def chunks(found: DataFrame, budget: int = CHUNK) -> DataFrame:
    """session_key, chunk, row_start, row_end, tokens: episodes packed in order while the sum stays within the budget."""
    a = _session_array(found.select("session_key", F.col("row_start").alias("start"), F.col("row_end").alias("end"), "tokens"), "start", "end", "tokens")
    return _listed(a.select("session_key", F.filter(F.transform(_open_close(F.col("a"), lambda o, x: o["tokens"] + x["tokens"] > budget), lambda x: x), lambda x: x.isNotNull()).alias("e")), "chunk")


def pages(rows: DataFrame, budget: int) -> DataFrame:
    """session_key, page, row_start, row_end, tokens: consecutive rows within the budget; a larger row is a page of its own."""
    a = _session_array(positions(rows).select("session_key", F.col("pos").alias("start"), F.col("pos").alias("end"), "tokens"), "start", "end", "tokens")
    return _listed(a.select("session_key", _open_close(F.col("a"), lambda o, x: o["tokens"] + x["tokens"] > budget).alias("e")), "page")


def digest(rows: DataFrame, budget: int = DIGEST, least: int = 40, marker: int = 12) -> DataFrame:
    """session_key, evt, text, room (tokens left for a cut row, else null), tokens of the rows that a budget keeps: tier by tier in order of importance, newest first.  The first row of a tier
    that doesn't fit is cut in the middle if ``least`` tokens remain, and ends its tier."""
    a = _session_array(rows.select("session_key", "tier_rank", (-F.col("evt")).alias("back"), "tokens"), "tier_rank", "back", "tokens")
    chosen = "array<struct<evt:int,room:bigint>>"
    state = F.struct(F.lit(budget).cast("bigint").alias("left"), F.lit(-1).alias("shut"), F.array().cast(chosen).alias("out"))

    def step(s: Column, x: Column) -> Column:
        over = x["tokens"] > s["left"]
        open_ = s["shut"] != x["tier_rank"]
        take = F.array(F.struct((-x["back"]).cast("int").alias("evt"), F.when(over, s["left"] - marker).cast("bigint").alias("room")))
        kept = open_ & (~over | (s["left"] >= least))
        return F.struct(
            F.when(open_ & ~over, s["left"] - x["tokens"]).otherwise(s["left"]).alias("left"),
            F.when(open_ & over, x["tier_rank"]).otherwise(s["shut"]).alias("shut"),
            F.when(kept, F.concat(s["out"], take)).otherwise(s["out"]).alias("out"),
        )

    picked = a.select("session_key", F.explode(F.aggregate("a", state, step, lambda s: s["out"])).alias("c")).select("session_key", F.col("c.evt").alias("evt"), F.col("c.room").alias("room"))
    kept = rows.join(picked, ["session_key", "evt"])
    text = F.when(F.col("room").isNull(), F.col("text")).otherwise(X.truncate_middle(F.col("text"), (F.greatest(F.col("room"), F.lit(0)) * 4).cast("int")))
    return kept.select("session_key", "evt", text.alias("text"), "room").withColumn("tokens", X.tokens(F.col("text")))


def arc(turns: DataFrame) -> DataFrame:
    """Of sessions with eight turns and more (session_key, evt), every ``max(inner / 5, 1)``-th inner turn, six at most."""
    w = Window.partitionBy("session_key").orderBy("evt")
    each = turns.withColumns({"pos": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("session_key"))})
    stride = F.greatest(F.floor((F.col("n") - 2) / 5), F.lit(1))
    inner = (F.col("n") >= 8) & F.col("pos").between(1, F.col("n") - 2)
    return each.where(inner & ((F.col("pos") - 1) % stride == 0) & (F.col("pos") - 1 < 6 * stride)).select("session_key", "evt")


def stride_sample(found: DataFrame, n: int, share: float = 0.85) -> DataFrame:
    """Up to n rows (session_key, evt) spread evenly over the first ``share`` of each session."""
    w = Window.partitionBy("session_key").orderBy("evt")
    each = found.withColumns({"pos": F.row_number().over(w) - 1, "size": F.floor(F.count("*").over(Window.partitionBy("session_key")) * share)})
    stride = F.greatest(F.floor(F.col("size") / n), F.lit(1))
    k = F.floor(F.col("pos") / stride)
    return each.where((F.col("pos") < F.col("size")) & (k < n) & (F.col("pos") == k * stride + F.floor(stride / 2))).select("session_key", "evt")


def recent(found: DataFrame) -> DataFrame:
    """The events of the recent window: the last twentieth, 500 at least."""
    size = found.groupBy("session_key").agg(F.max("idx").alias("top"))
    start = (F.col("top") + 1) - F.greatest(F.floor((F.col("top") + 1) / 20), F.lit(500))
    return found.join(size, "session_key").where(F.col("idx") >= F.greatest(start, F.lit(0))).drop("top")


def expand(rows: DataFrame, start: int, end: int, context: int = 0) -> DataFrame:
    """The rows from start to end, both included, and ``context`` events around them."""
    return rows.where(F.col("evt").between(max(0, start - context), end + context))
