"""Questions on a session, answers to them, and their score by arm and class."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators.events import user_turns
from sessionloom.operators.segment import stride_sample

TRIALS = "session_key string, arm string, question_id int, class string, correct boolean, tokens long, expansions int"


def questions(found: DataFrame, deep: int = 8) -> DataFrame:
    """session_key, evt, class, question, key: what a spread of earlier events said, by their most telling token.

    The spread is over the first 85 % of a session's telling events; a session with fewer there than ``deep`` gives none.
    """
    keyed = _keyed(found)
    enough = keyed.groupBy("session_key").agg(F.count("*").alias("n")).where(F.floor(F.col("n") * 85 / 100) >= deep).select("session_key")
    chosen = keyed.join(stride_sample(keyed.select("session_key", "evt").join(enough, "session_key", "left_semi"), deep), ["session_key", "evt"])
    return _asked(chosen, "deep")


def recent_questions(found: DataFrame, recent: int = 4) -> DataFrame:
    """The same of the last telling events of each session."""
    w = Window.partitionBy("session_key").orderBy(F.desc("evt"))
    return _asked(_keyed(found).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= recent), "recent")


def _keyed(found: DataFrame) -> DataFrame:
    told = found.where("is_active").where(F.col("kind").isin("user_message", "assistant_text", "tool_result")).select("session_key", F.col("idx").alias("evt"), "kind", F.coalesce("text", "output", F.lit("")).alias("t"))
    return told.withColumn("key", X.distinctive(F.col("t"))).where("key IS NOT NULL")


def _asked(chosen: DataFrame, name: str) -> DataFrame:
    return chosen.select("session_key", "evt", F.lit(name).alias("class"), F.concat(F.lit("What was named in event "), F.col("evt").cast("string"), F.lit("?")).alias("question"), "key")


def brief_questions(found: DataFrame, messages: DataFrame, files: DataFrame, commits: DataFrame, errors: DataFrame, folders: DataFrame) -> DataFrame:
    """session_key, id, class, question, key, evt: what a handoff is bound to say, as far as the session has it: the first wish (its first eight words), the file edited most, the newest
    commit, the open error that came most often, the number of the user's turns and the working folder (session_key, cwd; empty if unknown)."""
    words = F.array_join(F.slice(F.split(F.trim(F.col("text")), r"\s+"), 1, 8), " ")
    edits = F.struct("edits", F.length("path"), "path")
    often = F.struct(-F.col("occurrences"), F.col("sig"))
    parts = {
        "goal": ("What did the user first ask for?", messages.where("role = 'user'").groupBy("session_key").agg(F.min_by(words, "evt").alias("key"), F.min("evt").alias("evt"))),
        "busiest-file": ("Which file was edited most often?", files.where("edits > 0").groupBy("session_key").agg(F.max_by("path", edits).alias("key"), F.max_by("last_evt", edits).alias("evt"))),
        "last-commit": ("What was the newest commit?", commits.groupBy("session_key").agg(F.max_by("subject", "evt").alias("key"), F.max("evt").alias("evt"))),
        "unresolved": ("Which error was never resolved?", errors.where("status = 'unresolved'").groupBy("session_key").agg(F.min_by("sig", often).alias("key"), F.min_by("last_evt", often).alias("evt"))),
        "user-turns": ("How often did the user speak?", user_turns(found).select("session_key", F.col("user_turns").cast("string").alias("key"), F.lit(0).alias("evt"))),
        "dir": ("Which folder was worked in?", found.select("session_key").distinct().join(folders.select("session_key", "cwd"), "session_key", "left").select("session_key", F.coalesce("cwd", F.lit("")).alias("key"), F.lit(0).alias("evt"))),
    }
    out = None
    for name, (question, part) in parts.items():
        own = part.select("session_key", F.lit(name).alias("id"), F.lit("brief").alias("class"), F.lit(question).alias("question"), "key", F.col("evt").cast("int").alias("evt"))
        out = own if out is None else out.unionByName(own)
    return out


def correct(answer: Column, key: Column) -> Column:
    """Whether a normalised answer contains the normalised key; an empty key is never right."""
    k = X.normalize_answer(key)
    return (k != "") & F.contains(X.normalize_answer(answer), k)


def expansions(answer: Column) -> Column:
    """The ``EXPAND a..b`` requests in an answer, as (start, end)."""
    found = F.regexp_extract_all(answer, F.lit(r"EXPAND\s+([0-9]+(?:\.\.=?[0-9]*)?)"), F.lit(1))
    return F.filter(F.transform(found, X.parse_range), lambda r: r.isNotNull())


def arms_by_questions(arms: DataFrame, asked: DataFrame) -> DataFrame:
    """Every arm with every question; arms are a handful of names."""
    return asked.crossJoin(F.broadcast(arms))


def trials(plan: DataFrame, answer: Callable[[str, str], str]) -> DataFrame:
    """session_key, arm, evt, answer: an injected function (arm, question) -> answer, run where the rows are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"session_key": f["session_key"], "arm": f["arm"], "evt": f["evt"], "key": f["key"], "class": f["class"], "answer": [answer(a, q) for a, q in zip(f["arm"], f["question"], strict=True)]})

    return plan.select("session_key", "arm", F.col("evt").cast("int"), "key", "class", "question").mapInPandas(run, "session_key string, arm string, evt int, key string, class string, answer string")


def score(done: DataFrame) -> DataFrame:
    """asked, correct, tokens, expansions, accuracy, tokens_per_correct by (session, arm, class), (session, arm), (arm, class) and (arm): ``level`` says which."""
    g = done.groupingSets([["session_key", "arm", "class"], ["session_key", "arm"], ["arm", "class"], ["arm"]], "session_key", "arm", "class").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("asked"), F.count_if("correct").alias("correct"), F.sum("tokens").cast("long").alias("tokens"), F.sum("expansions").cast("long").alias("expansions")
    )
    per = F.when(F.col("correct") > 0, F.floor(F.col("tokens") / F.col("correct")).cast("long"))
    return g.select("session_key", "arm", "class", "level", "asked", "correct", "tokens", "expansions", (F.col("correct") / F.col("asked")).alias("accuracy"), per.alias("tokens_per_correct"))
