"""Trials in rounds: an injected function answers questions and may ask to see events first; each round holds only the trials that asked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators import brief, evaluation
from sessionloom.operators.steps import Steps

EXPANSIONS = 3
KEY = ["session_key", "arm", "class", "evt"]


def prompt(context: Column, conversation: Column, question: Column) -> Column:
    return F.concat(context, conversation, F.lit("\nQuestion: "), question)


def asked(frontier: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """The frontier's KEY with answer and failed.  One call a row, where the rows are; a failure is an answer that is wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, failed = [], []
            for p in b.column(len(KEY)).to_pylist():
                try:
                    out.append(answer(p))
                    failed.append(False)
                except Exception:  # noqa: BLE001  one lost call must not lose the run
                    out.append("")
                    failed.append(True)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(KEY)], pa.array(out, pa.string()), pa.array(failed, pa.bool_())], [*KEY, "answer", "failed"])

    sent = frontier.select("session_key", "arm", "class", F.col("evt").cast("int").alias("evt"), prompt(F.col("context"), F.col("conversation"), F.col("question")).alias("prompt"))
    return sent.mapInArrow(run, "session_key string, arm string, class string, evt int, answer string, failed boolean")


def trials(plan: DataFrame, rows: DataFrame, answer: Callable[[str], str], folder: str, most: int = EXPANSIONS) -> DataFrame:
    """KEY, answer, correct, tokens (of all prompts and of the events shown), expansions of each trial.

    ``plan``: session_key, arm, class, evt (the question's, unique in a session, arm and class), question, key, context, can_expand; ``rows``: session_key, evt, text, tokens, what can be seen.  An arm that
    can expand gets the first range that its answer asks for and is asked again, ``most`` times at most.  Each round's answers are a table in ``folder``, which must be
    new and shared: a run that was killed goes on and asks nothing twice.
    """
    steps = Steps(plan.sparkSession, folder)
    start = {"conversation": F.lit(""), "used": F.lit(0).cast("long"), "expansions": F.lit(0)}
    frontier, done = steps.once("plan", lambda: plan.withColumn("evt", F.col("evt").cast("int")).withColumns(start)), None
    for k in range(most + 1):
        said = steps.once(f"answers-{k}", lambda frontier=frontier: asked(frontier, answer))
        told = frontier.join(said, KEY).withColumn("used", F.col("used") + X.tokens(prompt(F.col("context"), F.col("conversation"), F.col("question"))))
        told = told.withColumn("range", F.get(evaluation.expansions(F.col("answer")), F.lit(0)))
        again = F.col("can_expand") & ~F.col("failed") & F.col("range").isNotNull() & F.lit(k < most)
        ended = told.where(~again).select(*KEY, "answer", (~F.col("failed") & evaluation.correct(F.col("answer"), F.col("key"))).alias("correct"), F.col("used").alias("tokens"), "expansions")
        done = ended if done is None else done.unionByName(ended)
        if k == most:
            break
        open_ = told.where(again).withColumn("range_id", F.concat_ws("\x00", "arm", "class", F.col("evt").cast("string")))

        def shown(open_: DataFrame = open_) -> DataFrame:
            ranges = open_.select("session_key", "range_id", "range.start", "range.end")
            found = brief.expanded(rows, ranges)
            line = F.when(F.col("evt").isNotNull(), F.concat("text", F.lit("  (evt "), F.col("evt").cast("string"), F.lit(")\n")))
            body = found.groupBy("session_key", "range_id", "start", "end").agg(F.array_sort(F.collect_list(F.struct("evt", line.alias("line")))).alias("b"))
            text = F.array_join(F.transform("b", lambda x: F.coalesce(x["line"], F.lit("(no rows in this range)\n"))), "")
            told_ = F.concat(F.lit("\nYou asked for evt "), F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string"), F.lit(":\n"), text)
            both = open_.join(body.select("session_key", "range_id", text.alias("_events"), told_.alias("_told")), ["session_key", "range_id"])
            grown = {"conversation": F.concat("conversation", "_told"), "used": F.col("used") + X.tokens(F.col("_events")), "expansions": F.col("expansions") + 1}
            return both.withColumns(grown).select(frontier.columns)

        frontier = steps.once(f"frontier-{k + 1}", shown)
        if not frontier.take(1):
            break
    return done
