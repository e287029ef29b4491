"""A session's tables as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as X
from sessionloom.operators.state import PREFIX


def _joined(df: DataFrame, order: list[str], line: Column, name: str, most: int | None = None) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    kept = rows if most is None else F.slice(rows, 1, most)
    return df.groupBy("session_key").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias(name))


def budgeted(items: DataFrame, budget: int, listed: int = 12) -> DataFrame:
    """session_key, shown, omitted: active items by importance while they fit; those that don't are skipped and named (``listed`` at most)."""
    rank = F.array_position(F.array(*map(F.lit, PREFIX)), F.col("kind")).cast("int")
    line = F.concat(F.lit("- ["), F.col("id"), F.lit("] "), F.col("text"))
    rows = items.where("status = 'active'").select("session_key", rank.alias("rank"), "id", line.alias("line"), X.tokens(line).alias("tokens"))
    a = rows.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "line", "tokens"))).alias("a"))
    state = F.struct(F.lit(budget).cast("bigint").alias("left"), F.array().cast("array<string>").alias("shown"), F.array().cast("array<string>").alias("omitted"))

    def step(s: Column, x: Column) -> Column:
        fits = x["tokens"] <= s["left"]
        return F.struct(
            F.when(fits, s["left"] - x["tokens"]).otherwise(s["left"]).alias("left"),
            F.when(fits, F.concat(s["shown"], F.array(x["line"]))).otherwise(s["shown"]).alias("shown"),
            F.when(fits, s["omitted"]).otherwise(F.concat(s["omitted"], F.array(x["id"]))).alias("omitted"),
        )

    return a.select("session_key", F.aggregate("a", state, step).alias("s")).select("session_key", F.array_join("s.shown", "\n").alias("shown"), F.slice("s.omitted", 1, listed).alias("omitted"))


def document(sessions: DataFrame, constraints: DataFrame, files: DataFrame, commands: DataFrame, errors: DataFrame, plans: DataFrame, tail_rows: DataFrame) -> DataFrame:
    """session_key, markdown: constraints, plan, files (40), last commands (12), open errors (10) and the recent rows."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    parts = {
        "Constraints": _joined(constraints, ["rank"], F.concat(F.lit("- "), F.col("text"), F.lit("  (evt "), F.col("evt").cast("string"), F.lit(")")), "a"),
        "Plan": plans.select("session_key", F.array_join(F.transform("items", lambda i: F.concat(F.lit("- ["), i["status"], F.lit("] "), i["text"])), "\n").alias("a")),
        "Files": _joined(files.where("edits > 0").withColumn("o", -F.col("last_evt")), ["o", "path"], F.concat(F.lit("- "), tick(F.col("path")), F.lit(" — edit×"), F.col("edits").cast("string")), "a", 40),
        "Commands": _joined(commands.withColumn("o", -F.col("evt")), ["o"], F.concat(F.lit("- "), tick(X.one_line(F.col("normalized"), 60)), F.lit(" — "), F.col("status")), "a", 12),
        "Open errors": _joined(errors.where("status = 'unresolved'").withColumn("o", -F.col("occurrences")), ["o", "sig"], F.concat(F.lit("- "), F.col("sig"), F.lit(" ×"), F.col("occurrences").cast("string"), F.lit(" "), X.one_line(F.col("example"), 60)), "a", 10),
        "Recent": _joined(tail_rows, ["evt"], F.concat("text", F.lit("  (evt "), F.col("evt").cast("string"), F.lit(")")), "a"),
    }
    out = sessions.select("session_key").distinct()
    texts = []
    for k, (title, part) in enumerate(parts.items()):
        out = out.join(part.withColumnRenamed("a", f"p{k}"), "session_key", "left")
        texts.append(F.when(F.coalesce(f"p{k}", F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), F.col(f"p{k}"))))
    return out.select("session_key", F.array_join(F.array_compact(F.array(*texts)), "\n\n").alias("markdown"))


def described(events: DataFrame, most: int = 1200, lines: int = 20) -> DataFrame:
    """session_key, evt, line: messages, answers, calls and results as one entry each, bodies of ``most`` characters; other kinds have none."""
    kind, text = F.col("kind"), F.coalesce("text", F.lit(""))
    short = lambda v: F.left(F.substring_index(v, "\n", 1), F.lit(60))
    args = F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json("args", "map<string,string>"))), lambda e: short(e["value"])), " ")
    body = (
        F.when(kind == "user_message", F.concat(F.when(F.coalesce("is_meta", F.lit(False)), "[user-harness] ").otherwise("[user] "), text))
        .when(kind == "user_answer", F.concat(F.lit("[user-answer] "), F.col("question"), F.lit(" "), F.col("answer")))
        .when(kind == "assistant_text", F.concat(F.lit("[assistant] "), text))
        .when(kind == "tool_call", F.concat(F.lit("[call "), F.coalesce("tool_name", F.lit("")), F.lit("] "), F.coalesce(args, F.lit(""))))
        .when(kind == "tool_result", F.concat(F.lit("[result] "), F.substring_index(F.coalesce("output", F.lit("")), "\n", lines)))
    )
    return events.select("session_key", F.col("idx").alias("evt"), F.concat(F.lit("evt "), F.col("idx").cast("string"), F.lit(" "), F.left(body, F.lit(most))).alias("line")).where("line IS NOT NULL")


# The layers of a document.
LAYERS = {"L0": "brief", "L1": "items", "L2": "tail", "L3": "retrieval"}


def layers(chosen: str) -> list[str]:
    """The layers that a list such as ``L0,L2`` names, in order; blanks and case don't matter, an unknown name is an error."""
    names = [p.strip().upper() for p in chosen.split(",") if p.strip()]
    unknown = [n for n in names if n not in LAYERS]
    if unknown:
        raise ValueError(f"unknown layer {unknown[0]}: expected one of {', '.join(LAYERS)}")
    return [LAYERS[n] for n in LAYERS if n in names]
