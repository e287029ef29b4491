"""Events to masked rows: one line of bounded size for each event worth keeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import redact as R
from sessionloom.functions import text as X
from sessionloom.operators.events import PATH_KEYS, is_human

#: Tiers by importance; their place is their rank.
TIERS = ["user", "assistant_final", "subagent", "commentary", "prior_summary", "tool_result_error", "tool_call", "tool_result_ok"]
FINAL, COMMENTARY, REASONING, USER, SUMMARY, ERROR = 1000, 300, 300, 1500, 1500, 2000


def failed() -> Column:
    """True for an error flag or an exit code other than 0; unknown counts as not failed."""
    return F.coalesce(F.col("is_error"), F.lit(False)) | F.coalesce(F.col("exit_code") != 0, F.lit(False))


def _label(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"[{name}] "), text)


def plan_line(plan: Column) -> Column:
    box = lambda s: F.when(s.isin("completed", "done"), "☑").when(s.isin("in_progress", "active"), "▸").otherwise("☐")
    return F.array_join(F.transform(plan, lambda i: F.concat(box(i["status"]), F.lit(" "), i["text"])), " · ")


def call_arguments(args: Column) -> Column:
    """The arguments as ``key=value``, sorted, long values cut."""
    pairs = F.map_entries(F.from_json(args, "map<string,string>"))
    shown = F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(e["key"], F.lit("="), X.truncate_middle(F.regexp_replace(e["value"], F.lit(r"\s+"), F.lit(" ")), 200))), " ")
    return F.coalesce(F.nullif(shown, F.lit("")), X.truncate_middle(F.coalesce(args, F.lit("")), 200))


def edit_stat(args: Column) -> Column:
    """`` (+a −r)``: lines of the new text and of the replaced one in an edit's arguments; `` (+a)`` without the latter, empty without the former."""
    count = lambda t: F.when(t.isNull(), None).when(t == "", 0).otherwise(F.size(F.split(F.regexp_replace(t, F.lit(r"\n\z"), F.lit("")), "\n")))
    new, old = F.coalesce(F.get_json_object(args, "$.new_string"), F.get_json_object(args, "$.content")), F.get_json_object(args, "$.old_string")
    return F.when(new.isNull(), "").when(old.isNull(), F.format_string(" (+%d)", count(new))).otherwise(F.format_string(" (+%d −%d)", count(new), count(old)))


def masked_rows(events: DataFrame, mode: str = "default", keep_reasoning: bool = False, keep_system: bool = False, sidechains: bool = False) -> DataFrame:
    """session_key, evt, tier, tier_rank, text, tokens, is_human_turn of the active events that give a row; see TIERS."""
    text = F.coalesce("text", F.lit(""))
    exit_ = F.when(F.col("exit_code").isNotNull(), F.concat(F.lit(" exit="), F.col("exit_code").cast("string"))).otherwise("")
    kind, meta, output = F.col("kind"), F.coalesce("is_meta", F.lit(False)), F.coalesce("output", F.lit(""))
    call = X.short_id(F.coalesce("call_id", F.lit("")))
    keep = lambda flag, value: F.when(F.lit(flag), value)
    path = F.coalesce(*[F.nullif(F.get_json_object("args", f"$.{k}"), F.lit("")) for k in PATH_KEYS])
    edited = F.when(F.col("tool_class") == "edit", F.concat(path, edit_stat(F.col("args"))))
    row = (
        F.when((kind == "user_message") & meta, F.struct(F.lit("commentary"), _label("user·harness", X.truncate_tokens(text, USER))))
        .when(kind == "user_message", F.struct(F.lit("user"), _label("user", X.truncate_tokens(text, USER))))
        .when(kind == "user_answer", F.struct(F.lit("user"), _label("user·answer", F.concat(F.lit("(asked: "), X.truncate_tokens(F.col("question"), 120), F.lit(") "), X.truncate_tokens(F.col("answer"), USER)))))
        .when((kind == "assistant_text") & (F.col("phase") == "commentary"), F.struct(F.lit("commentary"), _label("assistant·commentary", X.truncate_tokens(text, COMMENTARY))))
        .when(kind == "assistant_text", F.struct(F.lit("assistant_final"), _label("assistant", X.truncate_tokens(text, FINAL))))
        .when((kind == "reasoning") & F.col("text").isNotNull(), F.struct(F.lit("commentary"), keep(keep_reasoning, _label("reasoning", X.truncate_tokens(text, REASONING)))))
        .when((kind == "tool_call") & (F.col("tool_class") != "plan"), F.struct(F.lit("tool_call"), F.concat(F.lit("[call "), F.col("tool_name"), F.lit(" #"), call, F.lit("] "), F.coalesce(edited, call_arguments(F.col("args"))))))
        .when((kind == "tool_result") & failed(), F.struct(F.lit("tool_result_error"), F.concat(F.lit("[result #"), call, F.lit(" ERROR"), exit_, F.lit("] "), X.head_and_tail(output, ERROR))))
        .when(kind == "tool_result", F.struct(F.lit("tool_result_ok"), F.concat(F.lit("[result #"), call, F.lit("] "), X.placeholder(output))))
        .when(
            kind == "shell_execution",
            F.struct(
                F.when(failed(), "tool_result_error").otherwise("tool_call"),
                F.concat(F.lit("[shell"), exit_, F.lit("] "), X.truncate_tokens(F.col("command"), 120), F.lit(" → "), F.when(failed(), X.head_and_tail(output, ERROR)).otherwise(X.placeholder(output))),
            ),
        )
        .when(kind == "plan_update", F.struct(F.lit("commentary"), _label("plan", plan_line(F.col("plan")))))
        .when(kind.isin("compaction_summary", "branch_summary"), F.struct(F.lit("prior_summary"), _label("prior-summary low-trust", X.truncate_tokens(text, SUMMARY))))
        .when(kind == "subagent_spawn", F.struct(F.lit("subagent"), F.concat(F.lit("[subagent#"), F.col("sub_stream").cast("string"), F.lit(" spawn] "), X.truncate_tokens(text, 300))))
        .when(kind == "subagent_result", F.struct(F.lit("subagent"), F.concat(F.lit("[subagent#"), F.col("sub_stream").cast("string"), F.lit(" result] "), X.truncate_tokens(text, 600))))
        .when(kind == "model_change", F.struct(F.lit("commentary"), _label("model", F.col("model"))))
        .when(kind == "system", F.struct(F.lit("commentary"), keep(keep_system, F.concat(F.lit("[system "), F.col("subtype"), F.lit("] "), X.truncate_tokens(text, 200)))))
        .when(kind == "unknown", F.struct(F.lit("commentary"), keep(keep_system, F.lit("[unknown line]"))))
    )
    own = events.where("is_active") if sidechains else events.where("is_active AND stream = 0")
    rows = own.select("session_key", F.col("idx").alias("evt"), (is_human() & (F.col("stream") == 0)).alias("is_human_turn"), row.alias("r"))
    rows = rows.select("session_key", "evt", "is_human_turn", F.col("r.col1").alias("tier"), F.col("r.col2").alias("raw")).where("raw IS NOT NULL")
    rows = rows.withColumn("text", R.redact(X.collapse_blank_lines(F.col("raw")), mode))
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")).cast("int") - 1
    return rows.select("session_key", "evt", "tier", rank.alias("tier_rank"), "text", X.tokens(F.col("text")).alias("tokens"), "is_human_turn")


def rendered(rows: DataFrame) -> DataFrame:
    return rows.select("session_key", "evt", F.concat("text", F.lit("  (evt "), F.col("evt").cast("string"), F.lit(")")).alias("line"))
