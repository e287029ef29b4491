"""Transcript lines to events, as column expressions: a line is parsed once, as a variant, and gives an array of events.

What depends on other lines (streams, pairing, live branches, ordinals) is not here; see ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions import text as X

PLAN = "array<struct<text:string,status:string>>"
#: The fields of an event that come from its line alone.
FIELDS = {
    "kind": "string", "text": "string", "is_meta": "boolean", "phase": "string", "redacted": "boolean", "call_id": "string", "tool_name": "string", "tool_class": "string", "args": "string",
    "output": "string", "is_error": "boolean", "exit_code": "int", "command": "string", "plan": PLAN, "question": "string", "answer": "string", "num_turns": "int", "model": "string",
    "subtype": "string", "windowed": "boolean", "native_id": "string",
}
EVENT = "struct<" + ",".join(f"{k}:{t}" for k, t in FIELDS.items()) + ">"
EVENTS = f"array<{EVENT}>"

# The providers' tool names and what they do.
TOOLS = {
    "tree": {
        "edit": ["Edit", "MultiEdit", "Write", "NotebookEdit"], "read": ["Read", "NotebookRead"], "search": ["Grep", "Glob", "LS"], "shell": ["Bash", "BashOutput", "KillBash"],
        "plan": ["TodoWrite", "ExitPlanMode"], "subagent": ["Task", "Agent"], "web": ["WebFetch", "WebSearch"], "ask": ["AskUserQuestion"],
    },
    "rollout": {
        "edit": ["apply_patch"], "read": ["read_file"], "shell": ["shell", "exec_command", "write_stdin", "local_shell_call"], "plan": ["update_plan"], "ask": ["request_user_input"],
        "web": ["web_search_call", "web_search"], "search": ["file_search"],
    },
    "journal": {
        "edit": ["edit", "write", "multi_edit"], "read": ["read"], "search": ["grep", "glob", "list"], "shell": ["bash"], "plan": ["todo_write"], "subagent": ["task"], "web": ["web_fetch"],
        "ask": ["ask_user"],
    },
}
CLASS_OF = {p: {n.lower(): c for c, names in t.items() for n in names} for p, t in TOOLS.items()}
# Keys of tool arguments, and of the plan's list, text and status.
PATH_KEYS = ["file_path", "filePath", "path", "notebook_path", "file", "target_file"]
COMMAND_KEYS = ["command", "cmd", "script"]
PLAN_LISTS = {"tree": ["todos", "plan"], "rollout": ["plan", "steps"], "journal": ["todos", "items"]}
OPENERS = X.HARNESS_OPENERS
SILENT = ["token_usage_record", "world_state", "security_risk_score", "retained_context", "realtime_item", "turn_diff", "inter_agent_communication_metadata"]
MAX_DEPTH = 8
_PART = "struct<s:string,v:variant,within:array<int>>"


# ---- values of a variant


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def type_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return F.coalesce(type_of(v) == "STRING", F.lit(False))


def text_of(v: Column) -> Column:
    """A variant that is a string, as one; null for any other."""
    return F.when(is_string(v), F.try_variant_get(v, "$", "string"))


def string(v: Column, *keys: str) -> Column:
    """The first of the keys with a non-empty string."""
    return F.coalesce(*[F.nullif(text_of(get(v, k)), F.lit("")) for k in keys])


def boolean(v: Column, key: str) -> Column:
    return F.when(type_of(get(v, key)) == "BOOLEAN", F.try_variant_get(v, f"$.{key}", "boolean"))


def whole(v: Column, key: str) -> Column:
    """An integer of 32 bits, or null."""
    return F.when(type_of(get(v, key)) == "BIGINT", F.try_variant_get(v, f"$.{key}", "int"))


def listed(v: Column) -> Column:
    """The elements of a list; null for any other value."""
    return F.when(F.startswith(type_of(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(type_of(v), F.lit("OBJECT")), F.lit(False))


def compact_json(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("null"))


def _expand(e: Column, here: Column) -> Column:
    """One level down: a part is a finished string, s, or a value, v; within: the objects that it is the content of, by number."""
    v, none = e["v"], F.array().cast(f"array<{_PART}>")
    part = lambda s, v, within: F.struct((s if s is not None else F.lit(None).cast("string")).alias("s"), (v if v is not None else F.lit(None).cast("variant")).alias("v"), within.alias("within"))
    done = lambda s: F.array(part(s, None, e["within"]))
    content, inside = get(v, "content"), F.concat(e["within"], F.array(here))
    own = string(v, "text", "thinking")
    of_object = F.when(own.isNotNull(), done(own)).when(content.isNotNull(), F.array(part(None, content, inside))).otherwise(none)
    of_list = F.transform(F.filter(listed(v), lambda x: is_string(x) | is_object(x)), lambda x: part(None, x, e["within"]))
    kind = type_of(v)
    return (
        F.when(e["s"].isNotNull(), F.array(e))
        .when(v.isNull() | (kind == "VOID"), none)
        .when(kind == "STRING", done(text_of(v)))
        .when(F.startswith(kind, F.lit("OBJECT")), of_object)
        .when(F.startswith(kind, F.lit("ARRAY")), of_list)
        .otherwise(done(F.to_json(v)))
    )


def flat_text(v: Column) -> Column:
    """A content field as text: strings, typed blocks, lists of them and messages around them, to MAX_DEPTH levels; never null.  What an object holds
    counts for nothing if it is blank as a whole."""
    start = F.array(F.struct(F.lit(None).cast("string").alias("s"), v.alias("v"), F.array().cast("array<int>").alias("within"))).cast(f"array<{_PART}>")
    levels = F.sequence(F.lit(0), F.lit(MAX_DEPTH))
    number = lambda level, i: level * 1_000_000 + i
    parts = F.aggregate(levels, start, lambda acc, level: F.flatten(F.transform(acc, lambda e, i: _expand(e, number(level, i)))))
    said = F.filter(parts, lambda p: F.coalesce(p["s"], F.lit("")) != "")
    counts = lambda all_, p: (F.size(p["within"]) == 0) | ~is_blank(p["s"]) | F.exists(all_, lambda o: ~is_blank(o["s"]) & F.array_contains(o["within"], F.element_at(p["within"], -1)))
    deep = X.let(said, lambda all_: F.array_join(F.transform(F.filter(all_, lambda p: counts(all_, p)), lambda p: p["s"]), "\n"))
    return F.when(v.isNull(), "").when(is_string(v), text_of(v)).otherwise(deep)


def output_text(v: Column) -> Column:
    return F.when(v.isNull() | (type_of(v) == "VOID"), "").otherwise(X.let(flat_text(v), lambda t: F.when((t != "") | is_string(v), t).otherwise(compact_json(v))))


def is_blank(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?U)^\s*$"))


def injected(text: Column, provider: str) -> Column:
    """Whether the harness put a user's message there."""
    return F.coalesce(X.is_harness_fragment(text, provider), F.lit(False))


# ---- events


def event(**values: Column | str | bool) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*[as_column(values.get(k)).cast(t).alias(k) for k, t in FIELDS.items()])


def one(when: Column, made: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(made)).otherwise(F.array().cast(EVENTS))


def none() -> Column:
    return F.array().cast(EVENTS)


def tool_class(provider: str, name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CLASS_OF[provider].items() for x in pair])
    return F.when(F.startswith(name, F.lit("mcp__")), "mcp").otherwise(F.coalesce(F.element_at(table, F.lower(name)), F.lit("other")))


def plan_of(provider: str, args: Column) -> Column:
    steps = F.coalesce(*[listed(get(args, k)) for k in PLAN_LISTS[provider]])
    named = F.filter(steps, lambda s: string(s, "step", "content", "text", "title").isNotNull())
    return F.transform(named, lambda s: F.struct(string(s, "step", "content", "text", "title").alias("text"), F.coalesce(string(s, "status", "state"), F.lit("pending")).alias("status")))


def call(provider: str, name: Column, call_id: Column, args: Column, **where) -> Column:
    """A tool call, and the plan that it sets."""
    kind = tool_class(provider, name)
    made = event(kind="tool_call", call_id=call_id, tool_name=name, tool_class=kind, args=compact_json(args), **where)
    plan = plan_of(provider, args)
    return F.concat(F.array(made), one((kind == "plan") & (F.size(plan) > 0), event(kind="plan_update", plan=plan, **where)))


def tree_events(raw: Column) -> Column:
    """The events of a line of a linked transcript.  A call that starts a subagent is a subagent_spawn, with its call_id."""
    kind, content = F.coalesce(text_of(get(raw, "type")), F.lit("")), get(raw, "message.content")
    blocks = F.coalesce(listed(content), F.array(content))

    def user(b: Column) -> Column:
        error = boolean(b, "is_error")
        output = X.let(output_text(get(b, "content")), lambda t: F.when(t != "", t).otherwise(output_text(get(raw, "toolUseResult"))))
        result = event(kind="tool_result", call_id=F.coalesce(string(b, "tool_use_id", "toolUseId"), F.lit("")), output=output, is_error=error)
        meta = lambda t: F.coalesce(boolean(raw, "isMeta"), F.lit(False)) | injected(t, "tree")
        said = X.let(flat_text(b), lambda t: one(~is_blank(t), event(kind="user_message", text=t, is_meta=meta(t))))
        return F.when(F.coalesce(text_of(get(b, "type")) == "tool_result", F.lit(False)), F.array(result)).otherwise(said)

    def assistant(b: Column) -> Column:
        t, args = F.coalesce(text_of(get(b, "type")), F.lit("")), get(b, "input")
        name, call_id = F.coalesce(string(b, "name"), F.lit("unknown")), F.coalesce(string(b, "id", "tool_use_id"), F.lit(""))
        spawn = event(kind="subagent_spawn", call_id=call_id, text=F.coalesce(string(args, "prompt", "description", "task"), F.lit("")))
        thought = F.when(t == "thinking", string(b, "thinking", "text"))
        said = X.let(flat_text(b), lambda s: one(~is_blank(s), event(kind="assistant_text", text=s, phase="final")))
        return (
            F.when((t == "tool_use") & (tool_class("tree", name) == "subagent"), F.array(spawn))
            .when(t == "tool_use", call("tree", name, call_id, args))
            .when(t.isin("thinking", "redacted_thinking"), F.array(event(kind="reasoning", text=thought, redacted=thought.isNull())))
            .otherwise(said)
        )

    return (
        F.when((kind == "user") & F.coalesce(boolean(raw, "isCompactSummary"), F.lit(False)), F.array(event(kind="compaction_summary", text=flat_text(content))))
        .when(kind == "user", F.flatten(F.transform(blocks, user)))
        .when(kind == "assistant", F.flatten(F.transform(blocks, assistant)))
        .when(kind == "system", F.array(event(kind="system", subtype=F.coalesce(string(raw, "subtype"), F.lit("system")), text=string(raw, "content", "message", "text"))))
        .when(kind == "summary", F.array(event(kind="system", subtype="summary", text=string(raw, "summary"))))
        .when(kind == "fork-context-ref", F.array(event(kind="system", subtype="fork_context_ref", text=string(raw, "agentId", "parentLastUuid"))))
        .otherwise(F.array(event(kind="unknown", text=compact_json(raw))))
    )


def tree_note(raw: Column) -> Column:
    kind = F.coalesce(text_of(get(raw, "type")), F.lit(""))
    return F.when(~kind.isin("user", "assistant", "system", "summary", "fork-context-ref"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("<missing type>")))


def rollout_events(raw: Column) -> Column:
    """The events of an envelope.  An output is a tool_result even where it answers a question; ``answer`` then holds what was chosen, if it can be read."""
    kind, body = F.coalesce(text_of(get(raw, "type")), F.lit("")), get(raw, "payload")
    sub = F.coalesce(string(body, "type"), F.lit(""))
    native = string(body, "id")

    role = F.coalesce(string(body, "role"), F.lit(""))
    said = lambda t: F.when(role == "user", F.array(event(kind="user_message", text=t, is_meta=injected(t, "rollout"), native_id=native))).otherwise(
        F.array(event(kind="assistant_text", text=t, phase=F.when(F.coalesce(text_of(get(body, "phase")) == "commentary", F.lit(False)), "commentary").otherwise("final"), native_id=native))
    )
    message = X.let(flat_text(get(body, "content")), lambda t: F.when(is_blank(t) | role.isin("developer", "system"), none()).otherwise(said(t)))

    thought = F.coalesce(*[X.let(flat_text(get(body, k)), lambda t: F.when(~is_blank(t), t)) for k in ("summary", "content")])
    reasoning = F.array(event(kind="reasoning", text=thought, redacted=thought.isNull(), native_id=native))

    name = F.coalesce(string(body, "name", "tool_name"), sub)
    call_id = F.coalesce(string(body, "call_id", "id"), F.lit(""))
    given = F.coalesce(*[F.when(type_of(get(body, k)) != "VOID", get(body, k)) for k in ("arguments", "input", "action")])
    args = F.when(is_string(given), F.coalesce(F.try_parse_json(text_of(given)), given)).otherwise(given)

    def question(a: Column) -> Column:
        each = F.filter(F.transform(F.coalesce(listed(get(a, "questions")), F.array().cast("array<variant>")), lambda q: string(q, "question", "prompt", "text", "header")), lambda q: q.isNotNull())
        return F.coalesce(string(a, "question", "prompt", "message"), F.nullif(F.array_join(each, " · "), F.lit("")), flat_text(a))

    asks = name == "request_user_input"
    called = X.let(args, lambda a: F.transform(call("rollout", name, call_id, a, native_id=native), lambda e: e.withField("question", F.when(asks & (e["kind"] == "tool_call"), question(a)))))

    value = get(body, "output")
    lists = F.transform(F.map_values(F.try_variant_get(value, "$.answers", "map<string,variant>")), lambda x: F.coalesce(listed(get(x, "answers")), F.array().cast("array<variant>")))
    chosen = F.array_join(F.filter(F.transform(F.flatten(lists), text_of), lambda x: x.isNotNull()), "; ")
    ok = boolean(value, "success")
    error = F.when(ok.isNotNull(), ~ok).otherwise(boolean(body, "is_error"))
    result = F.array(event(kind="tool_result", call_id=call_id, output=output_text(value), is_error=error, exit_code=whole(value, "exit_code"), answer=F.nullif(chosen, F.lit("")), native_id=native))

    query = F.coalesce(string(body, "query", "action"), F.lit(""))
    search = F.array(event(kind="tool_call", call_id=F.coalesce(string(body, "id"), F.lit("")), tool_name=sub, tool_class="web", args=F.to_json(F.struct(query.alias("query")))))
    item = (
        F.when(sub == "message", message)
        .when(sub == "reasoning", reasoning)
        .when(sub.isin("function_call", "custom_tool_call", "local_shell_call"), called)
        .when(sub.isin("function_call_output", "custom_tool_call_output"), result)
        .when(sub == "web_search_call", search)
        .when(sub.isin("compaction", "context_compaction"), F.array(event(kind="system", subtype="native_compaction", native_id=native)))
        .otherwise(F.array(event(kind="unknown", text=F.when(is_object(body), compact_json(body)).otherwise("{}"), native_id=native)))
    )
    turns = whole(body, "num_turns")
    back = one(F.contains(sub, F.lit("rolled_back")), event(kind="rollback", num_turns=F.when(turns >= 0, turns).otherwise(1)))
    text = F.coalesce(string(body, "message", "summary", "text"), F.nullif(flat_text(get(body, "replacement_history")), F.lit("")))
    number = get(body, "window_number")
    windowed = F.coalesce((type_of(number) == "BIGINT") & (F.try_variant_get(number, "$", "long") >= 0) & (F.try_variant_get(number, "$", "long") < 1 << 31), F.lit(False))
    compacted = F.when(text.isNotNull(), F.array(event(kind="compaction_summary", text=text, windowed=windowed))).otherwise(F.array(event(kind="system", subtype="native_compaction", windowed=windowed)))
    return (
        F.when(kind == "response_item", item)
        .when(kind == "event_msg", back)
        .when(kind == "compacted", compacted)
        .when(kind.isin("session_meta", "turn_context", *SILENT), none())
        .otherwise(F.array(event(kind="unknown", text=compact_json(raw))))
    )


def rollout_note(raw: Column) -> Column:
    kind, sub = F.coalesce(text_of(get(raw, "type")), F.lit("")), F.coalesce(string(get(raw, "payload"), "type"), F.lit(""))
    known = ["message", "reasoning", "function_call", "custom_tool_call", "local_shell_call", "function_call_output", "custom_tool_call_output", "web_search_call", "compaction", "context_compaction"]
    return F.when((kind == "response_item") & ~sub.isin(*known), F.concat(F.lit("response_item:"), sub)).when(~kind.isin("response_item", "event_msg", "compacted", "session_meta", "turn_context"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("<missing type>")))


def journal_kind(raw: Column) -> Column:
    return F.lower(F.replace(F.coalesce(text_of(get(raw, "type")), F.lit("")), F.lit("_"), F.lit("")))


def journal_events(raw: Column) -> Column:
    kind, hidden = journal_kind(raw), F.coalesce(boolean(raw, "excludeFromContext"), F.lit(False))
    message = get(raw, "message")
    role, content = F.coalesce(text_of(get(message, "role")), F.lit("")), get(message, "content")
    context = F.coalesce(boolean(message, "isContext"), F.lit(False)) | F.coalesce(boolean(raw, "isContext"), F.lit(False))
    user = X.let(flat_text(content), lambda t: one(~is_blank(t), event(kind="user_message", text=t, is_meta=context)))
    result = F.array(event(kind="tool_result", call_id=F.coalesce(string(message, "toolCallId", "id"), F.lit("")), output=output_text(content), is_error=boolean(message, "isError")))
    thought = string(message, "thinking", "reasoning")
    thinks = one(thought.isNotNull() | F.coalesce(boolean(message, "redactedThinking"), F.lit(False)), event(kind="reasoning", text=thought, redacted=thought.isNull()))
    said = X.let(flat_text(content), lambda t: one(~is_blank(t), event(kind="assistant_text", text=t, phase="final")))
    single = get(message, "toolCall")
    calls = F.when(single.isNotNull() & (type_of(single) != "VOID"), F.array(single)).otherwise(F.coalesce(listed(get(message, "toolCalls")), F.array().cast("array<variant>")))
    given = lambda c: F.coalesce(*[F.when(type_of(get(c, k)) != "VOID", get(c, k)) for k in ("arguments", "input")])
    each = F.transform(F.filter(calls, is_object), lambda c: call("journal", F.coalesce(string(c, "name", "tool"), F.lit("")), F.coalesce(string(c, "id", "toolCallId"), F.lit("")), given(c)))
    spoken = F.when(role == "user", user).when(F.lower(F.replace(role, F.lit("_"), F.lit(""))) == "toolresult", result).otherwise(F.concat(thinks, said, F.flatten(each)))

    code = F.coalesce(whole(raw, "exitCode"), whole(raw, "exit_code"))
    out = F.coalesce(*[F.when(type_of(get(raw, k)) != "VOID", get(raw, k)) for k in ("output", "result")])
    ran = one(~hidden, event(kind="shell_execution", command=F.coalesce(string(raw, "command", "cmd"), F.lit("")), output=output_text(out), exit_code=code))
    custom = one(~hidden, event(kind="system", subtype=F.coalesce(string(raw, "customType", "custom_type", "subtype"), F.lit("custom")), text=string(raw, "text", "content", "message")))
    return (
        F.when(kind == "message", spoken)
        .when(kind == "bashexecution", ran)
        .when(kind.isin("compaction", "compactionsummary"), F.array(event(kind="compaction_summary", text=F.coalesce(string(raw, "summary", "text", "message"), flat_text(get(raw, "details"))))))
        .when(kind == "branchsummary", F.array(event(kind="branch_summary", text=F.coalesce(string(raw, "summary", "text"), F.lit("")))))
        .when(kind == "modelchange", F.array(event(kind="model_change", model=F.coalesce(string(raw, "model", "to"), F.lit("")))))
        .when(kind.isin("custom", "custommessage"), custom)
        .when(kind.isin("label", "sessioninfo", "session"), none())
        .otherwise(F.array(event(kind="unknown", text=compact_json(raw))))
    )


def journal_note(raw: Column) -> Column:
    known = ["message", "bashexecution", "compaction", "compactionsummary", "branchsummary", "modelchange", "custom", "custommessage", "label", "sessioninfo", "session"]
    return F.when(~journal_kind(raw).isin(*known), F.coalesce(F.nullif(text_of(get(raw, "type")), F.lit("")), F.lit("<missing type>")))
