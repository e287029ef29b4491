"""A plain version of the adapters: one session's lines, one after the other.  The library's expressions and windows are held against it."""

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from sessionloom.operators.parsing import CLASS_OF, OPENERS, PLAN_LISTS

MAX_DEPTH = 8


class TooManyBadLines(ValueError):
    """More lines are unreadable than allowed."""


def classify(provider: str, name: str) -> str:
    return "mcp" if name.startswith("mcp__") else CLASS_OF[provider].get(name.lower(), "other")


def string(value, *keys: str) -> str | None:
    """The first of the keys with a non-empty string."""
    return next((v for k in keys if isinstance(v := value.get(k), str) and v), None) if isinstance(value, dict) else None


def flat_text(value, depth: int = 0) -> str:
    """A content field as text: strings, typed blocks, lists of them, and messages around them."""
    if depth > MAX_DEPTH or value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        own = string(value, "text", "thinking")
        nested = "" if own else flat_text(value.get("content"), depth + 1)
        return own or (nested if nested.strip() else "")
    if isinstance(value, list):
        return "\n".join(t for b in value if isinstance(b, str | dict) and (t := flat_text(b, depth + 1)))
    return json.dumps(value)


def compact_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def output_text(value) -> str:
    if value is None:
        return ""
    return flat_text(value) or ("" if isinstance(value, str) else compact_json(value))


def injected(text: str, openers: list[str]) -> bool:
    t = text.lstrip()
    if any(t[: len(o)].lower() == o.lower() for o in openers):
        return True
    end = next((i for i, c in enumerate(t[1:], 1) if not (c.isascii() and c.isalnum() or c in "_-")), len(t))
    return t[:1] == "<" and end > 1 and t[end : end + 1] in (">", " ", "\n") and f"</{t[1:end]}>" in t


def whole(value, least: int = -(1 << 31), most: int = (1 << 31) - 1) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) and least <= value <= most else None


@dataclass
class Parsed:
    events: list[dict] = field(default_factory=list)
    notes: list[tuple[str, int | None, str]] = field(default_factory=list)

    def add(self, kind: str, at: tuple[int, int], native_id=None, parent=None, ts=None, stream: int = 0, **values) -> int:
        self.events.append({"kind": kind, "idx": len(self.events), "native_id": native_id, "parent": parent, "ts": ts, "stream": stream, "path_ix": at[0], "line_no": at[1], **values})
        return len(self.events) - 1


def plan_of(provider: str, args) -> list[tuple[str, str]] | None:
    steps = next((args[k] for k in PLAN_LISTS[provider] if isinstance(args.get(k), list)), []) if isinstance(args, dict) else []
    found = [(t, string(s, "status", "state") or "pending") for s in steps if (t := string(s, "step", "content", "text", "title"))]
    return found or None


def _call(p: Parsed, provider: str, name: str, call_id: str, args, where: dict) -> None:
    kind = classify(provider, name)
    p.add("tool_call", call_id=call_id, tool_name=name, tool_class=kind, args=compact_json(args), **where)
    if kind == "plan" and (plan := plan_of(provider, args)):
        p.add("plan_update", plan=plan, **where)


def parse_tree(lines: list[tuple[int, int, dict]]) -> tuple[Parsed, set[int]]:
    """Messages linked by ``parentUuid``; sidechains are streams of their own."""
    p, nodes, stream_of, spawned, last_stream = Parsed(), [], {}, {}, 0
    file_stream: dict[int, int] = {}
    for path_ix, line_no, raw in lines:
        kind, uuid, parent = raw.get("type") or "", string(raw, "uuid"), string(raw, "parentUuid")
        side, stream = path_ix > 0 or raw.get("isSidechain") is True, 0
        if path_ix > 0:
            if path_ix not in file_stream:
                last_stream += 1
                file_stream[path_ix] = last_stream
            stream = file_stream[path_ix]
        elif side:
            stream = stream_of.get(parent, 0)
            if not stream:
                last_stream += 1
                stream = last_stream
            if uuid:
                stream_of[uuid] = stream
        where = {"at": (path_ix, line_no), "native_id": uuid, "parent": parent, "ts": string(raw, "timestamp"), "stream": stream}
        first = len(p.events)
        content = (raw.get("message") or {}).get("content") if isinstance(raw.get("message"), dict) else None
        blocks = content if isinstance(content, list) else [content]
        if kind == "user" and raw.get("isCompactSummary") is True:
            p.add("compaction_summary", text=flat_text(content), **where)
        elif kind in ("user", "assistant"):
            for b in blocks:
                t = b.get("type") if isinstance(b, dict) else None
                if kind == "user" and t == "tool_result":
                    call_id = string(b, "tool_use_id", "toolUseId") or ""
                    output = output_text(b.get("content")) or output_text(raw.get("toolUseResult"))
                    error = b.get("is_error") if isinstance(b.get("is_error"), bool) else None
                    if call_id in spawned:
                        p.add("subagent_result", sub_stream=spawned.pop(call_id), text=output, **where)
                    else:
                        p.add("tool_result", call_id=call_id, output=output, is_error=error, **where)
                elif kind == "assistant" and t == "tool_use":
                    name, call_id, args = string(b, "name") or "unknown", string(b, "id", "tool_use_id") or "", b.get("input")
                    if classify("tree", name) == "subagent":
                        last_stream += 1
                        spawned[call_id] = last_stream
                        p.add("subagent_spawn", sub_stream=last_stream, text=string(args, "prompt", "description", "task") or "", **where)
                    else:
                        _call(p, "tree", name, call_id, args, where)
                elif kind == "assistant" and t in ("thinking", "redacted_thinking"):
                    text = string(b, "thinking", "text") if t == "thinking" else None
                    p.add("reasoning", text=text, redacted=text is None, **where)
                elif (text := flat_text(b)).strip():
                    if kind == "user":
                        p.add("user_message", text=text, is_meta=raw.get("isMeta") is True or injected(text, OPENERS["tree"]), **where)
                    else:
                        p.add("assistant_text", text=text, phase="final", **where)
        elif kind == "system":
            p.add("system", subtype=string(raw, "subtype") or "system", text=string(raw, "content", "message", "text"), **where)
        elif kind == "summary":
            p.add("system", subtype="summary", text=string(raw, "summary"), **where)
        elif kind == "fork-context-ref":
            p.add("system", subtype="fork_context_ref", text=string(raw, "agentId", "parentLastUuid"), **where)
        else:
            p.notes.append(("unknown_kind", line_no, kind or "<missing type>"))
            p.add("unknown", text=compact_json(raw), **where)
        nodes.append({"id": uuid, "parent": parent, "other": string(raw, "logicalParentUuid"), "side": side, "talks": kind in ("user", "assistant"), "events": range(first, len(p.events))})
    leaf = next((n for n in reversed(nodes) if n["talks"] and not n["side"] and n["id"]), None)
    if leaf is None:
        return p, {e["idx"] for e in p.events}
    return p, _walk(p, nodes, leaf)


def _walk(p: Parsed, nodes: list[dict], leaf: dict) -> set[int]:
    """The events from a leaf to its root; a missing parent is bridged by the logical one, and noted if there is none."""
    by_id = {n["id"]: n for n in nodes if n["id"]}
    on_path, node = set(), leaf
    while node is not None and node["id"] not in on_path:
        on_path.add(node["id"])
        up = [x for x in (node["parent"], node.get("other")) if x]
        node_up = next((by_id[x] for x in up if x in by_id), None)
        if node_up is None and up:
            p.notes.append(("missing_parent", None, up[0]))
        node = node_up
    active, run = set(), 0
    for n in nodes:
        here = n["id"] in on_path
        loose = not n["id"] and any(p.events[i]["kind"] == "compaction_summary" for i in n["events"])
        if here or loose or n.get("outside"):
            active.update(n["events"])
        left = n["talks"] and not n["side"] and n["id"] and not here
        if left:
            run += 1
        if run and (here or n is nodes[-1]):
            p.notes.append(("abandoned_branch", None, f"{run} entries"))
            run = 0
    return active


def parse_rollout(lines: list[tuple[int, int, dict]]) -> tuple[Parsed, set[int]]:
    """Envelopes in order; a rollback drops the newest user turns with all that follows them."""
    p, asked = Parsed(), {}
    turns: list[list[int]] = [[]]  # events by user turn; the first list comes before any
    boundary: set[int] = set()

    for path_ix, line_no, raw in lines:
        kind = raw.get("type") or ""
        body = raw.get("payload") if isinstance(raw.get("payload"), dict) else {}
        where = {"at": (path_ix, line_no), "ts": string(raw, "timestamp")}
        first = len(p.events)
        if kind == "response_item":
            _rollout_item(p, body, where | {"native_id": string(body, "id")}, asked, boundary)
        elif kind == "event_msg":
            if "rolled_back" in (string(body, "type") or ""):
                p.add("rollback", num_turns=whole(body.get("num_turns"), 0) if whole(body.get("num_turns"), 0) is not None else 1, **where)
        elif kind == "compacted":
            text = string(body, "message", "summary", "text") or flat_text(body.get("replacement_history"))
            windowed = whole(body.get("window_number"), 0) is not None
            if text:
                p.add("compaction_summary", text=text, windowed=windowed, **where)
            else:
                p.add("system", subtype="native_compaction", windowed=windowed, **where)
        elif kind in ("token_usage_record", "world_state", "security_risk_score", "retained_context", "realtime_item", "turn_diff", "inter_agent_communication_metadata"):
            p.notes.append(("unknown_kind", line_no, kind))
        elif kind not in ("session_meta", "turn_context"):
            p.notes.append(("unknown_kind", line_no, kind or "<missing type>"))
            p.add("unknown", text=compact_json(raw), **where)
        for i in range(first, len(p.events)):
            if p.events[i]["kind"] == "rollback":
                n = p.events[i]["num_turns"]
                del turns[max(1, len(turns) - n) if n else len(turns) :]
            elif i in boundary:
                turns.append([i])
            else:
                turns[-1].append(i)
    return p, {i for t in turns for i in t}


def _rollout_item(p: Parsed, body: dict, where: dict, asked: dict[str, str], boundary: set[int]) -> None:
    kind = string(body, "type") or ""
    if kind == "message":
        text, role = flat_text(body.get("content")), string(body, "role") or ""
        if not text.strip() or role in ("developer", "system"):
            return
        if role == "user":
            meta = injected(text, OPENERS["rollout"])
            i = p.add("user_message", text=text, is_meta=meta, **where)
            if not meta:
                boundary.add(i)
        else:
            p.add("assistant_text", text=text, phase="commentary" if body.get("phase") == "commentary" else "final", **where)
    elif kind == "reasoning":
        text = next((t for k in ("summary", "content") if (t := flat_text(body.get(k))).strip()), None)
        p.add("reasoning", text=text, redacted=text is None, **where)
    elif kind in ("function_call", "custom_tool_call", "local_shell_call"):
        name, call_id = string(body, "name", "tool_name") or kind, string(body, "call_id", "id") or ""
        args = next((body[k] for k in ("arguments", "input", "action") if body.get(k) is not None), None)
        if isinstance(args, str):
            try:
                args = json.loads(args)
            except ValueError:
                pass
        if name == "request_user_input":
            each = [string(q, "question", "prompt", "text", "header") for q in args.get("questions", [])] if isinstance(args, dict) and isinstance(args.get("questions"), list) else []
            asked[call_id] = string(args, "question", "prompt", "message") or " · ".join(q for q in each if q) or flat_text(args)
        _call(p, "rollout", name, call_id, args, where)
    elif kind in ("function_call_output", "custom_tool_call_output"):
        call_id, value = string(body, "call_id", "id") or "", body.get("output")
        output, fields = output_text(value), value if isinstance(value, dict) else {}
        if call_id in asked:
            lists = [v.get("answers") for _, v in sorted(fields.get("answers", {}).items()) if isinstance(v, dict)] if isinstance(fields.get("answers"), dict) else []
            given = "; ".join(a for x in lists if isinstance(x, list) for a in x if isinstance(a, str))
            boundary.add(p.add("user_answer", question=asked.pop(call_id), answer=given or output, **where))
            return
        ok, error = fields.get("success"), body.get("is_error")
        is_error = not ok if isinstance(ok, bool) else error if isinstance(error, bool) else None
        p.add("tool_result", call_id=call_id, output=output, is_error=is_error, exit_code=whole(fields.get("exit_code")), **where)
    elif kind == "web_search_call":
        args = {"query": string(body, "query", "action") or ""}
        p.add("tool_call", call_id=string(body, "id") or "", tool_name=kind, tool_class="web", args=compact_json(args), **(where | {"native_id": None}))
    elif kind in ("compaction", "context_compaction"):
        p.add("system", subtype="native_compaction", **where)
    else:
        p.notes.append(("unknown_kind", where["at"][1], f"response_item:{kind}"))
        p.add("unknown", text=compact_json(body), **where)


def parse_journal(lines: list[tuple[int, int, dict]]) -> tuple[Parsed, set[int]]:
    """Entries linked by ``parentId`` from version 2 on; in order before."""
    p, nodes, version = Parsed(), [], 1
    for path_ix, line_no, raw in lines:
        kind = (raw.get("type") or "").replace("_", "").lower()
        own_id, parent = string(raw, "id", "entryId"), string(raw, "parentId", "parent")
        if kind == "session":
            version = whole(raw.get("version")) or 1
            continue
        where = {"at": (path_ix, line_no), "native_id": own_id, "parent": parent, "ts": string(raw, "timestamp", "time")}
        first = len(p.events)
        hidden = raw.get("excludeFromContext") is True
        if kind == "message":
            _journal_message(p, raw, where)
        elif kind == "bashexecution":
            if not hidden:
                code = next((c for k in ("exitCode", "exit_code") if (c := whole(raw.get(k))) is not None), None)
                value = raw.get("output") if raw.get("output") is not None else raw.get("result")
                p.add("shell_execution", command=string(raw, "command", "cmd") or "", output=output_text(value), exit_code=code, **where)
        elif kind in ("compaction", "compactionsummary"):
            p.add("compaction_summary", text=string(raw, "summary", "text", "message") or flat_text(raw.get("details")), **where)
        elif kind == "branchsummary":
            p.add("branch_summary", text=string(raw, "summary", "text") or "", **where)
        elif kind == "modelchange":
            p.add("model_change", model=string(raw, "model", "to") or "", **where)
        elif kind in ("custom", "custommessage"):
            if not hidden:
                p.add("system", subtype=string(raw, "customType", "custom_type", "subtype") or "custom", text=string(raw, "text", "content", "message"), **where)
        elif kind not in ("label", "sessioninfo"):
            p.notes.append(("unknown_kind", line_no, raw.get("type") or "<missing type>"))
            p.add("unknown", text=compact_json(raw), **where)
        events = range(first, len(p.events))
        nodes.append({"id": own_id, "parent": parent, "side": False, "talks": True, "events": events, "outside": not own_id})
    tree = [n for n in nodes if n["id"] and len(n["events"])]
    if version < 2 or not tree:
        return p, {e["idx"] for e in p.events}
    return p, _walk(p, nodes, tree[-1])


def _journal_message(p: Parsed, raw: dict, where: dict) -> None:
    message = raw.get("message") if isinstance(raw.get("message"), dict) else {}
    role, content = message.get("role") or "", message.get("content")
    if role == "user":
        text = flat_text(content)
        if text.strip():
            p.add("user_message", text=text, is_meta=message.get("isContext") is True or raw.get("isContext") is True, **where)
        return
    if role.replace("_", "").lower() == "toolresult":
        error = message.get("isError")
        p.add("tool_result", call_id=string(message, "toolCallId", "id") or "", output=output_text(content), is_error=error if isinstance(error, bool) else None, **where)
        return
    thought = string(message, "thinking", "reasoning")
    if thought or message.get("redactedThinking") is True:
        p.add("reasoning", text=thought, redacted=thought is None, **where)
    text = flat_text(content)
    if text.strip():
        p.add("assistant_text", text=text, phase="final", **where)
    calls = [message["toolCall"]] if message.get("toolCall") is not None else message.get("toolCalls")
    for c in calls if isinstance(calls, list) else []:
        if isinstance(c, dict):
            args = c.get("arguments") if c.get("arguments") is not None else c.get("input")
            _call(p, "journal", string(c, "name", "tool") or "", string(c, "id", "toolCallId") or "", args, where)


PARSERS: dict[str, Callable] = {"tree": parse_tree, "rollout": parse_rollout, "journal": parse_journal}


def parse_session(provider: str, lines: Iterator[tuple[int, int, str]], bad_line_rate: float | None = 0.02) -> tuple[Parsed, set[int]]:
    """Events, notes and the ordinals of the active events of one session's lines."""
    good, bad = [], []
    for path_ix, line_no, raw in lines:
        if not raw.strip():
            continue
        try:
            value = json.loads(raw)
            good.append((path_ix, line_no, value if isinstance(value, dict) else {}))
        except ValueError as why:
            bad.append((line_no, str(why)))
    p, active = PARSERS[provider](good)
    p.notes = [("bad_line", n, why) for n, why in bad] + p.notes
    if bad_line_rate is not None and bad and len(bad) / max(len(p.events), len(bad)) > bad_line_rate:
        raise TooManyBadLines(f"{len(bad)} of {len(good) + len(bad)} lines are unreadable")
    return p, active
