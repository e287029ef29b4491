"""The adapters' expressions, windows and walks against the plain version, one session after the other, on random and odd lines."""

import json
import random

import plain_events
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import events as E
from sessionloom.operators import live
from sessionloom.operators.steps import Steps, new_folder

LINES = "session_key string, path_ix int, line_no int, raw string"
TEXTS = ["hello", "  padded ", "", "é\n<b>x</b>", "<command-name>x</command-name>", "Caveat: The messages below were generated by", "# AGENTS.md instructions for you", " \n\t"]


def content(rng, depth=0):
    k = rng.randrange(8 if depth < 3 else 3)
    text = rng.choice(TEXTS)
    if k < 3:
        return text
    if k == 3:
        return rng.choice([None, 5, True, {}, []])
    if k < 6:
        return {"type": "text", rng.choice(["text", "thinking", "content"]): content(rng, depth + 1)} if rng.random() < 0.7 else {"type": "text", "text": text}
    return [content(rng, depth + 1) for _ in range(rng.randrange(4))]


def args(rng):
    return rng.choice([None, {}, "plain", {"command": "ls", "b": [1, {"a": None}]}, {"todos": [{"content": "x", "status": "done"}, {"text": ""}, "odd"]}, {"plan": [{"step": "s"}]}, {"items": [{"title": "t", "state": "open"}]}, {"prompt": "look"}])


def tree_lines(rng, n):
    out = []
    for k in range(n):
        ids = [f"u{i}" for i in range(max(0, k - 4), k + 2)] + ["lost", None, ""]
        line = {"type": rng.choice(["user", "assistant", "user", "assistant", "system", "summary", "progress", "fork-context-ref", None]), "uuid": f"u{k}" if rng.random() < 0.9 else rng.choice([None, "u1"]), "parentUuid": f"u{k - 1}" if rng.random() < 0.7 and k else rng.choice(ids), "timestamp": f"t{k}"}
        if rng.random() < 0.2:
            line["logicalParentUuid"] = rng.choice(ids)
        if rng.random() < 0.25:
            line["isSidechain"] = rng.choice([True, True, False, "yes"])
        if rng.random() < 0.1:
            line |= {"isCompactSummary": True, "isMeta": True}
        blocks = []
        for _ in range(rng.randrange(4)):
            call = rng.choice(["c1", "c2", "c3", ""])
            blocks.append(rng.choice([
                {"type": "tool_result", "tool_use_id": call, "content": content(rng), "is_error": rng.choice([True, False, None, "x"])}, {"type": "tool_use", "id": call, "name": rng.choice(["Task", "agent", "Bash", "TodoWrite", "mcp__x", "zzz"]), "input": args(rng)},
                {"type": "thinking", "thinking": rng.choice(["hm", ""])}, {"type": "redacted_thinking", "data": "x"}, content(rng),
            ]))
        line["message"] = rng.choice([{"content": blocks}, {"content": blocks}, {"content": content(rng)}, None, "odd"])
        line |= rng.choice([{}, {"subtype": "x", "content": "words"}, {"summary": "s"}, {"agentId": "a"}, {"toolUseResult": {"stdout": 1}}])
        out.append((1 + k % 2 if rng.random() < 0.15 else 0, line))
    return [(0, {"type": "user", "uuid": "first", "sessionId": "s", "message": {"content": "start"}})] + out


def rollout_lines(rng, n):
    out = [(0, {"type": "session_meta", "timestamp": "t", "payload": {"id": "s"}})]
    for k in range(n):
        call = rng.choice(["c1", "c2", "c3"])
        item = rng.choice([
            {"type": "message", "role": rng.choice(["user", "user", "assistant", "developer"]), "content": content(rng), "phase": rng.choice(["commentary", None]), "id": f"i{k}"},
            {"type": "message", "role": "user", "content": [{"text": f"wish {k}"}]},
            {"type": "reasoning", "summary": content(rng), "content": content(rng)},
            {"type": rng.choice(["function_call", "custom_tool_call", "local_shell_call"]), "name": rng.choice(["shell", "update_plan", "request_user_input", "request_user_input", None]), "call_id": call, "arguments": rng.choice(['{"question": "Which?"}', '{"questions": [{"header": "H"}, {"prompt": "P"}, 3]}', "not json", None]), "input": args(rng)},
            {"type": "function_call_output", "call_id": call, "output": rng.choice(["done", {"output": "x", "exit_code": 3, "success": False}, {"answers": {"b": {"answers": ["1", 2]}, "a": {"answers": ["0"]}}}, None, [{"text": "part"}]]), "is_error": rng.choice([True, None])},
            {"type": "web_search_call", "query": "q", "id": "w"}, {"type": "compaction"}, {"type": "strange", "x": 1}, {},
        ])
        line = {"type": "response_item", "timestamp": f"t{k}", "payload": item}
        if rng.random() < 0.2:
            line = {"type": "event_msg", "timestamp": "t", "payload": {"type": rng.choice(["thread_rolled_back", "other"]), "num_turns": rng.choice([0, 1, 1, 2, 5, None, -1, "2"])}}
        if rng.random() < 0.1:
            line = rng.choice([{"type": "compacted", "payload": {"message": "sum", "window_number": 1}}, {"type": "compacted", "payload": {"replacement_history": content(rng)}}, {"type": "world_state"}, {"type": "new_kind"}, {"type": "turn_context"}])
        out.append((0, line))
    return out


def journal_lines(rng, n):
    out = [(0, {"type": "session", "version": rng.choice([1, 2, 3, "x"]), "id": "s"})]
    for k in range(n):
        ids = [f"e{i}" for i in range(max(0, k - 4), k)] + ["lost", None]
        line = {"type": rng.choice(["message", "message", "message", "bashExecution", "compaction_summary", "branchSummary", "modelChange", "custom", "label", "weird"]), "id": f"e{k}" if rng.random() < 0.9 else None, "parentId": f"e{k - 1}" if rng.random() < 0.6 and k else rng.choice(ids), "time": "t"}
        calls = [rng.choice([{"id": "k", "name": rng.choice(["read", "todo_write"]), "arguments": args(rng)}, {"tool": "x", "input": args(rng)}, "odd"]) for _ in range(rng.randrange(3))]
        message = {"role": rng.choice(["user", "assistant", "toolResult", "tool_result"]), "content": content(rng), "isError": rng.choice([True, None]), "isContext": rng.choice([True, False]), "toolCallId": "k"}
        message |= rng.choice([{}, {"toolCalls": calls}, {"toolCall": {"name": "bash", "arguments": args(rng)}}, {"thinking": "hm"}, {"redactedThinking": True}])
        line |= {"message": rng.choice([message, message, None]), "excludeFromContext": rng.choice([True, False, None]), "command": "make", "output": content(rng), "exitCode": rng.choice([0, 2, "x"]), "text": rng.choice(["words", ""]), "model": "m"}
        out.append((0, line))
    return out


MAKE = {"tree": tree_lines, "rollout": rollout_lines, "journal": journal_lines}


def sessions(provider, seeds):
    out = {}
    for seed in seeds:
        rng = random.Random(f"{provider}{seed}")
        made = [(ix, json.dumps(line)) for ix, line in MAKE[provider](rng, rng.randrange(1, 40))]
        if rng.random() < 0.5:
            made[len(made) // 2 : len(made) // 2] = [(0, ""), (0, "{broken"), (0, "[1]"), (0, "  ")]
        numbered, at = [], {}
        for ix, raw in made:
            at[ix] = at.get(ix, 0) + 1
            numbered.append((ix, at[ix], raw))
        out[f"{provider}-{seed}"] = sorted(numbered, key=lambda r: r[:2])
    return out


def as_json(value):
    """Order of keys and numbers aside: the arguments of a call are JSON texts."""
    try:
        return json.loads(value)
    except (TypeError, ValueError):
        return value


@pytest.mark.parametrize("provider", sorted(MAKE))
def test_adapter_is_the_plain_version(spark, provider):
    found = sessions(provider, range(25))
    df = spark.createDataFrame([(s, *r) for s, rows in found.items() for r in rows], LINES).repartition(5)
    names = [c.split()[0] for c in E.SCHEMA.replace("plan array<struct<text:string,status:string>>", "plan x").split(",")]
    want, notes = {}, set()
    for s, rows in found.items():
        p, active = plain_events.parse_session(provider, rows, None)
        for e in p.events:
            row = {"session_key": s, "is_active": e["idx"] in active} | {c: e.get(c) for c in names if c not in ("session_key", "is_active")}
            want[s, e["idx"]] = row | {"plan": [tuple(x) for x in row["plan"]] if row["plan"] else None, "args": as_json(row["args"])}
        notes |= {(s, k, n, m if k != "bad_line" else "not JSON") for k, n, m in p.notes}
    got = {}
    for r in E.events(df, None).collect():
        row = r.asDict()
        got[r["session_key"], r["idx"]] = row | {"plan": [tuple(x) for x in row["plan"]] if row["plan"] else None, "args": as_json(row["args"])}
    assert got.keys() == want.keys()
    for k, row in want.items():
        for c in names:
            have = got[k][c]
            if c in ("text", "output") and row["kind"] in ("unknown", "tool_result", "subagent_result", "user_answer", "shell_execution"):
                assert as_json(have) == as_json(row[c]), (k, c)
            elif c in ("is_meta", "redacted", "windowed"):
                assert bool(have) == bool(row[c]), (k, c)
            else:
                assert have == row[c], (k, c, row["kind"], have, row[c])
    assert {tuple(r)[:4] for r in E.diagnostics(df).collect()} == notes


def test_long_chains_and_circles(spark):
    """A chain of 3,000 entries with many branches, and circles: the walk ends and marks what a walk one by one would."""
    rng = random.Random(2)
    up = {("a", k): k - 1 if rng.random() < 0.9 else rng.randrange(k) for k in range(1, 3000)}
    up |= {("b", 0): 3, ("b", 1): 0, ("b", 2): 1, ("b", 3): 2, ("b", 4): 2, ("c", 0): 0, ("c", 1): 0}
    rows = [("a", "0", 0, None)] + [(s, str(k), k, str(u)) for (s, k), u in up.items()]
    leaves = [("a", "2999"), ("b", "4"), ("c", "1")]
    want = set()
    for s, leaf in leaves:
        at = int(leaf)
        while at is not None and (s, str(at)) not in want:
            want.add((s, str(at)))
            at = up.get((s, at))
    steps = Steps(spark, new_folder(spark, "test"))
    got = live.on_path(spark.createDataFrame(rows, "session_key string, id string, pos int, up string"), spark.createDataFrame(leaves, "session_key string, id string"), steps)
    assert {tuple(r) for r in got.collect()} == want and steps.made < 40


def test_turns_are_a_stack(spark):
    """Random starts and rollbacks against a list of lists."""
    rng = random.Random(6)
    rows, want = [], set()
    for s in range(30):
        turns = [[]]
        for k in range(rng.randrange(60)):
            back = rng.choice([None] * 6 + [0, 1, 2, 9])
            starts = back is None and rng.random() < 0.4
            rows.append((s, k, starts, back))
            if back is not None:
                del turns[max(1, len(turns) - back) if back else len(turns) :]
            elif starts:
                turns.append([k])
            else:
                turns[-1].append(k)
        want |= {(s, k) for t in turns for k in t}
    df = spark.createDataFrame(rows, "session_key int, k int, starts boolean, back int")
    got = live.with_survivors(df, F.col("starts"), F.col("back"), ["k"]).where("survives").select("session_key", "k")
    assert {tuple(r) for r in got.collect()} == want
