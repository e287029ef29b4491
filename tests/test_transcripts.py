"""The three transcript formats: events, live branches, ledgers and notes, on transcripts written here."""

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import events as E
from sessionloom.operators import fold, ledgers, masking, render, state
from sessionloom.plans import extract as plan
from sessionloom.sources import transcripts


def tree(uuid, parent, kind, content, **more):
    return {"type": kind, "uuid": uuid, "parentUuid": parent, "sessionId": "s-tree", "timestamp": f"2026-01-01T00:00:{uuid[1:]:0>2}Z", "message": {"role": kind, "content": content}, **more}


def use(call, name, **args):
    return {"type": "tool_use", "id": call, "name": name, "input": args}


def result(call, text, **more):
    return {"type": "tool_result", "tool_use_id": call, "content": text, **more}


TREE = [
    tree("n1", None, "user", "Please fix the parser. Never push to main."),
    tree("n2", "n1", "assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "Looking."}, use("t1", "Bash", command="cd /r && cargo test")]),
    tree("n3", "n2", "user", [result("t1", "error: it broke in /r/src/a.rs:12\nmore", is_error=True)]),
    tree("n4", "n3", "assistant", [use("t2", "Edit", file_path="src/parse/a.rs"), use("t3", "TodoWrite", todos=[{"content": "fix", "status": "in_progress"}])]),
    tree("n5", "n4", "user", [result("t2", "ok")]),
    tree("n6", "n5", "assistant", "abandoned words"),
    tree("n7", "n5", "user", "<command-name>x</command-name>"),
    tree("n8", "n7", "assistant", [use("t4", "Bash", command="cargo test"), use("t5", "Task", prompt="look around")]),
    tree("n9", "n8", "user", [result("t4", "fine", is_error=False), result("t5", "found it")]),
    tree("n10", "n9", "assistant", "side words", isSidechain=True),
]
ROLLOUT = [
    {"type": "session_meta", "timestamp": "t0", "payload": {"meta": {"id": "s-roll", "cwd": "/r"}}},
    *({"type": "response_item", "timestamp": "t", "payload": p} for p in (
        {"type": "message", "role": "developer", "content": [{"text": "rules"}]},
        {"type": "message", "role": "user", "content": [{"text": "first"}]},
        {"type": "message", "role": "assistant", "content": [{"text": "working"}], "phase": "commentary"},
        {"type": "message", "role": "user", "content": [{"text": "second"}]},
        {"type": "function_call", "name": "shell", "call_id": "c1", "arguments": '{"command": ["git", "commit", "-m", "x"]}'},
        {"type": "function_call_output", "call_id": "c1", "output": {"output": "[main abc1234] a subject", "exit_code": 0}},
    )),
    {"type": "event_msg", "timestamp": "t", "payload": {"type": "thread_rolled_back", "num_turns": 1}},
    *({"type": "response_item", "timestamp": "t", "payload": p} for p in (
        {"type": "function_call", "name": "request_user_input", "call_id": "q", "arguments": '{"question": "Which?"}'},
        {"type": "function_call_output", "call_id": "q", "output": {"answers": {"a": {"answers": ["this", "that"]}}}},
        {"type": "custom_tool_call", "name": "apply_patch", "call_id": "p", "input": "*** Begin Patch\n*** Add File: new.py\n*** Update File: old.py\n*** Move to: moved.py\n*** End Patch"},
    )),
    {"type": "compacted", "timestamp": "t", "payload": {"window_number": 1}},
]
JOURNAL = [
    {"type": "session", "version": 2, "id": "s-jour", "cwd": "/r"},
    {"type": "message", "id": "a", "message": {"role": "user", "content": "go"}},
    {"type": "bashExecution", "id": "b", "parentId": "a", "command": "make", "output": "FAILED badly", "exitCode": 2},
    {"type": "message", "id": "x", "parentId": "a", "message": {"role": "assistant", "content": "other branch"}},
    {"type": "message", "id": "c", "parentId": "b", "message": {"role": "assistant", "content": "done", "toolCalls": [{"id": "k", "name": "read", "arguments": {"path": "a.py"}}]}},
    {"type": "custom", "customType": "note", "text": "outside the tree"},
]


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    for name, lines in (("tree", TREE), ("rollout-2026-01-01-1-2-3-4-5", ROLLOUT), ("1_journal", JOURNAL)):
        (d / f"{name}.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    return str(d)


@pytest.fixture(scope="module")
def found(spark, store):
    return E.events(transcripts.raw_lines(spark, store)).withColumn("name", F.regexp_extract("session_key", "[^/]*$", 0)).cache()


def of(found, name):
    return [r.asDict() for r in found.where(F.startswith("name", F.lit(name))).orderBy("idx").collect()]


def test_sniffing_and_summaries(spark, store):
    rows = {r["agent"]: r for r in transcripts.summaries(transcripts.raw_lines(spark, store)).collect()}
    assert set(rows) == {"tree", "rollout", "journal"}
    assert rows["tree"]["id"] == "s-tree" and rows["tree"]["first_message"].startswith("Please fix") and rows["journal"]["cwd"] == "/r"
    assert rows["tree"]["n_lines"] == len(TREE) and rows["rollout"]["id"] == "s-roll"
    hashes = transcripts.source_hash(transcripts.raw_lines(spark, store)).collect()
    assert len(hashes) == 3 and all(len(r["source_hash"]) == 64 for r in hashes)


def test_references(spark, store):
    s = transcripts.summaries(transcripts.raw_lines(spark, store)).cache()
    assert transcripts.resolve(s, "s-tree").first()["agent"] == "tree"
    assert transcripts.matching(s, query="FIX THE").count() == 1 and transcripts.matching(s, project="/none").count() == 3
    with pytest.raises(LookupError):
        transcripts.resolve(s, "nothing-like-this")
    with pytest.raises(ValueError, match="six"):
        transcripts.resolve(s, "abc")


def test_tree(found):
    rows = of(found, "tree")
    kinds = [r["kind"] for r in rows]
    assert kinds == ["user_message", "reasoning", "assistant_text", "tool_call", "tool_result", "tool_call", "tool_call", "plan_update", "tool_result", "assistant_text", "user_message", "tool_call", "subagent_spawn", "tool_result", "subagent_result", "assistant_text"]
    assert [r["idx"] for r in rows if not r["is_active"]] == [9, 15]
    assert rows[10]["is_meta"] and not rows[0]["is_meta"] and rows[15]["stream"] == 2 and rows[12]["sub_stream"] == rows[14]["sub_stream"] == 1


def test_rollout(found):
    rows = of(found, "rollout")
    assert [r["kind"] for r in rows] == ["user_message", "assistant_text", "user_message", "tool_call", "tool_result", "rollback", "tool_call", "user_answer", "tool_call", "system"]
    assert [r["idx"] for r in rows if r["is_active"]] == [0, 1, 6, 7, 8, 9]
    assert (rows[7]["question"], rows[7]["answer"]) == ("Which?", "this; that") and rows[9]["windowed"] and rows[4]["exit_code"] == 0
    assert E.since_compaction(found.where("name LIKE 'rollout%'")).count() == 1


def test_journal(found):
    rows = of(found, "1_journal")
    assert [(r["kind"], r["is_active"]) for r in rows] == [("user_message", True), ("shell_execution", True), ("assistant_text", False), ("assistant_text", True), ("tool_call", True), ("system", True)]


def test_notes_and_bad_lines(spark, store, tmp_path):
    notes = E.diagnostics(transcripts.raw_lines(spark, store)).collect()
    assert sum(r["kind"] == "abandoned_branch" for r in notes) == 2
    (tmp_path / "bad.jsonl").write_text(json.dumps(TREE[0]) + "\n{\n{\n")
    with pytest.raises(Exception, match="unreadable"):
        E.events(transcripts.raw_lines(spark, str(tmp_path))).collect()
    assert E.events(transcripts.raw_lines(spark, str(tmp_path)), None).count() == 1
    assert E.violations(E.events(transcripts.raw_lines(spark, store))).count() == 0


def test_ledgers(found):
    runs = ledgers.commands(found).cache()
    tree_runs = runs.where("session_key LIKE '%/tree'").orderBy("evt").collect()
    assert [(r["normalized"], r["category"], r["status"]) for r in tree_runs] == [("cargo test", "test", "FAILED"), ("cargo test", "test", "ok")]
    errors = {r["session_key"].rsplit("/", 1)[-1]: r for r in ledgers.errors(found, runs).collect()}
    assert errors["tree"]["status"] == "resolved" and errors["tree"]["command"] == "cargo test" and errors["1_journal"]["status"] == "unresolved"
    files = {(r["session_key"].rsplit("/", 1)[-1], r["path"]): r for r in ledgers.files(found).collect()}
    assert files["tree", "src/parse/a.rs"]["edits"] == 1 and files["1_journal", "a.py"]["reads"] == 1
    roll = {p: f for (s, p), f in files.items() if s.startswith("rollout")}
    assert roll["new.py"]["created"] and roll["new.py"]["edits"] == 2 and roll["old.py"]["moved_to"] == "moved.py"
    assert ledgers.plan(found).where("session_key LIKE '%/tree'").first()["items"][0]["status"] == "in_progress"
    assert ledgers.edit_outcomes(found).where("path = 'src/parse/a.rs'").first()["last_edit_succeeded"]


def test_git_ledger(spark):
    runs = spark.createDataFrame([("s", 1, "git commit -m x", "git", False, "[main abc1234] a subject", ""), ("s", 2, "git switch -c topic", "git", False, "", ""), ("s", 3, "git push", "git", False, "see https://h/x/pull/7.", "")], "session_key string, evt int, normalized string, category string, failed boolean, output_head string, output_tail string")
    commits, facts = ledgers.git(runs)
    assert [(r["sha"], r["subject"]) for r in commits.collect()] == [("abc1234", "a subject")]
    f = facts.first()
    assert f["branches"] == ["topic"] and f["pull_requests"] == ["https://h/x/pull/7"] and f["pushed"]


def test_shell_operations(spark):
    df = spark.createDataFrame([(c,) for c in ("rm -rf build/x.js", "echo hi > notes.txt", "cargo test", "git mv a.py b.py && touch c", "ls 2>&1")], "c string")
    got = [[(o["path"], o["op"]) for o in r["o"]] for r in df.select(ledgers.shell_ops(F.col("c")).alias("o")).collect()]
    assert got == [[("build/x.js", "delete")], [("notes.txt", "create")], [], [("a.py", "move"), ("b.py", "create"), ("c", "create")], []]


def test_extract(spark, store, tmp_path):
    tables = plan.extract(spark, store, plan.Options(min_episode=1))
    doc = {r["session_key"].rsplit("/", 1)[-1]: r["markdown"] for r in tables["document"].collect()}
    assert "- Never push to main" in doc["tree"] and "src/parse/a.rs" in doc["tree"] and "FAILED" in doc["1_journal"]
    rows = tables["masked_rows"].groupBy("session_key").agg(F.sum("tokens").alias("t")).collect()
    parts = tables["episodes"].groupBy("session_key").agg(F.sum("tokens").alias("t")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, parts))
    tables["events"].unpersist()


def test_state_checks_and_replay(spark):
    ops = [
        {"op": "add", "kind": "constraint", "text": "Never push", "quote": "never push to main", "sources": [[1, 1]]},
        {"op": "add", "kind": "constraint", "text": "Invented", "quote": "not said", "sources": [[1, 1]]},
        {"op": "add", "kind": "goal", "text": "One", "sources": [[1, 2]]},
        {"op": "add", "kind": "goal", "text": "Far", "sources": [[50, 60]]},
    ]
    more = [{"op": "drop", "id": "C1", "reason": "x"}, {"op": "add", "kind": "goal", "text": "Two", "sources": [[3, 3]]}, {"op": "confirm", "id": "C1", "evt": 4}, {"op": "resolve", "id": "G9", "evt": 4}, {"op": "add", "kind": "constraint", "text": "never  push!", "quote": "Never push", "sources": [[4, 4]]}]
    rows = [("s", "c0", 0, 2, [1, 2], ["Please never push to main."], [], json.dumps({"ops": ops})), ("s", "c1", 3, 5, [3, 4], ["Please never push to main."], [], "```json\n" + json.dumps(more) + ",\n```")]
    b = spark.createDataFrame(rows, "session_key string, chunk string, evt_start int, evt_end int, visible array<int>, human array<string>, paths array<string>, ops string")
    items = {r["id"]: r for r in state.items(b).collect()}
    assert set(items) == {"C1", "G1", "G2"} and items["G1"]["status"] == "superseded" and items["G1"]["detail"] == "G2"
    assert [tuple(s) for s in items["C1"]["sources"]] == [(1, 1), (4, 4)] and items["C1"]["last_confirmed"] == 4
    refused = [(r["chunk"], r["op_index"]) for r in state.rejections(b).orderBy("chunk", "op_index").collect()]
    assert refused == [("c0", 1), ("c0", 3), ("c1", 0), ("c1", 3)]


def test_repair():
    good = [{"op": "drop", "id": "G1"}]
    for text in ('{"ops": [{"op": "drop", "id": "G1"}]}', 'Sure:\n```json\n[{"op": "drop", "id": "G1",}]\n```', '{"ops": [{"op": "drop", "id": "G1"', '[{"op":"drop","id":"G1'):
        assert fold.repaired(text) == good
    assert fold.repaired("nothing") == [] and fold.repaired("{{{") == []


def test_reconcile(spark):
    files = spark.createDataFrame([("s", "a.py", False, 1, False), ("s", "b.py", True, 0, False), ("s", "c.py", False, 1, False), ("s", "d.py", False, 1, False), ("s", "e.py", True, 0, True)], "session_key string, path string, deleted boolean, edits int, inferred boolean")
    there = spark.createDataFrame([("s", "a.py"), ("s", "b.py"), ("s", "d.py")], "session_key string, path string")
    got = {r["path"]: r["finding"] for r in state.reconcile(files, there, there.where("path = 'd.py'")).collect()}
    assert got == {"a.py": "known", "b.py": "contradicted", "c.py": "missing", "d.py": "changed"}


def test_tables_written_and_read_back(spark, store, tmp_path):
    tables = {k: v for k, v in plan.extract(spark, str(store)).items() if k in ("files", "commands", "plan", "messages")}
    known = plan.schemas(tables)
    whole = plan.projected(tables)
    key = lambda rows: sorted(map(str, rows))
    for form in ("parquet", "json"):
        plan.write(tables, str(tmp_path / form), form)
        again = plan.read_back(spark, str(tmp_path / form), known, form)
        for name, df in tables.items():
            assert key(again[name].select(df.columns).collect()) == key(df.collect())
    for name, df in tables.items():
        assert df.count() and key(plan.unprojected(whole, name, known[name]).select(df.columns).collect()) == key(df.collect())


def test_layers_of_a_document():
    assert render.layers("l2, L0,,") == ["brief", "tail"]
    assert render.layers("") == []
    with pytest.raises(ValueError):
        render.layers("L0,L9")


def test_ranges_of_an_item(spark):
    df = spark.createDataFrame([(1, [(5, 2), (7, 7)]), (2, [])], "id int, sources array<struct<start:int,end:int>>")
    got = {r[0]: r[1:] for r in df.select("id", state.provenance(F.col("sources")), state.span(F.col("sources"))).collect()}
    assert got[1][0] == "[evt 2–5, evt 7]" and tuple(got[1][1]) == (2, 7)
    assert got[2] == ("", None)


def test_edit_rows_have_statistics(spark):
    df = spark.createDataFrame([('{"new_string":"a\\nb\\n","old_string":""}',), ('{"content":"a"}',), ('{"path":"x"}',), (None,)], "args string")
    assert [r[0] for r in df.select(masking.edit_stat(F.col("args"))).collect()] == [" (+2 −0)", " (+1)", "", ""]
