"""Ledgers that several plans read are made once."""

import os

import pytest
from pyspark.sql import functions as F

from sessionloom import queries as core
from sessionloom import queries_document
from sessionloom.functions import text as X
from sessionloom.operators import finish, joins, ledgers
from sessionloom.operators.events import SCHEMA

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@here
def test_a_stored_state_reads_the_files_made_once(spark, monkeypatch):
    seen, verify = [], finish.verify

    def watched(spark, path, files, snapshot, changed, *more):
        seen.extend([files, snapshot, changed])
        return verify(spark, path, files, snapshot, changed, *more)

    monkeypatch.setattr(finish, "verify", watched)
    core.QUERIES["verified_again"](spark, SF)
    assert len(seen) == 3 and not any("Window" in plan(df) for df in seen)


@here
def test_findings_read_the_ledgers_made_once(spark):
    # the sessions, of calls and of results, are made for their keys and for the errors
    assert plan(core.QUERIES["findings_of_sessions"](spark, SF)).count("unix_micros") <= 4


def test_file_operations_of_command_lines(spark):
    lines = ["rm -rf a b 'c d'", "git mv x.py y.py", "cp a b; touch \"q\"", "mv a", "echo hi > out.log && ls", "ls 2>&1 >x", "a > b.c > d.e", "git rm", "arm x", "", "rm", "cargo test", "cat <<E >\n o.txt", None]
    got = [None if r[0] is None else [(o["path"], o["op"]) for o in r[0]] for r in spark.createDataFrame([(c,) for c in lines], "c string").select(ledgers.shell_ops(F.col("c"))).collect()]
    assert got == [[("a", "delete"), ("b", "delete"), ("c", "delete"), ("d", "delete")], [("x.py", "move"), ("y.py", "create")], [("b", "create"), ("q", "create")], [("a", "move")], [("out.log", "create")], [], [("b.c", "create")], [], [], [], [], [], [], None]


def test_words_of_commands_are_made_once(spark):
    df = spark.createDataFrame([("cd /w && PW=1 pytest -q",), ("",), (None,)], "c string").select(X.normalize_command(F.col("c")).alias("n"), X.categorize(F.col("c")).alias("k"))
    assert [tuple(r) for r in df.collect()][:2] == [("PW=*** pytest -q", "other"), ("", "other")]
    assert plan(df).count("(?s)^(?:cd ") == 2


def test_a_call_is_pending_for_the_next_row_alone(spark):
    rows = [("a", k, kind) for k, kind in enumerate("rccrrcbrc")] + [("b", 0, "c"), ("b", 1, "x"), ("b", 2, "r"), ("c", 0, "c"), ("c", 1, None), (None, 0, "c"), (None, 1, "r")]
    df = spark.createDataFrame(rows, "k string, at int, kind string")
    paired = joins.pair_once(df, F.col("kind").isin("c", "b"), F.col("kind").isin("r", "b"), ["k"], ["at"], ["kind"])
    got = sorted((str(r["k"]), r["call"]["at"], r["call"]["kind"], r["result"]["at"], r["result"]["kind"]) for r in paired.collect())
    assert got == [("None", 0, "c", 1, "r"), ("a", 2, "c", 3, "r"), ("a", 6, "b", 6, "b"), ("b", 0, "c", 2, "r")]
    # one window, no rows collected by an aggregate behind it
    assert "Aggregate" not in plan(paired)


def test_paths_and_commands_whatever_their_keys_are_written_by(spark):
    patch = "*** Begin Patch\\n*** Update File: p.py\\n*** Move to: q.py\\n*** Delete File: r.py"
    args = [
        ("read", '{"file_path": "", "path": "a.py"}'),
        ("read", '{"\\u0070ath": "b.py"}'),
        ("read", '{"x": "path"}'),
        ("edit", '{"file": "c.py", "edits": [{"path": "d.py"}, {"file": "c.py"}]}'),
        ("edit", '{"\\u0065dits": [{"path": "e.py"}]}'),
        ("edit", f'{{"input": "{patch}"}}'),
        ("edit", f'{{"input": "{patch}"}}'.replace("*", "\\u002a")),
        ("edit", f'"{patch}"'),
        ("edit", None),
        ("shell", '{"\\u0063md": ["rm", "f.py"]}'),
        ("shell", '"touch g.py"'),
        ("shell", '{"script": 1}'),
    ]
    known = {"session_key": F.lit("s"), "is_active": F.lit(True), "kind": F.lit("tool_call"), "idx": F.col("k"), "tool_class": F.col("c"), "args": F.col("a")}
    own = spark.createDataFrame([(k, c, a) for k, (c, a) in enumerate(args)], "k int, c string, a string")
    events = own.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], SCHEMA).schema])
    got = {}
    for r in ledgers.file_ops(events).orderBy("evt", "seq").collect():
        got.setdefault(r["evt"], []).append((r["path"], r["op"], r["moved_to"]))
    patched = [("p.py", "edit", None), ("r.py", "edit", None), ("p.py", "move", "q.py"), ("r.py", "delete", None)]
    assert got == {0: [("a.py", "read", None)], 1: [("b.py", "read", None)], 3: [("c.py", "edit", None), ("d.py", "edit", None)], 4: [("e.py", "edit", None)], 5: patched, 6: patched, 7: patched, 9: [("f.py", "delete", None)], 10: [("g.py", "create", None)]}


@here
def test_ledgers_make_what_is_read(spark):
    # the results of calls are no part of the files' plan, errors are looked up once
    found = core.tool_sessions(spark, SF)
    assert plan(ledgers.files(found)).count("Window") == 1
    runs = spark.createDataFrame([], "session_key string, evt int, normalized string, failed boolean")
    assert plan(ledgers.errors(found, runs)).count("sha2(") == 1
    made = queries_document._ledgers(spark, SF, "commands", "files")
    assert [df.columns for df in made] == [queries_document.READ[n] for n in ("commands", "files")]
