"""Facts on whole sessions and the rankings and budgets over them."""

import json

from pyspark.sql import functions as F

from sessionloom import queries
from sessionloom.operators import evaluation, render
from sessionloom.operators import sessions as S


def test_meta(spark):
    lines = [
        ("s", 0, 1, '{"type":"user","sessionId":"x","cwd":"/r","gitBranch":"main","timestamp":"2"}'),
        ("s", 0, 2, '{"type":"summary","summary":"first"}'),
        ("s", 0, 3, '{"type":"assistant","cwd":"/other","timestamp":"1","message":{"model":"m2"}}'),
        ("s", 0, 4, '{"type":"summary","summary":"last"}'),
        ("s", 0, 5, '{"type":"assistant","message":{"model":"m1"}}'),
    ]
    r = S.meta(spark.createDataFrame(lines, "session_key string, path_ix int, line_no int, raw string")).first()
    assert (r["id"], r["cwd"], r["git_branch"], r["title"], r["models"], r["started_at"], r["ended_at"]) == ("x", "/r", "main", "last", ["m1", "m2"], "1", "2")


def test_budgeted_items_skip_what_does_not_fit(spark):
    rows = [("s", "C1", "constraint", "a" * 20, "active"), ("s", "G1", "goal", "b" * 400, "active"), ("s", "D1", "decision", "c" * 20, "active"), ("s", "D2", "decision", "gone", "dropped")]
    df = spark.createDataFrame(rows, "session_key string, id string, kind string, text string, status string")
    r = render.budgeted(df, 20).first()
    assert r["shown"] == "- [C1] " + "a" * 20 + "\n- [D1] " + "c" * 20 and r["omitted"] == ["G1"]


def test_findings(spark):
    counts = S.finding_counts(spark.createDataFrame([("s", "missing"), ("s", "known"), ("s", "known")], "session_key string, finding string"))
    n = spark.createDataFrame([("s", 2)], "session_key string, n long")
    errors = spark.createDataFrame([("s", "x", "unresolved"), ("s", "y", "resolved")], "session_key string, sig string, status string")
    got = {r["label"]: r["text"] for r in S.findings(counts, n, n.limit(0), errors).collect()}
    assert got == {"repo_moved": "2 commits since the session", "missing": "1 files are gone", "stale": "much of it is stale", "unresolved": "1 errors are open"}


def test_items_against_evidence(spark):
    items = spark.createDataFrame([("s", "C1", "see src/a.rs", "never push", [(1, 2)]), ("s", "C2", "see src/no.rs", "not said", [(7, 9)])], "session_key string, id string, text string, quote string, sources array<struct<start:int,end:int>>")
    said = spark.createDataFrame([("s", "Please, never push!")], "session_key string, text string")
    paths = spark.createDataFrame([("s", "/r/src/a.rs")], "session_key string, path string")
    rows = spark.createDataFrame([("s", 2)], "session_key string, evt int")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(S.quoted_items(items, said)) == ["C1"] and ids(S.unknown_paths(items, paths)) == ["C2"] and ids(S.visible_sources(items, rows)) == ["C1"]


def test_browse(spark):
    rows = [("a", "tree", "abc123", "fix parser", None, "/r", "2026-01-02T00:00:00Z"), ("b", "rollout", "def", "other", "parse this", "/q", "2025-01-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "session_key string, agent string, id string, title string, first_message string, cwd string, ended_at string")
    keys = lambda **k: [r["session_key"] for r in S.browse(df, **k).collect()]
    assert keys(query="pars") == ["a", "b"] and keys(query="def") == ["b"] and keys(agent="tree") == ["a"] and keys(recency="week", now="2026-01-05 00:00:00") == ["a"]


def test_answers(spark):
    df = spark.createDataFrame([("It is  SRC/a.rs!", "src/a.rs"), ("no", "src/a.rs"), ("x", "")], "a string, k string")
    assert [r[0] for r in df.select(evaluation.correct(F.col("a"), F.col("k"))).collect()] == [True, False, False]
    e = spark.createDataFrame([("EXPAND 3..5 and EXPAND 9",)], "a string").select(evaluation.expansions(F.col("a")).alias("e")).first()["e"]
    assert [(x["start"], x["end"]) for x in e] == [(3, 4), (9, 9)]
    asked = spark.createDataFrame([("s", 1, "deep", "Which?", "this")], "session_key string, evt int, class string, question string, key string")
    plan = evaluation.arms_by_questions(spark.createDataFrame([("none",), ("tail",)], "arm string"), asked)
    assert {(r["arm"], r["answer"]) for r in evaluation.trials(plan, lambda arm, q: f"{arm} {q}").collect()} == {("none", "none Which?"), ("tail", "tail Which?")}


def test_accounting(spark):
    rows = spark.createDataFrame([("s", 10), ("s", 5)], "session_key string, tokens long")
    lines = spark.createDataFrame([("s", "x" * 39)], "session_key string, raw string")
    r = S.token_accounting(lines, rows, rows.limit(1)).first()
    assert (r["raw"], r["masked"]) == (10, 15)


def test_item_ids_of_any_number_of_kinds(spark, tmp_path):
    kinds = [f"{chr(97 + k % 26)}{k}" for k in range(1100)]
    rows = [(k % 3, i, f"2024-01-01 00:{i // 60 % 60:02}:{i % 60:02}", kinds[k]) for i, k in enumerate([*range(1100), *range(0, 1100, 2)])]
    events = spark.createDataFrame(rows, "user_id long, event_id long, ts string, event_type string")
    events.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["item_ids"](spark, str(tmp_path)).collect()
    expected = sorted((k % 3, f"{kinds[k][0].upper()}{n}") for k in range(1100) for n in ((1, 2) if k % 2 == 0 else (1,)))
    assert sorted((r["user_id"], r["id"]) for r in got) == expected


def test_no_arm_is_left_out(spark):
    arms = spark.createDataFrame([(f"arm{k}",) for k in range(150)], "arm string")
    asked = spark.createDataFrame([(1,), (2,)], "question_id int")
    got = evaluation.arms_by_questions(arms, asked).collect()
    assert sorted((r["arm"], r["question_id"]) for r in got) == sorted((f"arm{k}", q) for k in range(150) for q in (1, 2))


def test_malformed_operations_are_refused(spark):
    from sessionloom.operators import state

    source = {"start": 1, "end": 2}
    odd = [
        {"op": "drop"}, {"op": "confirm", "id": "G1"}, {"op": 3}, {"op": "add", "kind": "goal", "text": "x", "sources": [4]}, {"op": "add", "kind": "goal", "text": "x", "sources": [{"start": 1}]},
        {"op": "add", "kind": ["goal"], "text": "x", "sources": [source]}, {"op": "add", "kind": "goal", "text": 7, "sources": [source]}, {"op": "supersede", "id": "G1"}, {"op": "merge", "merged": {}},
        {"op": "resolve", "id": "G1", "evt": "2"}, {"op": "update", "id": "G1", "add_sources": 5}, {"op": "add", "kind": "goal", "text": "x", "sources": "1..2"}, {"op": "update", "id": ["G1"]},
    ]
    good = {"op": "add", "kind": "goal", "text": "ship it", "sources": [source]}
    rows = [("s", "c1", 0, 5, [1, 2], ["ship it"], [], json.dumps([good])), ("s", "c2", 0, 5, [1, 2], [], [], json.dumps(odd))]
    batches = spark.createDataFrame(rows, "session_key string, chunk string, evt_start int, evt_end int, visible array<int>, human array<string>, paths array<string>, ops string")
    got, refused = state.items(batches).collect(), state.rejections(batches).collect()
    assert [(i["text"], i["status"]) for i in got] == [("ship it", "active")]
    assert [(r["chunk"], r["op_index"]) for r in refused] == [("c2", k) for k in range(len(odd))] and all(r["reason"] for r in refused)


def test_ledger_slice_keeps_the_first_of_each_section(spark):
    rows = [("s", 0, 0, "a" * 40), ("s", 0, 1, "b" * 40), ("s", 0, 2, "c"), ("s", 1, 0, "d" * 400), ("s", 1, 1, "e"), ("s", 2, 0, "f" * 40)]
    got = S.ledger_slice(spark.createDataFrame(rows, "session_key string, section int, rank int, text string"), 20, 1000).collect()
    assert sorted((r["section"], r["rank"]) for r in got) == [(0, 0), (1, 0), (2, 0)]  # 12 of 20; 12 don't fit and end it; 102 and 12 are the first of theirs
    wide = S.ledger_slice(spark.createDataFrame(rows, "session_key string, section int, rank int, text string"), 1000, 1000).collect()
    assert len(wide) == len(rows)


def test_prior_summaries_say_what_they_have(spark):
    found = spark.createDataFrame([("s", 1, "one\nline"), ("s", 3, None), ("s", 4, "x" * 4000), ("s", 5, "four"), ("s", 7, "late")], "session_key string, evt int, text string")
    chunks = spark.createDataFrame([("s", 0, 1), ("s", 1, 2), ("s", 2, 7)], "session_key string, chunk int, evt_start int")
    got = {}
    for r in S.prior_summaries(found, chunks).collect():
        got.setdefault(r["chunk"], {})[r["evt"]] = r["text"]
    assert got[1] == {1: "one line"} and set(got) == {1, 2} and set(got[2]) == {3, 4, 5}
    assert got[2][3] == S.NO_SUMMARY and len(got[2][4]) < 1700


def test_projects_are_folders_and_those_above(spark):
    from sessionloom.sources import transcripts

    own = spark.createDataFrame([("a", "/w/a/b"), ("b", "/w/a"), ("c", "/w/a/b/c"), ("d", "/w/a/bc"), ("e", "/"), ("f", None), ("g", "w")], "session_key string, cwd string").withColumns({c: F.lit(None).cast("string") for c in ("title", "first_message", "started_at")})
    keys = lambda **k: {r["session_key"] for r in transcripts.matching(own, **k).collect()}
    assert keys(project="/w/a/b") == {"a"} and keys(project="/w/a/b", up=True) == {"a", "b", "e"} and keys(project="/none") == set("abcdefg")


def test_quotes_with_and_without_inner_words(spark):
    from sessionloom.operators import joins

    texts = ["the quick brown fox jumps over the lazy dog today", "a  " + "x" * 30 + " end", "quick\tbrown  fox jumps over it all", "", None, "y" * 23, "zz " + "q" * 12 + " " + "r" * 12 + " zz", "the quick brown fox jumps over the lazy dog today"]
    quotes = ["quick brown fox jumps over the", "x" * 24, "brown  fox jumps over it all", "y" * 23, "q" * 12 + " " + "r" * 12, "nothing of this is anywhere here", None, "ick brown fox jumps over the laz", "x" * 24]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("_n", F.lit(1))
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id int, quote string")
    want = sorted((i, d) for i, x in enumerate(quotes) for d, y in enumerate(texts) if x and y and len(x) >= 24 and x in y)
    assert sorted((r["item_id"], r["doc_id"]) for r in joins.contained(q, t, "quote", "text").collect()) == want


def test_arc_shows_six_at_most(spark):
    turns = spark.createDataFrame([("s", i) for i in range(11)] + [("t", i) for i in range(12)] + [("u", i) for i in range(7)], "session_key string, evt int")
    got = {}
    from sessionloom.operators import segment

    for r in segment.arc(turns).collect():
        got.setdefault(r["session_key"], []).append(r["evt"])
    assert {k: sorted(v) for k, v in got.items()} == {"s": [1, 2, 3, 4, 5, 6], "t": [1, 3, 5, 7, 9]}
