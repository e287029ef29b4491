"""The fold: operations against the plain version of the state, rounds with an injected function, restarts."""

import json
import os
import random
import signal

import plain_state
import pytest

from sessionloom.operators import fold, state

BATCHES = "session_key string, chunk string, evt_start int, evt_end int, visible array<int>, human array<string>, paths array<string>, ops string"
HUMAN = ["Please never push to main.", "Use «Tabs», always; see src/a.py"]


def random_op(rng, start):
    kinds = [*fold.PREFIX, "nonsense"]
    at = lambda: start + rng.choice([0, 1, 2, 3, 3, 40])
    ranges = lambda: [rng.choice([[a, b], {"start": b, "end": a}]) for a, b in [(at(), at()) for _ in range(rng.randrange(3))]]
    text = rng.choice(["one", "Two  words", "Never push", "never  PUSH!", " ", "see src/b.py now", "see src/a.py", "w " * 61, "key sk-" + "a" * 24, "…"])
    new = {"kind": rng.choice(kinds), "text": text, "sources": ranges() or [[start, start + 1]]}
    if rng.random() < 0.6:
        new["quote"] = rng.choice(["never push to main", "NEVER push", "tabs, Always", "not said", "", "q " * 51])
    if rng.random() < 0.3:
        new |= {"why": rng.choice(["because", "y " * 41]), "confidence": "high"}
    id_ = lambda: rng.choice(["C1", "C2", "G1", "G2", "G3", "N1", "N2", "N3", "D1", "D2", "X1", "F1", "Z9"])
    name = rng.choice(["add"] * 6 + ["update", "supersede", "resolve", "drop", "merge", "confirm", "dance"])
    if name == "add":
        return {"op": name, **new}
    if name == "supersede":
        return {"op": name, "id": id_(), "replacement": new}
    if name == "merge":
        return {"op": name, "ids": [id_(), id_()], "merged": new}
    op = {"op": name, "id": id_()}
    if name == "update":
        return op | {"text": rng.choice([None, "", "changed"]), "why": rng.choice([None, "since"]), "add_sources": ranges()}
    return op | ({"evt": at()} if name in ("resolve", "confirm") else {"reason": "old"})


def test_operations_are_the_plain_version(spark):
    rng = random.Random(8)
    sessions = {f"s{k}": [(f"c{c}", 4 * c, [random_op(rng, 4 * c) for _ in range(rng.randrange(9))]) for c in range(rng.randrange(1, 7))] for k in range(60)}
    rows = [(s, c, a, a + 3, [a, a + 1, a + 2], HUMAN, ["src/a.py"], json.dumps({"ops": ops})) for s, batches in sessions.items() for c, a, ops in batches]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, BATCHES)
    want, refused = [], []
    names = ("add", "update", "supersede", "resolve", "drop", "merge", "confirm")
    statuses = set()
    for s, batches in sessions.items():
        out, no = plain_state.replay([(c, plain_state.Batch(a, a + 3, [a, a + 1, a + 2], HUMAN, ["src/a.py"]), ops) for c, a, ops in batches])
        want += [(s, i.id, i.seq, i.kind, i.text, i.why, i.quote, tuple(i.sources), i.status, i.detail, i.confidence, i.last_confirmed) for i in out.items]
        refused += [(s, *r) for r in no]
        statuses |= {i.status for i in out.items}
    assert statuses == {"active", "superseded", "resolved", "dropped"} and len({r[4].split(" ")[0] for r in refused}) > 8 and {r[3] for r in refused} >= set(names[:6])
    got = [(*r[:7], tuple(map(tuple, r[7])), *r[8:]) for r in map(tuple, state.items(df).collect())]
    assert sorted(got) == sorted(want, key=lambda x: x[:3])
    assert sorted(map(tuple, state.rejections(df).collect())) == sorted(refused)


CHUNKS = "session_key string, place int, chunk string, role string, evt_start int, evt_end int, text string, about string, visible array<int>, human array<string>, paths array<string>"


def chunks(spark):
    rows = [("a", k, f"c{k}", "fold", 2 * k, 2 * k + 1, f"chunk {k}", None, [2 * k], ["keep it"], []) for k in range(6)]
    rows += [("a", 6, "final", "final", 12, 12, "tail", "about it", [12], ["keep it"], []), ("b", 0, "c0", "fold", 0, 9, "only", None, [1], [], [])]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture
def answers():
    """Made here, so that tasks get it by value."""

    import json

    def answers(row):
        if row["session_key"] == "a" and row["chunk"] == "c3" and row["role"] == "fold":
            raise TimeoutError("no answer")
        add = {"op": "add", "kind": "decision", "text": f"{row['role']} {row['chunk']}", "sources": [[row["evt_start"], row["evt_end"]]]}
        if row["role"] == "fold" and row["chunk"] == "c1":
            assert "D1 decision: fold c0" in row["prompt"]
            assert "# FOCUS" not in row["prompt"] or "# CANDIDATES\n- candidate decision: premap c1 [2-3]" in row["prompt"] and "# FOCUS\nfinish" in row["prompt"]
            return json.dumps([add, {"op": "resolve", "id": "Q7", "evt": 2}])
        if row["role"] == "repair":
            assert "# REFUSED\n- 1 resolve: unknown item Q7" in row["prompt"]
            return json.dumps([{"op": "resolve", "id": "Q8", "evt": 2}, {"op": "confirm", "id": "D2", "evt": 3}])
        if row["role"] == "final":
            assert "# ABOUT\nabout it" in row["prompt"]
        return json.dumps([add])

    return answers


def test_rounds(spark, tmp_path, answers):
    got = {r["session_key"]: r for r in fold.run(chunks(spark), answers, str(tmp_path / "f"), focus="finish").collect()}
    a, b = got["a"], got["b"]
    assert [i["text"] for i in a["state"]["items"]] == ["fold c0", "fold c1", "fold c2", "fold c4", "fold c5", "final final"]
    assert a["state"]["items"][1]["sources"] == [(2, 3), (3, 3)] and [tuple(r) for r in a["state"]["refused"]] == [("c1", 1, "resolve", "unknown item Q7"), ("c1", 0, "resolve", "unknown item Q8")]
    assert (a["calls"], a["repairs"], a["failures"], a["processed"]) == (6 + 7 + 1, 1, 1, ["c0", "c1", "c2", "c3", "c4", "c5", "final"])
    assert [i["text"] for i in b["state"]["items"]] == ["fold c0"] and (b["calls"], b["repairs"]) == (1, 0)
    assert fold.run(chunks(spark).limit(0), answers, str(tmp_path / "e")).count() == 0


def test_a_killed_fold_goes_on(spark, tmp_path, answers):
    """Whatever was asked before isn't asked again, and the rows are the same."""
    few = chunks(spark).where("session_key = 'b' OR place < 3")
    whole = sorted(map(str, fold.run(few, answers, str(tmp_path / "whole"), premap=False).collect()))
    log = tmp_path / "log"

    def killed(row):
        if row["chunk"] == "c2" and row["role"] == "fold":
            if not (tmp_path / "second").exists():
                os.kill(os.getpid(), signal.SIGKILL)
        with open(log, "a") as f:
            f.write(f"{row['session_key']} {row['chunk']} {row['role']}\n")
        return answers(row)

    with pytest.raises(Exception):
        fold.run(few, killed, str(tmp_path / "killed"), premap=False).collect()
    (tmp_path / "second").touch()
    again = sorted(map(str, fold.run(few, killed, str(tmp_path / "killed"), premap=False).collect()))
    assert again == whole
    calls = log.read_text().splitlines()
    assert len(calls) == len(set(calls))


def test_a_prompt_above_the_window_is_never_sent(spark, tmp_path, answers):
    with pytest.raises(Exception, match="tokens, the window 3"):
        fold.run(chunks(spark), answers, str(tmp_path / "w"), focus="finish", window=3).collect()
