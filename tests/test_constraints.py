"""Standing instructions of a session: said again, inside others, in the order of the plain rule."""

import random

from pyspark.sql import functions as F

from sessionloom.operators import triage


def plain(rows):
    kept, out = {}, []
    for session, evt, seq, text, markers, key in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if (session, key) in kept:
            old = out[kept[session, key]]
            if len(old[4]) < len(markers):
                old[4] = markers
        elif not any(s == session and len(k) > len(key) and key in k for s, k in kept):
            kept[session, key] = len(out)
            out.append([session, evt, seq, text, markers, key])
    return sorted(out)


def test_rules_are_kept_by_joins(spark):
    rng = random.Random(5)
    rows = []
    for s in range(30):
        for evt in range(12):
            for seq in range(2):
                key = " ".join(rng.choices(["never", "push", "to", "pu", "main"], k=rng.randint(2, 5)))
                rows.append((f"s{s}", evt, seq, f"{key} {evt} {seq}", [f"m{k}" for k in range(rng.randint(1, 3))], key))
    found = spark.createDataFrame(rows, "session_key string, evt int, seq int, text string, markers array<string>, key string")
    kept = triage._keep(found)
    assert sorted(map(list, kept.select(found.columns).collect())) == plain(rows)
    assert "Pandas" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_made_without_a_second_look(spark):
    events = spark.createDataFrame([], "session_key string, idx int, text string, kind string, is_active boolean, is_meta boolean, source_kind string, subtype string, stream int, question string, answer string")
    plan = triage.candidates(events)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("PRIVATE KEY-----[^-]*") == 1


def test_families(spark):
    said = ["Never push to main", "Please always run the tests", "Don't touch the lock file", "never push?", "why never push this", "NEVER PUSH INTO MAIN", "Never do", "never see <command-name> x", "it is never so", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in said], "t string").select(triage.markers(F.col("t"))).collect()]
    assert got == [["prohibition"], ["standing directive"], ["negative directive", "untouchable"], [], [], [], [], [], [], []]
