"""The brief: what is charged first, what is dropped whole, what it says; headers that state their own size; pointers that resolve."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import brief

ITEMS = "session_key string, id string, seq int, kind string, text string, why string, quote string, sources array<struct<start:int,end:int>>, status string"


@pytest.fixture(scope="module")
def parts(spark):
    items = [
        ("s", "C1", 0, "constraint", "no push", None, "Never push!", [(1, 1)], "active"), ("s", "C2", 1, "constraint", "do not push", None, "never PUSH", [(4, 4)], "active"), ("s", "C3", 2, "constraint", "tabs", None, None, [(2, 3)], "active"),
        ("s", "G1", 3, "goal", "old aim", None, None, [(0, 0)], "superseded"), ("s", "G2", 4, "goal", "the aim", None, None, [(3, 2), (9, 9)], "active"), ("s", "N1", 5, "next_action", "run it", None, None, [(9, 9)], "active"),
        ("s", "X1", 6, "dead_end", "that way", "it broke", None, [(5, 6)], "active"),
    ]
    return {
        "messages": spark.createDataFrame([("s", 0, "first  wish"), ("s", 8, "last wish"), ("t", 1, "only")], "session_key string, evt int, text string"),
        "items": spark.createDataFrame(items, ITEMS),
        "commands": spark.createDataFrame([("s", "cargo test", "test", 7), ("s", "ls", "other", 8), ("s", "cargo test", "test", 9)], "session_key string, normalized string, category string, evt int"),
        "findings": spark.createDataFrame([("s", 1, "missing", "a.py is gone"), ("s", 0, "moved", "two commits since")], "session_key string, rank int, kind string, text string"),
        "notices": spark.createDataFrame([("s", "No model ran.\nRead on.")], "session_key string, text string"),
        "steps": spark.createDataFrame([("s", 9, "last command: x"), ("t", 1, "last command: y")], "session_key string, evt int, text string"),
    }


WANT = """
## L0 · Brief

> No model ran.
> Read on.

**Before you act — the evidence contradicts this document:**
- *moved*: two commits since
- *missing*: a.py is gone

**Original request** (where the work started): first wish [evt 0]

**Active goal** (G2): the aim [evt 2–3, evt 9]

**Hard constraints** (standing instructions, in the user's words)
- (C1) "Never push!" [evt 1]
- (C3) "tabs" [evt 2–3]

**Last user request**: last wish [evt 8]

**Current step** — last command: x [evt 9]

**Next actions**
- (N1) run it [evt 9]

**Don't retry**
- (X1) that way — it broke [evt 5–6]

**Verify first**
- `git status`
- `git log --oneline -5`
- `cargo test`

"""


def test_brief(parts):
    blocks = brief.blocks(**parts)
    got = {r["session_key"]: r["text"] for r in brief.brief(blocks).collect()}
    assert got["s"] == WANT
    assert got["t"] == "\n## L0 · Brief\n\n**Goal** (from the first message): only [evt 1]\n\n**Current step** — last command: y [evt 1]\n\n**Verify first**\n- `git status`\n- `git log --oneline -5`\n\n"
    # nothing optional fits, and nothing mandatory goes
    least = next(r["text"] for r in brief.brief(blocks, 1).collect() if r["session_key"] == "s")
    assert "No model ran" in least and "Never push!" in least and "a.py is gone" in least and "wish" not in least and "Verify" not in least


def test_long_lists_say_how_many_are_left_out(spark):
    many = [("s", f"C{k}", k, "constraint", f"rule number {k} of many", None, None, [(k, k)], "active") for k in range(200)]
    text = brief.constraints_block(spark.createDataFrame(many, ITEMS), 100).first()["text"]
    shown = text.count("- (C")
    assert 1 < shown < 20 and f"- … and {200 - shown} more\n" in text


def test_headers_state_their_own_size(spark):
    """Around every change of the number of digits."""
    rng = random.Random(1)
    sizes = [*range(0, 60), *range(3900, 4100), *range(39_900, 40_060), *[rng.randrange(500_000) for _ in range(20)]]
    df = spark.createDataFrame([(n,) for n in sizes], "n int").select("n", brief.with_size(F.concat(F.lit("tokens: {tokens}\n"), F.repeat(F.lit("é"), F.col("n")))).alias("t"))
    for r in df.select("n", F.regexp_extract("t", "tokens: ([0-9]+)", 1).cast("int").alias("stated"), F.ceil(F.octet_length("t") / 4).alias("real")).collect():
        assert r["stated"] == r["real"], r


def test_expanded_ranges_are_plain_slices(spark):
    rng = random.Random(5)
    rows = [(s, e, f"{s}{e}", rng.randrange(1, 30)) for s in "ab" for e in sorted(rng.sample(range(400), 150))]
    ranges = [(s, k, a, a + rng.randrange(0, 150)) for s in "abc" for k, a in enumerate(rng.sample(range(420), 12))]
    r = spark.createDataFrame(rows, "session_key string, evt int, text string, tokens int")
    g = spark.createDataFrame(ranges, "session_key string, range_id int, start int, end int")
    found = brief.expanded(r, g, 3)
    got = {(x["session_key"], x["range_id"], x["evt"]) for x in found.collect()}
    want = set()
    for s, k, a, z in ranges:
        own = {(s, k, e) for t, e, _, _ in rows if t == s and max(0, a - 3) <= e <= z + 3}
        want |= own or {(s, k, None)}
    assert got == want
    pages = brief.paged(found, 60).collect()
    assert {(x["session_key"], x["range_id"], x["evt"]) for x in pages} == {w for w in want if w[2] is not None}
    sums, held = {}, {}
    for x in pages:
        key = x["session_key"], x["range_id"], x["page"]
        sums[key], held[key] = sums.get(key, 0) + x["tokens"], held.get(key, 0) + 1
    assert all(t <= 60 or held[k] == 1 for k, t in sums.items())
