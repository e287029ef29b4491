"""Whitening, prefix tries and mixing against plain versions of them, on small messy tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import mixing, trie, whitening


def clashing(df):
    """With columns whose names the operators use inside."""
    for c in ("v", "w", "dim", "node", "n", "i", "a", "b", "part", "size", "m", "unit", "sid", "depth", "_a", "_at"):
        df = df.withColumn(c, F.lit("x"))
    return df


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_whitening(vectors, k=8):
    """vec_id -> deviation, and the covariance's eigenvalues and components."""
    good = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good])
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(e) ** 2 for e in n * r - s) for r in x]
    c = (n * x - s) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in good], deviation, e[::-1], axes[:, ::-1], c


@pytest.mark.parametrize("partitions", [1, 9])
def test_whitening_plain(spark, partitions):
    rng = np.random.default_rng(3)
    scales = np.linspace(1, 0.1, 12)
    rows = [(i, [float(x) for x in rng.normal(size=12) * scales + 5], 0) for i in range(600)]
    rows += [(600, None, 0), (601, [1.0, None] + [0.0] * 10, 0), (602, [float("nan")] * 12, 0), (603, [float("inf")] + [0.0] * 11, 0), (604, [], 0), rows[5], rows[5], (None, rows[9][1], 0), (605, [1e30] * 12, 0)]
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(partitions)
    kept = [(i, v) for i, v, _ in rows if i != 605]
    ids, deviation, e, axes, c = plain_whitening(kept)
    got = whitening.whiten(df).collect()
    assert len(got) == 8 * len(ids) and {r["n"] for r in got} == {len(ids)} and max(r["identity_error"] for r in got) < 1e-9
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == sorted((-1 if i is None else i, d) for i, d in zip(ids, deviation, strict=True))
    for k in range(8):
        own = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["whitened"]) for r in got if r["component"] == k + 1)
        want = c @ axes[:, k] / math.sqrt(e[k])
        want = np.array([w for _, w in sorted(zip([-1 if i is None else i for i in ids], want, strict=True))])
        have = np.array([w for _, w in own])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-9
        assert all(abs(r["explained"] - e[k] / e.sum()) < 1e-12 for r in got if r["component"] == k + 1)


def test_whitening_keeps_all_dimensions_in_any_order_of_merges():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, size=(500, 20)) @ np.diag(range(1, 21)) + 100_000
    whole = whitening.factor(x)
    parts = [whitening.factor(p) for p in np.array_split(x, 37)]
    left = parts[0]
    for p in parts[1:]:
        left = whitening.merge(left, p)
    while len(parts) > 1:
        parts = [whitening.merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    for other in (left, parts[0]):
        assert (other.n, other.sums, len(other.scales)) == (500, x.sum(axis=0).tolist(), 20)
        assert np.allclose(other.scales, whole.scales, rtol=1e-12)
        assert np.allclose(np.abs((other.vectors * whole.vectors).sum(axis=1)), 1, atol=1e-10)


def test_whitening_edges(spark):
    empty = whitening.whiten(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # equal vectors have no variance; of two different ones there is one component; other lengths are fitted alone
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 0) for i in range(4)], VECTORS))
    assert same.count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 1.0], 0), (3, [1.0], 0), (4, [2.0], 0), (5, [2.0], 0)], VECTORS)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], round(abs(r["whitened"]), 6)) for r in two) == [(1, 1, 2, 1.0), (2, 1, 2, 1.0), (3, 1, 3, 1.414214), (4, 1, 3, 0.707107), (5, 1, 3, 0.707107)]
    # exact where a long can't hold n times an entry; null where it can't hold the sum of squares
    wide = spark.createDataFrame([(1, [2.0**50]), (2, [-(2.0**50)]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(wide).collect()} == {1: None, 2: None, 3: 0}


# ---- tries


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, own_members in members.items():
        ends = ",".join(str(c) for c in sorted(own_members) if made[c] == node)
        up = min(members[node[:-1]]) if node else None
        out.append((min(own_members), len(node), up, len(own_members), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversations(seed):
    """Few different turns, so that many prefixes are shared; a third of all conversations are equal, and one holds a third of all turns."""
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "é", "yes", ""])) for c in range(90) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", f"hello {t}") for c in range(200, 245) for t in range(4)]
    rows += [(1001, t, "user", str(t % 7)) for t in range(500)]
    rows += [(13, None, None, None), (14, 3, "user", None), (15, 0, None, "x"), (None, 1, "user", "lost"), (8, 400, "user", "a"), (8, 400, "user", "a"), (7, 500, "user", "long " * 20_000), (501, 0, "user", "head is absent")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows", [3, 40, 1024])
def test_trie_plain(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(trie, "BAND_NODES", 50)
    rows = conversations(shard_rows)
    got = trie.conversation_trie(clashing(spark.createDataFrame(rows, CONVERSATIONS)).repartition(7), shard_rows).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_trie_splits_ids_of_one_node(spark, monkeypatch):
    """More ids at a node than a chunk holds, over several tasks."""
    ends = spark.range(1, 3000).select(F.lit(1).cast("long").alias("ka"), F.lit(2).cast("long").alias("kb"), F.col("id").alias("conv_id")).unionByName(spark.range(3).selectExpr("id ka", "id kb", "id conv_id"))
    want = {(1, 2): ",".join(map(str, range(1, 3000))), **{(k, k): str(k) for k in range(3)}}
    batches = [pa.RecordBatch.from_arrays([pa.array([1] * 9), pa.array([2] * 9), pa.array(range(9))], ["ka", "kb", "conv_id"])]
    monkeypatch.setattr(trie, "CHUNK_IDS", 4)
    monkeypatch.setattr(trie, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    chunks = [r for b in trie._ends(iter(batches)) for r in b.to_pylist()]
    assert [r["ids"] for r in chunks] == ["0,1,2,3", "4,5,6,7", "8"]
    monkeypatch.undo()
    assert {(r["ka"], r["kb"]): r["ends_sha256"] for r in trie.end_hashes(ends).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_trie_edges(spark):
    assert trie.conversation_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], CONVERSATIONS)).count() == 0
    one = [(c, 0, "user", "x") for c in (3, 4)]  # no conversation 0: those that take a head lose their turn
    assert sorted(map(tuple, trie.conversation_trie(spark.createDataFrame(one, CONVERSATIONS)).collect()), key=str) == plain_trie(one)


def test_louds():
    """a(b(d, e), c): bits of the root above all, a, b, c, d, e."""
    ka, pa_ = np.array([5, 2, 1, 3, 4]), np.array([2, 1, 0, 1, 2])
    t = trie.Louds(ka, ka, pa_, pa_, np.array([2, 1, 0, 1, 2]))
    assert t.bits.astype(int).tolist() == [1, 0, 1, 1, 0, 1, 1, 0, 0, 0, 0]
    assert t.parents().tolist() == [-1, 0, 0, 1, 1] and t.children().tolist() == [2, 2, 0, 0, 0] and ka[t.order].tolist() == [1, 2, 3, 4, 5]
    assert t.rollup(np.ones(5, np.int64)).tolist() == [5, 3, 1, 1, 1]
    # two names that share their first half
    t = trie.Louds(np.array([1, 1, 2]), np.array([1, 2, 3]), np.array([0, 0, 1]), np.array([0, 0, 2]), np.array([0, 0, 1]))
    assert t.parents().tolist() == [-1, -1, 1]


# ---- mixing

DOCUMENTS = "doc_id long, text string, source string"


def plain_targets(sizes):
    """source -> target; shares by weight 1, 2, 3 in the order of code points, null last, capped at three times the size and shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def messy_documents():
    rng = random.Random(11)
    sources = [None, "", "b", "a", "é", "z", "\U0001f600", "~"]
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(min(400, int(rng.paretovariate(0.6))))), rng.choice(sources)) for i in range(1500)]
    rows += [(5000 + i, "x y\t z\x0bq", "hot") for i in range(900)] + [(7, "same words here", "hot")] * 700  # no-break space is no word break
    rows += [(None, "no id", "a"), (None, "no id", "a"), (9001, None, "b"), (9002, "", "only empty"), (9003, " \n", "only empty"), (9004, "long " * 30_000, "z"), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


def test_mixing(spark):
    rows = messy_documents()
    df = clashing(spark.createDataFrame(rows, DOCUMENTS))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = plain_targets(sizes)
    got = [tuple(r) for r in mixing.mix(df.repartition(5)).collect()]
    assert sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str) == sorted(got, key=str)  # reruns agree
    want = sorted(((i, size(t), sizes[s], round(targets[s], 6)) for i, t, s in rows), key=str)
    assert sorted(((i, n, ss, round(t, 6)) for i, n, ss, t, _ in got), key=str) == want
    taken, largest, copies = defaultdict(int), defaultdict(int), defaultdict(set)
    for i, n, ss, t, k in got:
        assert k <= 3 * n and (n == 0 or (k % n == 0 and k // n in (math.floor(t / ss + 1e-9), math.floor(t / ss) + 1)))
        taken[ss, round(t, 6)] += k
        largest[ss, round(t, 6)] = max(largest[ss, round(t, 6)], n)
        copies[i, n].add(k)
    assert len({*taken}) == len(sizes)
    assert all(abs(k - t) < largest[ss, t] or k == t == 0 for (ss, t), k in taken.items())
    assert sum(abs(k - t) < 40 for (_, t), k in taken.items()) >= 6  # what is missed is a part of a small document
    assert copies[7, 3] <= {3, 6, 9, 0} and max(copies[7, 3]) - min(copies[7, 3]) <= 3


def test_mixing_keeps_probabilities(spark):
    """Over many draws each document is taken as often as its source's share asks, whatever its size."""
    rows = [(i, "w " * (1 + i % 40), "a" if i < 300 else "b") for i in range(500)]
    df = spark.createDataFrame(rows, DOCUMENTS).cache()
    counts, draws = defaultdict(int), 3
    for seed in range(draws):
        mixing.SEED = seed
        for r in mixing.mix(df).collect():
            counts[r["doc_id"]] += r["taken"] // r["size"]
            share = {r["doc_id"]: r["target"] / r["source_size"]} if r["doc_id"] == 0 else {}
            if share:
                p = share[0]
    mixing.SEED = 42
    for lo, hi in ((0, 10), (10, 20), (20, 30), (30, 40)):  # by size
        own = [counts[i] / draws for i in range(300) if lo <= i % 40 < hi]
        assert abs(np.mean(own) - p) < 0.08


def test_mixing_edges(spark, monkeypatch):
    empty = mixing.mix(spark.createDataFrame([], DOCUMENTS))
    assert empty.count() == 0 and empty.columns == ["doc_id", "size", "source_size", "target", "taken"]
    blank = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], DOCUMENTS)).collect()
    assert sorted(map(tuple, blank)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    monkeypatch.setattr(mixing, "CHUNK", 10)  # many equal rows are dealt out in chunks
    same = [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, "a b", "s")] * 64 + [(2, "c", "t")] * 3, DOCUMENTS)).collect()]
    assert len(same) == 67 and abs(sum(k for _, _, ss, _, k in same if ss == 128) - (131 - 9)) <= 2 and sum(k for _, _, ss, _, k in same if ss == 3) == 9
