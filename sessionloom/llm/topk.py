"""Exact top-k inner-product search by ball-tree branch and bound.

Vectors are dealt by hash into shards of about ``shard_rows``; every shard gets a ball tree, built once and kept as one binary row.
Queries travel in blocks.  A block first searches one shard; the k-th scores found there go along to all other shards,
where whatever a node can't beat is cut off: no vector in a ball of centre ``c`` and radius ``r`` has an inner product with ``q``
above ``q . c + |q| r``.  Nodes are taken in the order of that bound and the current k-th score is shared between them.

Each task holds one tree and one block of queries.  Results of a block are its k best of each shard, merged by an aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import table, written

K = 5
SCALE = 256.0
SHARD_ROWS = 16_384
QUERY_BLOCK = 1024
LEAF = 128
SAFE = float(1 << 52)
#: Vectors with components as large as this, in units of 1 / SCALE, take no part: they are no longs.
LARGEST = float(1 << 62)
HALF = 62  #: Scores travel as two longs, s >> HALF and the rest, so that they stay exact and in order beyond a long.


def quantized(column: F.Column) -> F.Column:
    """Each component x, as a double, to floor(256 x); null for null vectors and those with null or non-finite components
    (or components of 2 ** 62 / 256 and more, which are no longs)."""
    wide = F.transform(column.cast("array<double>"), lambda x: x * SCALE)
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return F.when(column.isNull() | bad | F.exists(column, lambda x: x.isNull()), F.lit(None)).otherwise(F.transform(wide, lambda x: F.floor(x)))


def build_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Order of the points and nodes (first, end, left, right) in that order; leaves have left = -1.  Points are split at the median along the
    line between two far ones; equal points are split by place, so that the depth is logarithmic."""
    order, nodes = np.arange(len(points)), []
    stack = [(0, len(points), -1, 0)]
    while stack:
        lo, hi, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([lo, hi, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if hi - lo > leaf:
            own = points[order[lo:hi]]
            a = own[np.argmax(((own - own[0]) ** 2).sum(axis=1))]
            b = own[np.argmax(((own - a) ** 2).sum(axis=1))]
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(own @ (b - a), mid)]
            stack += [(lo + mid, hi, me, 1), (lo, lo + mid, me, 0)]
    return order, [tuple(n) for n in nodes]


def _better(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i], uids[i]))[:k], np.int64)
    return np.lexsort((uids, ids, -scores))[:k]


def search(points: np.ndarray, ids: np.ndarray, uids: np.ndarray, order: np.ndarray, nodes: list[tuple[int, int, int, int]], queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Scores, ids and uids of each query's best, at most k, of those that reach its ``floor`` score; ``own`` is the uid left out.

    ``points`` and ``queries`` are doubles, which hold every sum exactly, or Python's integers; bounds are doubles with some slack, and a k-th score is
    rounded down.  All of a round's queries take their next node, in the order of their bounds, together.
    """
    exact_points, exact_queries = points, queries
    points, queries = points.astype(float), queries.astype(float)
    centres = np.stack([points[order[a:b]].mean(axis=0) for a, b, _, _ in nodes])
    radii = np.array([math.sqrt(((points[order[a:b]] - c) ** 2).sum(axis=1).max()) for (a, b, _, _), c in zip(nodes, centres, strict=True)])
    norms = np.sqrt((queries**2).sum(axis=1))
    kth = floor.astype(float).copy()
    slack = 1e-6 * (1 + np.abs(centres).max() * np.abs(queries).max() * points.shape[1]) if len(queries) else 0
    # down the tree, level by level: bounds of the nodes that can still hold something
    frontier = {0: np.arange(len(queries))}
    leaf_of, bound_of = [], []
    while frontier:
        below: dict[int, np.ndarray] = {}
        for node, who in frontier.items():
            bound = queries[who] @ centres[node] + norms[who] * radii[node] + slack
            who, bound = who[bound >= kth[who]], bound[bound >= kth[who]]
            if not len(who):
                continue
            if nodes[node][2] < 0:
                leaf_of.append(np.stack([who, np.full(len(who), node)], axis=1))
                bound_of.append(bound)
            else:
                below[nodes[node][2]] = who
                below[nodes[node][3]] = who
        frontier = below
    best = [(np.zeros(0, exact_points.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    if not leaf_of:
        return best
    pairs, bounds = np.concatenate(leaf_of), np.concatenate(bound_of)
    by = np.lexsort((-bounds, pairs[:, 0]))
    pairs, bounds = pairs[by], bounds[by]
    heads = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]]))
    ends = np.append(heads[1:], len(pairs))
    at = heads.copy()
    live = np.arange(len(heads))
    while len(live):
        now = at[live]
        can = bounds[now] >= kth[pairs[now, 0]]
        live, now = live[can], now[can]
        for node in np.unique(pairs[now, 1]).tolist():
            who = pairs[now[pairs[now, 1] == node], 0]
            a, b, _, _ = nodes[node]
            inside = order[a:b]
            scores = exact_queries[who] @ exact_points[inside].T
            for row, q in enumerate(who.tolist()):
                s = scores[row]
                ok = (s >= kth[q]).astype(bool) & (uids[inside] != own[q])
                if ok.any():
                    have = best[q]
                    s, i, u = np.concatenate([have[0], s[ok]]), np.concatenate([have[1], ids[inside][ok]]), np.concatenate([have[2], uids[inside][ok]])
                    top = _better(s, i, u, k)
                    best[q] = s[top], i[top], u[top]
                    if len(top) == k:
                        kth[q] = max(kth[q], s[top[-1]] if s.dtype != object else np.nextafter(float(s[top[-1]]), -np.inf))
        at[live] += 1
        live = live[at[live] < ends[live]]
    return best


_TREE = "dim int, shard int, ids binary, uids binary, vectors binary, tree_order binary, nodes binary"


def _trees(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, shard, vec_id, uid, v) sorted by (dim, shard): a shard at a time to its tree."""
    held: list = []
    key = None

    def row() -> pa.RecordBatch:
        ids, uids = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
        points = np.stack([h[2] for h in held])
        order, nodes = build_tree(points.astype(float))
        cols = [key[0], key[1], ids.tobytes(), uids.tobytes(), points.tobytes(), order.astype(np.int64).tobytes(), np.array(nodes, np.int64).tobytes()]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], ["dim", "shard", "ids", "uids", "vectors", "tree_order", "nodes"])

    for b in groups:
        values = b.column(4)
        for i in range(b.num_rows):
            this = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
            if this != key and held:
                yield row()
                held = []
            key = this
            held.append((b.column(2)[i].as_py(), b.column(3)[i].as_py(), values[i].values.to_numpy(zero_copy_only=False).astype(np.int64)))
    if held:
        yield row()


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                dim = r["dim"]
                ids, uids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["uids"], np.int64)
                points = np.frombuffer(r["vectors"], np.int64).reshape(len(ids), dim)
                queries = np.array(r["q_vectors"], np.int64).reshape(-1, dim)
                # doubles hold every sum exactly while it stays below 2 ** 52; beyond that Python's integers do
                safe = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dim < SAFE
                kind = float if safe else object
                floors = np.array([-np.inf if f is None else float(f) for f in r["q_floors"]])
                nodes = [tuple(n) for n in np.frombuffer(r["nodes"], np.int64).reshape(-1, 4).tolist()]
                order = np.frombuffer(r["tree_order"], np.int64)
                found = search(points.astype(kind), ids, uids, order, nodes, queries.astype(kind), np.array(r["q_uids"], np.int64), floors, k)
                rows = [(int(quid), int(qid), int(i), int(u), int(s) >> HALF, int(s) & (1 << HALF) - 1) for quid, qid, (ss, ii, uu) in zip(r["q_uids"], r["q_ids"], found, strict=True) for s, i, u in zip(ss, ii, uu, strict=True)]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q_uid", "query_id", "vec_id", "uid", "hi", "lo"])

    return run


_FOUND = "q_uid long, query_id long, vec_id long, uid long, hi long, lo long"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, by score and then the smaller vec_id, with their rank."""
    order = F.struct((-F.col("hi")).alias("hi"), (-F.col("lo")).alias("lo"), "vec_id", "uid", "query_id")
    top = found.groupBy("q_uid").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("top"))  # k for each shard at most
    each = top.select("q_uid", F.posexplode("top").alias("at", "t"))
    return each.select("q_uid", F.col("t.query_id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.uid").alias("uid"), (-F.col("t.hi")).alias("hi"), (-F.col("t.lo")).alias("lo"))


def _score() -> F.Column:
    """The score as a long; the nearest one, where it is none."""
    hi, most = F.col("hi"), (1 << 63) - 1
    return F.when(hi > 1, F.lit(most)).when(hi < -2, F.lit(-most - 1)).otherwise(hi * F.lit(1 << HALF) + F.col("lo"))


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row of ``vectors`` (vec_id, embedding) with the
    other rows; all, if there are fewer.  Ties go to the smaller vec_id.

    Null vectors, those with null or non-finite components, empty ones, those with components of 2 ** 62 / 256 and more and rows without vec_id take no part.
    Scores are compared exactly; one that is no long is given as the nearest long.  Only vectors of equal
    length are compared.  A repeated row is a row of its own: it is found by its copies.  An empty table gives an empty result; other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("asks"), quantized(F.col("embedding")).alias("v"))
    rows = rows.where("size(v) > 0").select(F.monotonically_increasing_id().alias("uid"), "vec_id", "asks", F.size("v").alias("dim"), "v")
    rows = written(rows, "topk-rows")
    n = rows.count()
    shards = max(1, math.ceil(n / shard_rows))
    dealt = rows.select("dim", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "uid", "v")
    trees = written(dealt.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard").mapInArrow(_trees, _TREE), "topk-trees")
    queries = rows.where("asks")
    blocks = max(1, math.ceil(queries.count() / query_block))
    asked = queries.select("uid", "vec_id", "dim", "v", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def ask(asked: DataFrame, where: F.Column) -> DataFrame:
        """Blocks of (queries, floor scores) to the shards given by ``where`` (an array of shard numbers)."""
        block = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("uid", "vec_id", "floor", "v")).alias("q"))  # query_block on average
        sent = block.select("dim", F.explode(where).alias("shard"), F.col("q.uid").alias("q_uids"), F.col("q.vec_id").alias("q_ids"), F.col("q.floor").alias("q_floors"), F.flatten("q.v").alias("q_vectors"))
        pairs = sent.join(trees.hint("shuffle_hash"), ["dim", "shard"]).repartition(max(1, min(shards * blocks, 4096)))
        return pairs.mapInArrow(_search(k), _FOUND)

    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    first = written(ask(asked.withColumn("floor", F.lit(None).cast("double")), F.array(home)), "topk-first")
    if shards == 1:
        return _best(first, k).select("query_id", "rank", "vec_id", _score().alias("score"))
    about = F.col("hi") * float(1 << HALF) + F.col("lo")
    kth = _best(first, k).where(F.col("rank") == k).select(F.col("q_uid").alias("uid"), (about - F.abs(about) * 1e-12 - 1).alias("floor"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
    rest = ask(asked.join(kth, "uid", "left"), others)
    return _best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", _score().alias("score"))


def op4_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
