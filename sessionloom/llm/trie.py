"""Prefix tries of conversations, built shard by shard in level order (LOUDS).

A node is a distinct sequence of first turns.  Its name is 128 bits: the exclusive or of hashes of each turn with its place, so that names of
prefixes come from one scan over sorted rows, in which a task hands on a few numbers to the next, however long a conversation is.  Equal prefixes are then
equal names, and an aggregation with map-side combining makes the nodes: copies of a conversation are no more nodes than one.

The trie is cut where it gets small.  Nodes with more than ``shard_rows`` rows at or below them are the upper levels, few at each depth.
What hangs below them are shards: a task takes whole subtrees, lays their nodes out in level order, builds the bitvector (for the root of the shard and then
each node a 1 for every child and a 0) and arrays of labels in that order, reads parents and numbers of children from the bitvector by rank and select,
and adds up levels from the last to the first.  The upper levels merge in the same way, with what the shards' roots
hand up, in bands of bounded size from the deepest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import drop_written, join_hot, table, written

SHARD_ROWS = 1024
SHARD_SHARE = 1 << 18  #: A shard may have this part of all rows, if that is more: it bounds the upper nodes of a depth.
BATCH_NODES = 1 << 16
BAND_NODES = 1 << 20
BAND_COUNTS = 4096
CHUNK_IDS = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
GROUP, HEADS = 5, 8  #: Conversations that share a head, and its longest.


# ---- scans over sorted rows


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, conv_id, with a and b: their number in the conversation, and the exclusive or of a and b up to them, as far as this
    task has seen."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    before = [0, 0]
    for batch in batches:
        conv = batch.column(0).to_numpy()
        if not len(conv):
            continue
        heads = np.flatnonzero(np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]]))
        own = np.searchsorted(heads, np.arange(len(conv)), "right") - 1  # -1: goes on from the batch before
        start = np.where(own < 0, 0, heads[own]) if len(heads) else np.zeros(len(conv), np.int64)
        number = np.arange(len(conv)) - start + 1 + np.where(own < 0, n, 0)
        runs = []
        for k, name in enumerate("ab"):
            all_ = np.bitwise_xor.accumulate(batch.column(name).to_numpy())
            runs.append(all_ ^ np.where(start > 0, all_[start - 1], 0) ^ np.where(own < 0, before[k], 0))
        last, n, before = conv[-1], int(number[-1]), [int(r[-1]) for r in runs]
        cols = [pa.array(np.full(len(conv), part, np.int32)), *(pa.array(x.astype(np.int64)) for x in (number, *runs)), *batch.columns]
        yield pa.RecordBatch.from_arrays(cols, ["part", "i", "xa", "xb", *batch.schema.names])


def scanned(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (conv_id, a, b and others, longs) with i, the number of the row in its conversation by ``order``, and xa, xb, the exclusive or of a and b up to it.

    Rows are dealt by ranges and each task scans its own; the last row of each task says where the next goes on, so no
    conversation is too long.
    """
    dealt = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    own = written(dealt.mapInArrow(_scan, "part int, i long, xa long, xb long, " + ", ".join(f"{c} long" for c in rows.columns)), "trie-scan")
    ends = own.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "i", "xa", "xb")).alias("end"))
    carried, conv, sums = [], None, (0, 0, 0)
    for e in ends.orderBy("part").collect():  # one row for each task
        if e["first"] == conv:
            carried.append((e["part"], conv, *sums))
        end = e["end"]
        goes_on = conv is not None and e["first"] == conv == end["conv_id"]
        sums = (sums[0] + end["i"], sums[1] ^ end["xa"], sums[2] ^ end["xb"]) if goes_on else (end["i"], end["xa"], end["xb"])
        conv = end["conv_id"]
    before = rows.sparkSession.createDataFrame(carried, "part int, conv_id long, _i long, _a long, _b long")
    zero = lambda c: F.coalesce(c, F.lit(0))
    all_ = own.join(F.broadcast(before), ["part", "conv_id"], "left")
    return all_.withColumns({"i": F.col("i") + zero("_i"), "xa": F.col("xa").bitwiseXOR(zero("_a")), "xb": F.col("xb").bitwiseXOR(zero("_b"))}).select("i", "xa", "xb", *rows.columns)


# ---- rebuilt conversations


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEADS + 1)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 1, a, b, bytes, length) of the rebuilt conversations, and the conversations (conv_id, length).

    Of each conversation c the first h turns come from c - c % 5 (all if that has fewer, none if it is absent), the others are its own after
    its first h; h is crc32 of c in decimal, modulo 9.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    names = F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role").alias("b")
    narrow = own.select("conv_id", "turn", *names, F.octet_length("text").cast("long").alias("bytes"))
    # a turn alone with its number is its group's only row; those that share one are put in the order of their texts
    by_number = narrow.groupBy("conv_id", "turn").agg(F.count("*").alias("k"), *[F.min(c).alias(c) for c in ("a", "b", "bytes")])
    by_number = written(by_number, "trie-turns")
    shared = written(by_number.where("k > 1").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")), "trie-ties")
    ties = own.join(shared, (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left_semi")
    order = ["conv_id", "turn", "role", "text"]
    ties = ties.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("tie", F.monotonically_increasing_id())
    ties = written(ties.select("conv_id", "turn", "tie", *names, F.octet_length("text").cast("long").alias("bytes")), "trie-ties")
    alone = by_number.where("k = 1").select("conv_id", "turn", F.lit(0).cast("long").alias("tie"), "a", "b", "bytes")
    turns = scanned(alone.unionByName(ties), ["turn", "tie"]).select("conv_id", "i", "a", "b", "bytes")
    h = head_length(F.col("conv_id"))
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("i") <= HEADS))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("i", "a", "b", "bytes"))).alias("head"))  # HEADS at most
    convs = turns.groupBy("conv_id").agg(F.max("i").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<i:long,a:long,b:long,bytes:long>>")), F.lit(1), h.cast("int")))
    length = F.size("head") + F.greatest(F.col("n") - h, F.lit(0))
    convs = written(convs.select("conv_id", "n", F.size("head").cast("long").alias("taken"), length.cast("long").alias("length"), "head"), "trie-conversations")
    after = join_hot(turns.where(F.col("i") > h), convs.drop("head"), "conv_id").select("conv_id", (F.col("i") - h + F.col("taken")).alias("pos"), "a", "b", "bytes", "length")
    given = convs.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", F.col("t.i").alias("pos"), "t.a", "t.b", "t.bytes", "length")
    return after.unionByName(given), convs.select("conv_id", "length")


# ---- tries in level order


class Louds:
    """A forest in level order.  ``bits``: for the root above all and then each node, a 1 for every child and a 0; ``order``: the rows that
    the labels come from, in level order; ``levels``: where each level begins, and the end."""

    def __init__(self, ka: np.ndarray, kb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, level: np.ndarray):
        n = len(ka)
        up = self._lookup(ka, kb, pa_, pb, level)
        by_level = np.lexsort((kb, ka, level))
        self.levels = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
        rank = np.full(n + 1, -1, np.int64)  # by row; the last is the root above all
        self.order = np.empty(n, np.int64)
        for lo, hi in zip(self.levels[:-1].tolist(), self.levels[1:].tolist(), strict=True):
            own = by_level[lo:hi]
            own = own[np.argsort(rank[up[own]], kind="stable")]
            rank[own] = np.arange(lo, hi)
            self.order[lo:hi] = own
        counts = np.zeros(n + 1, np.int64)
        np.add.at(counts, rank[up] + 1, 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(counts + 1) - 1] = False

    @staticmethod
    def _lookup(ka, kb, pa_, pb, level) -> np.ndarray:
        """The row of each row's parent, -1 for those of the first level."""
        at = np.argsort(ka, kind="stable")
        names = ka[at]
        if len(names) > 1 and (names[1:] == names[:-1]).any():  # half of a name is not enough here
            row_of = {k: i for i, k in enumerate(zip(ka.tolist(), kb.tolist(), strict=True))}
            found = np.array([row_of.get(k, -1) for k in zip(pa_.tolist(), pb.tolist(), strict=True)], np.int64)
        else:
            found = at[np.minimum(np.searchsorted(names, pa_), len(at) - 1)] if len(at) else np.zeros(0, np.int64)
            found = np.where((ka[found] == pa_) & (kb[found] == pb), found, -1)
        found = np.where(level == 0, -1, found)
        if (found[level > 0] < 0).any():
            raise AssertionError("a node without its parent")
        return found

    def parents(self) -> np.ndarray:
        """By select and rank: before the 1 of node j stand as many 0s as nodes, and the root above all, have been closed."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def children(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, by node in level order."""
        out, parents = values.copy(), self.parents()
        for lo, hi in zip(self.levels[-2:0:-1].tolist(), self.levels[:1:-1].tolist(), strict=True):
            np.add.at(out, parents[lo:hi], out[lo:hi])
        return out


_NODE = ["ka", "kb", "pa", "pb", "depth", "conv_id", "n_convs", "n_ends", "bytes"]
_OUT = ["ka", "kb", "pa", "pb", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "top"]
_OUT_SCHEMA = ", ".join(f"{c} long" for c in _OUT[:-1]) + ", top boolean"


def _rolled(c: dict[str, np.ndarray], level: np.ndarray) -> pa.RecordBatch:
    """A forest of whole trees, with what comes from outside of it (kids, leaves, saved), to its rows."""
    t = Louds(c["ka"], c["kb"], c["pa"], c["pb"], level)
    own = {k: v[t.order] for k, v in c.items()}  # the labels in level order
    parents, kids = t.parents(), t.children() + own["kids"]
    leaves = t.rollup(own["leaves"] + (kids == 0))
    saved = t.rollup(own["saved"] + (own["n_convs"] - 1) * own["bytes"])
    top = parents < 0
    parent_conv = pa.array(own["conv_id"][parents], pa.int64(), mask=top)
    cols = [pa.array(own[k]) for k in ("ka", "kb", "pa", "pb", "depth", "conv_id")]
    return pa.RecordBatch.from_arrays([*cols, parent_conv, pa.array(own["n_convs"]), *(pa.array(x.astype(np.int64)) for x in (kids, leaves, saved)), pa.array(top)], _OUT)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by (ca, cb), the root of their shard: whole shards, about BATCH_NODES nodes at once, in level order."""
    names = ["ca", "cb", *_NODE]
    held: list[np.ndarray] = []
    size = 0

    def roll(rows: np.ndarray) -> pa.RecordBatch:
        c = dict(zip(names, rows, strict=True))
        c |= {k: np.zeros(rows.shape[1], np.int64) for k in ("kids", "leaves", "saved")}
        cuts = np.flatnonzero(np.concatenate([[True], (c["ca"][1:] != c["ca"][:-1]) | (c["cb"][1:] != c["cb"][:-1])]))
        least = np.minimum.reduceat(c["depth"], cuts)
        return _rolled(c, c["depth"] - np.repeat(least, np.diff(np.append(cuts, rows.shape[1]))))

    for batch in batches:
        held.append(np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]))
        size += batch.num_rows
        if size >= BATCH_NODES:
            rows = np.concatenate(held, axis=1)
            whole = int(np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1])).max(initial=-1)) + 1
            held, size = [rows[:, whole:]], rows.shape[1] - whole
            if whole:
                yield roll(rows[:, :whole])
    if size:
        yield roll(np.concatenate(held, axis=1))


def _upper(first: int):
    """A band of the upper levels, from depth ``first`` on, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if any(b.num_rows for b in got):
            whole = pa.Table.from_batches(got)
            c = {n: whole.column(n).to_numpy() for n in whole.schema.names}
            yield _rolled(c, c["depth"] - first)

    return run


def _handed_up(out: DataFrame) -> DataFrame:
    """What the roots of finished trees give their parents: kids, leaves, saved by parent."""
    tops = out.where("top AND depth > 0")
    return tops.groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def _bands(upper: DataFrame) -> list[tuple[int, int]]:
    """First and last depths of bands of about BAND_NODES nodes, from the deepest."""
    deepest = upper.agg(F.max("depth")).first()[0] or 0
    step = deepest // BAND_COUNTS + 1
    counts = upper.groupBy(F.floor(F.col("depth") / step).alias("k")).count().orderBy(F.col("k").desc()).collect()  # BAND_COUNTS rows
    bands: list[list[int]] = []
    size = 0
    for k, n in counts:
        if bands and size + n <= BAND_NODES:
            bands[-1][0] = k
        else:
            bands.append([k, k])
            size = 0
        size += n
    return [(lo * step, hi * step + step - 1) for lo, hi in bands]


# ---- the ids of conversations that end at a node


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (ka, kb, conv_id): the hash of each node's ids; chunks of the ids of those nodes that may stand in other tasks, too, or are long."""
    part = TaskContext.get().partitionId()
    key, ids, chunk, first = None, [], 0, True
    out: list[tuple] = []

    def close(open_: bool) -> None:
        text = ",".join(map(str, ids))
        out.append((*key, part, chunk, text, None) if open_ else (*key, part, chunk, None, hashlib.sha256(text.encode()).hexdigest()))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["ka", "kb", "part", "chunk", "ids", "ends_sha256"])

    for batch in batches:
        for a, b, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (a, b) != key:
                if key is not None:
                    close(first or chunk > 0)
                    first = False
                key, ids, chunk = (a, b), [], 0
            elif len(ids) >= CHUNK_IDS:
                close(True)
                ids, chunk = [], chunk + 1
            ids.append(conv)
        yield batch_of(out)
        out = []
    if key is not None:
        close(True)
        yield batch_of(out)


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (ka, kb, part, chunk), one after the other into their node's hash."""
    key, digest = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
            if (a, b) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _hash_batch(done)
    if key is not None:
        yield _hash_batch([(*key, digest.hexdigest())])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string()], strict=True)], ["ka", "kb", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """ka, kb, ends_sha256 of the rows (ka, kb, conv_id): the ids of each node in numerical order, comma-joined, hashed.  A node's ids may fill many tasks; what
    one task reads of it in the end are chunks of CHUNK_IDS ids."""
    order = ["ka", "kb", "conv_id"]
    found = written(ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ends, "ka long, kb long, part long, chunk long, ids string, ends_sha256 string"), "trie-ends")
    chunks = found.where("ends_sha256 IS NULL").repartition("ka", "kb").sortWithinPartitions("ka", "kb", "part", "chunk")
    return found.where("ends_sha256 IS NOT NULL").select("ka", "kb", "ends_sha256").unionByName(chunks.mapInArrow(_joined_ends, "ka long, kb long, ends_sha256 string"))


# ---- the trie


def trie(turns: DataFrame, convs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (conv_id, pos from 1 without gaps, a, b: two hashes of the turn, bytes, length of the conversation), of the
    conversations ``convs`` (conv_id, length): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    salted = turns.withColumns({"a": F.xxhash64("pos", "a"), "b": F.xxhash64("b", "pos")})
    names = {"ka": F.col("xa"), "kb": F.col("xb"), "pa": F.col("xa").bitwiseXOR(F.col("a")), "pb": F.col("xb").bitwiseXOR(F.col("b"))}
    paths = scanned(salted, ["pos"]).withColumns(names).select("conv_id", "pos", "bytes", "length", *names)
    least = [F.min(c).alias(n) for c, n in (("pa", "pa"), ("pb", "pb"), ("pos", "depth"), ("conv_id", "conv_id"), ("bytes", "bytes"))]
    counted = [F.count("*").alias("n_convs"), F.count_if(F.col("pos") == F.col("length")).alias("n_ends"), F.sum(F.col("length") - F.col("pos") + 1).alias("below")]
    nodes = written(paths.groupBy("ka", "kb").agg(*least, *counted), "trie-nodes")
    limit = max(shard_rows, (nodes.agg(F.sum("n_convs")).first()[0] or 0) // SHARD_SHARE)
    heavy = written(nodes.where(F.col("below") > limit).select(_NODE), "trie-upper")

    # the root of the shard on each conversation's path: its first node that is not an upper one
    names_up = heavy.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.lit(True).alias("up"))
    cut = paths.join(names_up, ["pa", "pb"], "left").where("pos = 1 OR up").join(heavy.select("ka", "kb"), ["ka", "kb"], "left_anti")
    cut = cut.select("conv_id", F.col("ka").alias("ca"), F.col("kb").alias("cb"), F.col("length").alias("n"))
    light = join_hot(nodes.where(F.col("below") <= limit).select(_NODE), cut, "conv_id").select("ca", "cb", *_NODE)
    low = written(light.repartition("ca", "cb").sortWithinPartitions("ca", "cb").mapInArrow(_shards, _OUT_SCHEMA), "trie-shards")

    zero = F.lit(0).cast("long")
    root = convs.agg(*[zero.alias(c) for c in _NODE[:5]], F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends"), zero.alias("bytes"))
    upper = written(heavy.unionByName(root.where("n_convs > 0")), "trie-upper")
    up, out = _handed_up(low), low
    for first, last in _bands(upper):
        band = upper.where(F.col("depth").between(first, last)).join(up, ["ka", "kb"], "left").fillna(0, ["kids", "leaves", "saved"])
        done = written(band.coalesce(1).mapInArrow(_upper(first), _OUT_SCHEMA), "trie-band")
        # shards may hang at any depth: their shares wait with those of the band
        up, out = _handed_up(low).unionByName(_handed_up(done)).groupBy("ka", "kb").agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")]), out.unionByName(done)
    above = upper.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("above"))
    tops = out.where("top AND depth > 0").join(above, ["pa", "pb"], "left").withColumn("parent_conv_id", F.col("above")).select(_OUT)
    found = out.where("NOT top OR depth = 0").select(_OUT).unionByName(tops)
    ends = paths.where("pos = length").select("ka", "kb", "conv_id").unionByName(convs.where("length = 0").select(zero.alias("ka"), zero.alias("kb"), "conv_id"))
    hashed = found.join(end_hashes(ends), ["ka", "kb"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return hashed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The prefix trie of the rebuilt ``conversations`` (conv_id, turn, role, text), one row a node; see ``rebuilt`` and ``trie``.

    Null roles and texts count as empty ones.  Turns are ordered by number, null first; turns of equal number by role, then text, so that repeated rows and ties
    have one order.  Rows without conv_id belong to no conversation and are left out.  A conversation that is left without a turn is a member of the root.
    An empty table gives an empty result; other columns are not read.
    """
    turns, convs = rebuilt(conversations)
    return trie(turns.select("conv_id", "pos", "a", "b", "bytes", "length"), convs, shard_rows)


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
