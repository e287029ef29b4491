"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits: a bit is 1 if it is set in more than half of the XXH64 hashes
of the document's word shingles.  Fingerprints that differ in at most ``radius`` bits are linked and
the links' connected components are the groups of near-duplicates.

Candidates come from structured bit masks.  Every bit position ``i`` gets a vector ``m(i)`` of
``radius + 1`` bits; table ``v`` (each non-zero vector) keeps the bits with ``<m(i), v> = 1``.  At most
``radius`` differing positions span at most ``radius`` dimensions, so some ``v`` is orthogonal to all
of them: its table keeps none of the differing bits and the pair shares a bucket there.  No pair is
lost, whatever the data.

Distinct fingerprints are compared, never documents: a thousand exact copies are one fingerprint.
Buckets stream through sorted partitions and give a spanning forest, never all pairs.  A bucket beyond
``bucket_limit`` goes on to another level, which masks the bits not yet used in the same covering
way; keys grow with each level (about 32, 48, 56 bits), so that the third level's buckets differ in some
eight bits and hold a few hundred distinct fingerprints.

``first_of_copies`` groups by a wider rule, for near copies whose shingle fingerprints are too far apart.  A changed word changes as many
shingles as a shingle has words, but only one or two of a text's distinct words, so fingerprints of the distinct words
stay within the radius; several with hashes of their own make up for each other's misses.  Pairs within the radius of such a
word fingerprint are linked if their shingle fingerprints differ in at most ``side`` bits, which are 13 of 64 for a similarity
of 0.8 of the five-word shingles (8.7 bits differ on average at 0.8, with a deviation of 2.7), and if one of BANDS least shingles is the same
(but for one pair in 7,000 at a similarity of 0.83 of the shingles).

Texts of the same words in other orders or numbers share their word fingerprints, however many they are, and no finer mask parts
them.  So a full bucket of such nodes is dealt by the least shingles instead: whatever the rule links has one in common, so no link is lost,
and a text goes to BANDS buckets, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import drop_written, join_hot, own_columns, table, text_batches, written

SHINGLE = 4
RADIUS = 4
BUCKET_LIMIT = 4096
LEVELS = 3
PRINT = "simhash_fingerprint"
SEEDS = 3
SIDE = 13
BANDS, BAND_BITS = 5, 12
#: Members of a bucket's largest component that others are compared with first.
HUBS = 64


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 for null and for texts without a word.

    A bit that exactly half of the hashes set is 0.
    """
    return shingle_print(words_of(text), shingle)


def word_prints(words: list[bytes], seeds: int = SEEDS) -> list[int]:
    """Fingerprints of the distinct words, one for each seed; 0 without a word."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, 42) for w in sorted(set(words))], np.uint64)
    out = []
    for k in range(seeds):
        g = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
        g = (g ^ g >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93)
        out.append(_majority(g ^ g >> np.uint64(32)) if len(g) else 0)
    return out


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle; of the whole sequence if it has fewer words."""
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(joined, seed=42)] if words else [], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def shingle_print(words: list[bytes], shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(words, shingle)
    return _majority(hashes) if len(hashes) else 0


def least_shingles(hashes: np.ndarray) -> int:
    """BANDS pieces of BAND_BITS bits, each of the least of the hashes in an order of its own; 0 without a hash."""
    out = 0
    for k in range(BANDS if len(hashes) else 0):
        g = (hashes ^ hashes >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD + 2 * k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        g = (g ^ g >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
        out |= (int(g.min()) * 0x9E3779B97F4A7C15 >> 40 & (1 << BAND_BITS) - 1) << k * BAND_BITS
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        out = [_signed(fingerprint(texts[i].as_py())) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for each row of ``docs``."""
    return own_columns(docs, doc_id="long", text="string").mapInArrow(_fingerprints, "doc_id long, fp long")


KINDS = ["side", "bands", *(f"w{k}" for k in range(SEEDS))]


def _all_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rows = batch.column(0), []
        for i in range(len(texts)):
            words = words_of(texts[i].as_py())
            hashes = shingle_hashes(words)
            rows.append([_signed(x) for x in (_majority(hashes) if len(hashes) else 0, least_shingles(hashes), *word_prints(words))])
        kinds = KINDS
        found = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(kinds))]
        yield pa.RecordBatch.from_arrays([*found, *batch.columns[1:]], [*kinds, *batch.schema.names[1:]])


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """The ``2 ** (radius + 1) - 1`` masks over the given bit positions.

    The vectors of one bit come first, so that any ``radius + 1`` positions span all dimensions and no mask is empty.
    """
    size = 1 << (radius + 1)
    vectors = sorted(range(1, size), key=lambda m: (m & m - 1 != 0, m))
    of = {p: vectors[k % (size - 1)] for k, p in enumerate(positions)}
    return [sum(1 << p for p, m in of.items() if (m & v).bit_count() % 2) for v in range(1, size)]


def _unused(mask: int) -> list[int]:
    return [p for p in range(64) if not mask >> p & 1]


def _spanning(rows: np.ndarray, radius: int, side: int | None, block: int = 1024) -> list[tuple[int, int]]:
    """Links within one bucket: a spanning forest of the pairs within the radius, smallest root first.

    ``rows`` has a row for each of fp (and node, its shingle fingerprint and its least shingles, if ``side`` bounds the differences of these).  Pairs within the
    largest component of the first block, and what joins it, are not compared with each other.
    """
    rows = rows[:, np.argsort(rows[0] if side is None else rows[1], kind="stable")]
    names = rows[0] if side is None else rows[1]
    n = rows.shape[1]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bits = rows[0].view(np.uint64)
    sides, bands = (None, None) if side is None else (rows[2].view(np.uint64), rows[3].view(np.uint64))
    out = []

    def link(left: np.ndarray, right: np.ndarray) -> None:
        near = np.bitwise_count(bits[left, None] ^ bits[None, right]) <= radius
        if sides is not None:
            near &= np.bitwise_count(sides[left, None] ^ sides[None, right]) <= side
        i, j = np.nonzero(near)
        x, y = left[i], right[j]
        if bands is not None and len(x):
            apart = bands[x] ^ bands[y]
            same = np.zeros(len(x), bool)
            for k in range(BANDS):
                same |= apart >> np.uint64(k * BAND_BITS) & np.uint64((1 << BAND_BITS) - 1) == 0
            x, y = x[same], y[same]
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((int(names[min(a, b)]), int(names[max(a, b)])))

    first = np.arange(min(n, block))
    link(first, first)
    if n <= block:
        return out
    roots = np.array([root(int(x)) for x in first])
    largest = np.bincount(roots).argmax()
    hubs = np.flatnonzero(roots == largest)[:HUBS]
    for at in range(block, n, block):
        link(np.arange(at, min(n, at + block)), hubs)
    inner = np.array([root(x) for x in range(n)]) == root(int(largest))
    outer = np.flatnonzero(~inner)
    everyone = np.arange(n)
    for at in range(0, len(outer), block):  # each pair but those inside
        for to in range(0, n, block):
            link(outer[at : at + block], everyone[to : to + block])
    return out


def _link_buckets(radius: int, limit: int, side: int | None = None):
    """Rows sorted by (t, key, fp), of t, key and what ``_spanning`` takes -> links, and the rows of buckets beyond ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_id, spilled = None, False
        for batch in batches:
            t, key, *own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
            if not len(t):
                continue
            rows = np.stack(own)
            links: list[tuple[int, int]] = []
            over: list[tuple[int, np.ndarray]] = []
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(t)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                this = (int(t[lo]), int(key[lo]))
                if this != held_id:
                    if held_id is not None and not spilled and sum(x.shape[1] for x in held) > 1:
                        links += _spanning(np.concatenate(held, axis=1), radius, side)
                    held, held_id, spilled = [], this, False
                held.append(rows[:, lo:hi])
                if limit and (spilled or sum(x.shape[1] for x in held) > limit):  # a bucket is never held beyond the limit, and spills to its end
                    over += [(held_id[0], x) for x in held]
                    held, spilled = [], True
            yield _link_batch(links, over, len(own))
        if held_id is not None and not spilled and sum(x.shape[1] for x in held) > 1:
            yield _link_batch(_spanning(np.concatenate(held, axis=1), radius, side), [], len(held[0]))

    return run


def _link_batch(links: list[tuple[int, int]], over: list[tuple[int, np.ndarray]], width: int) -> pa.RecordBatch:
    """a, b of the links; over (the table), fp, node and side of the others."""
    a, b = zip(*links, strict=True) if links else ((), ())
    rows = np.concatenate([x for _, x in over], axis=1) if over else np.zeros((width, 0), np.int64)
    tables = np.repeat(np.array([t for t, _ in over], np.int64), [x.shape[1] for _, x in over]) if over else np.zeros(0, np.int64)
    cols = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(len(tables), pa.int64())]) for x in (a, b)]
    return pa.RecordBatch.from_arrays([*cols, *(pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(x)]) for x in (tables, *rows))], ["a", "b", "over", "fp", "node", "side", "bands"][: 3 + width])


def _dealt(keyed: DataFrame, radius: int, limit: int, side: int | None, own: list[str], name: str) -> DataFrame:
    """a, b of the links within the buckets (t, key); over and ``own`` of the rows of those beyond the limit."""
    dealt = keyed.select("t", "key", *own).repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return written(dealt.mapInArrow(_link_buckets(radius, limit, side), "a long, b long, over long, " + ", ".join(f"{c} long" for c in own)), name)


def links(distinct: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """a, b: links that connect exactly the fingerprints (column fp, distinct) within the radius.  Buckets of the last level differ in a few bits and are held whole."""
    spark = distinct.sparkSession
    masks, out = {0: 0}, None
    rows = distinct.select(F.lit(0).cast("long").alias("at"), "fp")
    for level in range(1, LEVELS + 1):
        finer = [(at, at * 64 + k + 1, m | mask) for at, m in masks.items() for k, mask in enumerate(covering_masks(_unused(m), radius))]
        tables = spark.createDataFrame([(at, t, _signed(m)) for at, t, m in finer], "at long, t long, mask long")
        keyed = rows.join(F.broadcast(tables), "at").withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))  # masks: LEVELS and the radius bound them
        found = _dealt(keyed, radius, bucket_limit if level < LEVELS else 0, None, ["fp"], f"simhash-links-{level}")
        linked = found.where("over IS NULL").select("a", "b")
        out = linked if out is None else out.unionByName(linked)
        over = {r["over"] for r in found.where("over IS NOT NULL").select("over").distinct().collect()}  # tables of the level: 31, then 961
        if not over:
            break
        masks = {t: m for _, t, m in finer if t in over}
        rows = found.where("over IS NOT NULL").select(F.col("over").alias("at"), "fp")
    return out


def node_links(nodes: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT, side: int = SIDE) -> DataFrame:
    """a, b: links that connect exactly the nodes (fp, node, side, bands) that the rule of ``first_of_copies`` links: fps within the radius, sides within ``side`` bits, and a
    least shingle in common.  A full bucket is dealt once more by the least shingles, each with its number; such a bucket is held whole, and what hangs
    together with its largest component isn't compared with itself."""
    own = ["fp", "node", "side", "bands"]
    masks = [_signed(m) for m in covering_masks(list(range(64)), radius)]
    tables = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks, 1)])
    found = _dealt(nodes.select(*own, F.explode(tables).alias("m")).select("m.*", *own), radius, bucket_limit, side, own, "simhash-links-1")
    masked = F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("over").cast("int")))
    pieces = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("bands", k * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).alias("piece")) for k in range(BANDS)])
    parted = found.where("over IS NOT NULL").select(F.col("over").alias("t"), masked.alias("masked"), *own, F.explode(pieces).alias("b")).withColumn("key", F.xxhash64("masked", "b.k", "b.piece"))
    finer = _dealt(parted, radius, 0, side, own, "simhash-links-2")
    return found.where("over IS NULL").select("a", "b").unionByName(finer.select("a", "b"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links -> each of its nodes with the smallest node that they connect it to."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while (p := parent.get(r, r)) != r:
            r = p
        while (p := parent.get(x, x)) != r:
            parent[x] = r
            x = p
        return r

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for at in range(0, len(nodes), 65536):
        part = nodes[at : at + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for each node of the edges (a, b).

    First each partition shrinks its edges to a forest.  Then large-star and small-star rounds follow
    until nothing changes; each round is two aggregations with map-side combining, whose minima are joined
    back to the edges, and its result is written to the shared folder.
    """
    e = written(edges.mapInArrow(_forest, "a long, b long").where("a <> b").distinct(), "cc-0")
    before = None
    for k in range(1, max_rounds + 1):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        # large star: the larger neighbours of each node link to its smallest
        large = join_hot(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, f"cc-{k}-large")
        # small star: a node and its smaller neighbours link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, "a").select(F.col("b").alias("x"), "m", "a")
        nxt = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = written(nxt, f"cc-{k}")
        drop_written(e)
        drop_written(large)
        e = nxt
        # the edges as a set, in two numbers
        this = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if this == before:
            break
        before = this
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _address(docs: DataFrame) -> DataFrame:
    """``docs``, read from files, with _file (a hash of the path) and _row: where each row stands."""
    meta = F.col("_metadata")
    return docs.select("*", F.xxhash64(meta["file_path"]).alias("_file"), meta["row_index"].alias("_row"))


def first_of_copies(docs: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT, side: int = SIDE) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their group of near copies: the smallest doc_id, then the place in the files.

    Documents are grouped by the word fingerprints, the shingle fingerprint and the least shingles (see above); pairs within ``radius`` of each other by the
    shingle fingerprint alone are linked, too.  One row of each group stays, whatever ids repeat; a row without an id stays only where
    none of its group has one.  Rows without a word are copies of each other.  ``docs`` is written first if it isn't read from files.  An empty
    table gives an empty result.
    """
    try:
        placed = _address(docs)
    except AnalysisException:
        docs = written(docs, "simhash-docs")
        placed = _address(docs)
    own = text_batches(placed).select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), "_file", "_row")
    schema = ", ".join(f"{c} long" for c in (*KINDS, "doc_id")) + ", _file long, _row long"
    prints = written(own.mapInArrow(_all_prints, schema).withColumn("node", F.xxhash64(*KINDS)), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row")).alias("first")
    nodes = written(prints.groupBy("node", *KINDS).agg(first), "simhash-nodes")
    # by the shingle fingerprint alone: its distinct values, each named by one of its nodes
    by_side = written(nodes.groupBy("side").agg(F.min("node").alias("hub")), "simhash-sides")
    hubs = by_side.select(F.col("side").alias("a"), F.col("hub").alias("_a")), by_side.select(F.col("side").alias("b"), F.col("hub").alias("_b"))
    found = links(by_side.select(F.col("side").alias("fp")), radius, bucket_limit).join(hubs[0], "a").join(hubs[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    found = found.unionByName(join_hot(nodes.select("node", "side"), nodes.groupBy("side").agg(F.min("node").alias("hub"), F.count("*").alias("n")), "side").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    for k in range(SEEDS):
        found = found.unionByName(node_links(nodes.select(F.col(f"w{k}").alias("fp"), "node", "side", "bands"), radius, bucket_limit, side))
    comp = written(components(found), "simhash-components")
    # nodes are distinct on both sides; the minima of a group are combined before they are shuffled
    grouped = nodes.join(comp, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    keep = grouped.select("first._file", "first._row")
    # the rows to go are the fewer: their places are sent to the texts if they are small, else texts are shuffled, once
    gone = written(prints.select("_file", "_row").join(keep, ["_file", "_row"], "left_anti"), "simhash-gone")
    return placed.join(gone, ["_file", "_row"], "left_anti").select(docs.columns)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs`` (doc_id, text).

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any others.
    Repeated rows stay as often as they come.  A null doc_id keeps its row; component_id is the smallest doc_id of
    the component that isn't null, and null if there is none.  An empty table gives an empty result;
    other columns are not read.
    """
    prints = written(fingerprints(docs), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    comp = written(components(links(distinct, radius, bucket_limit)), "simhash-components")
    # fingerprints in a component of several; the others stand alone with their own copies
    several = written(distinct.join(comp.withColumnRenamed("node", "fp"), "fp"), "simhash-several")
    least = several.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_several = join_hot(several.select("fp", "root", F.col("n").alias("copies")), least, "root").select("fp", "component_id", F.col("copies").alias("n"))
    alone = distinct.join(several.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "n")
    return join_hot(prints, of_several.unionByName(alone), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
