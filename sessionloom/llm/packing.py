"""Best-fit packing of tokenized documents into sequences, by a grouping genetic algorithm.

1. Every document is tokenized where it lies and cut into pieces of at most ``capacity`` tokens.  Only the
   pieces' lengths go on; token ids never move for the packing itself.
2. Pieces of full length are sequences of their own.  The others are dealt by hash into blocks of about
   ``block`` pieces, each a bin-packing problem of bounded size, however large the corpus is.
3. Each block is solved on several islands.  An island's individuals are packings whose genes are whole
   bins.  Crossover injects well-filled bins of one parent into the other, drops the bins that share a
   piece with them and puts the displaced pieces back by best fit, largest first.  After each epoch, each
   island sends its elite to the next island of the block.  A block whose packing meets the lower bound
   ``ceil(tokens / capacity)`` is proven optimal and rests.
4. The worst-filled bin of each block goes into a second, far smaller round over many blocks together, so
   that what is lost to dealing into blocks is won back.
"""

from __future__ import annotations

import bisect
import os
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import own_columns, table, written

CAPACITY = 2048
END = 0
BLOCK = 8192
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 30
POPULATION = 6
REMAINDER_BLOCKS = 512
CACHE = 400_000
CACHED_CHARS = 48
#: The tokenizer's word pattern for characters below U+0250: contractions, runs of letters, single numbers, runs of other marks.
_LETTERS, _NUMBERS, _BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")
BEYOND = re.compile("[\u0250-\U0010ffff]")
STEP_CHARS = 1 << 20


class IdBytes:
    """Texts to token ids as little-endian 32-bit integers, exactly as the tokenizer gives them.

    A text of characters below U+0250, whose words can be told by fixed ranges, is split here into the tokenizer's lower-case words;
    the words' ids are kept in a cache of bounded size, and new words are joined and sent through the tokenizer's merges in
    one call.  Other texts, and those with special tokens, go through the tokenizer as they are.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown: dict[int, str] = {}  # the tokenizer's printable character of each byte
        for c in range(0x250):
            for byte, sign in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0], strict=True):
                self.shown[byte] = sign
        del self.shown[32]
        self.ids: dict[str, bytes] = {}
        self.cache = cache

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            shown = " ".join(part).encode().decode("latin-1").translate(self.shown)  # no word holds a space
            ids = np.asarray(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer's words have no ends")
            data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.ids.update({w: data[a:b] for w, a, b in zip(part, cuts[:-1], cuts[1:], strict=True)})

    def __call__(self, texts: list[str]) -> list[bytes]:
        words: list[list[str] | None] = []
        for t in texts:
            low = t.lower()
            far = not low.isascii() and (BEYOND.search(low) or BEYOND.search(t))
            words.append(None if far or "<|" in t else WORDS.findall(low))
        ids = self.ids
        if len(ids) > self.cache:
            ids.clear()
        new = list(set().union(*(s for s in words if s)).difference(ids))
        if new:
            self._learn(new)
        out = [b"".join([ids[w] for w in s]) if s is not None else self._whole(t) for s, t in zip(words, texts, strict=True)]
        for w in new:
            if len(w) > CACHED_CHARS:
                del ids[w]
        return out


_encoders: dict[str, IdBytes] = {}


def id_bytes(path: str) -> IdBytes:
    """The encoder of this Python worker, whose cache serves one task after the other."""
    if path not in _encoders:
        _encoders[path] = IdBytes(path)
    return _encoders[path]


def _cut(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, uid = id_bytes(path), TaskContext.get().partitionId() << 40
        end = np.asarray([END], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                part, size, first = [], 0, at
                while at < len(texts) and size < STEP_CHARS:
                    part.append(texts[at].as_py() or "")
                    size += len(part[-1])
                    at += 1
                rows: list[tuple] = []
                for k, data in enumerate(encode(part)):
                    data += end
                    doc = ids[first + k].as_py()
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[start : start + 4 * capacity]
                        rows.append((uid, doc, piece, start // 4, len(own) // 4, zlib.crc32(own), *([own] if with_ids else [])))
                        uid += 1
                cols = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit) of each piece of each document."""
    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return own_columns(docs, doc_id="long", text="string").mapInArrow(_cut(tokenizer_path, capacity, with_ids), schema)


class _Fit:
    """Best fit: bins by the room that they have left, with a bit set of the rooms that occur."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.rooms = capacity, {}, 0

    def add(self, items: list[int], room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(items)
            self.rooms |= 1 << room

    def put(self, item: int, size: int, bins: list[list[int]]) -> None:
        fits = self.rooms >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            found = self.by_room[room]
            target = found.pop()
            if not found:
                self.rooms ^= 1 << room
        else:
            room, target = self.capacity, []
            bins.append(target)
        target.append(item)
        self.add(target, room - size)


def _best_fit(order: list[int], sizes: list[int], capacity: int, kept: list[list[int]]) -> list[list[int]]:
    """The kept bins, with the items of ``order`` put by best fit into them and into new bins."""
    bins, fit = [list(b) for b in kept], _Fit(capacity)
    for b in bins:
        fit.add(b, capacity - sum([sizes[i] for i in b]))
    for i in order:
        fit.put(i, sizes[i], bins)
    return bins


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; among as many, the more unequal filling."""
    return -len(bins), sum((sum([sizes[i] for i in b]) / capacity) ** 2 for b in bins)


def _swap_in(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Bins that aren't full take a larger loose item in place of one of their own, that which fills them best: what is left loose gets smaller."""
    pool = sorted((sizes[i], i) for i in loose)
    for b in bins:
        room = capacity - sum([sizes[i] for i in b])
        while room and pool:
            gain, out, at = 0, -1, -1
            for i in b:
                k = bisect.bisect_right(pool, (sizes[i] + room, len(sizes))) - 1
                if k >= 0 and pool[k][0] - sizes[i] > gain:
                    gain, out, at = pool[k][0] - sizes[i], i, k
            if not gain:
                break
            b.remove(out)
            b.append(pool.pop(at)[1])
            bisect.insort(pool, (sizes[out], out))
            room -= gain
    return [i for _, i in reversed(pool)]


def _cross(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    fills = sorted(((sum([sizes[i] for i in x]), k) for k, x in enumerate(b)), reverse=True)
    well = [b[k] for _, k in fills[: max(1, len(fills) // 2)]]
    injected = rng.sample(well, max(1, len(well) // 2))
    taken = {i for x in injected for i in x}
    kept, displaced = [list(x) for x in injected], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return _best_fit(_swap_in(kept, displaced, sizes, capacity), sizes, capacity, kept)


def _mutate(a: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The worst-filled bins and a few others are emptied and their items put back in random order."""
    fills = sorted((sum([sizes[i] for i in x]), k) for k, x in enumerate(a))
    out = {k for _, k in fills[: max(1, len(a) // 50)]} | set(rng.sample(range(len(a)), min(len(a), max(1, len(a) // 50))))
    loose, kept = [i for k in out for i in a[k]], [list(x) for k, x in enumerate(a) if k not in out]
    rng.shuffle(kept)
    return _best_fit(_swap_in(kept, loose, sizes, capacity), sizes, capacity, kept)


def evolve(sizes: list[int], seeds: list[list[int]], capacity: int, generations: int, population: int, seed: int) -> tuple[list[list[int]], bool]:
    """The last population, each packing as the bin of each item and the best first, and whether that is proven optimal.

    ``seeds`` are packings from before: a population that goes on, and those that came from elsewhere.  Sizes are from 1 to ``capacity``.
    """
    rng, least = random.Random(seed), -(-sum(sizes) // capacity)
    down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people: list[list[list[int]]] = []
    for s in seeds:
        by: dict[int, list[int]] = {}
        for i, b in enumerate(s):
            by.setdefault(b, []).append(i)
        people.append(list(by.values()))
    if not people:
        people.append(_best_fit(down, sizes, capacity, []))
    rate = lambda x: _fitness(x, sizes, capacity)
    rated = sorted(((rate(x), -k, x) for k, x in enumerate(people)), reverse=True)
    if -rated[0][0][0] > least:
        while len(rated) < population:
            noisy = sorted(down, key=lambda i: -sizes[i] * (1 + 0.2 * rng.random()))
            new = _best_fit(noisy, sizes, capacity, [])
            rated.append((rate(new), -len(rated), new))
        rated = sorted(rated, reverse=True)[:population]
        for born in range(len(people) + population, len(people) + population + generations):
            if -rated[0][0][0] <= least:
                break
            child = _cross(rng.choice(rated)[2], rated[rng.randrange(max(1, len(rated) // 2))][2], sizes, capacity, rng)
            if rng.random() < 0.5:
                child = _mutate(child, sizes, capacity, rng)
            rated = sorted([*rated, (rate(child), -born, child)], reverse=True)[:population]
    out = []
    for _, _, bins in rated:
        genome = [0] * len(sizes)
        for k, b in enumerate(bins):
            for i in b:
                genome[i] = k
        out.append(genome)
    return out, -rated[0][0][0] <= least


_EVOLVED = "block long, island int, uids array<long>, sizes array<int>, genome array<int>, people array<array<int>>, bins int, optimal boolean"


def _epoch(capacity: int, generations: int, population: int, number: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                sizes = [int(x) for x in r.sizes]
                seeds = [[int(b) for b in s] for s in r.seeds] if r.seeds is not None else []
                people, optimal = evolve(sizes, seeds, capacity, generations, population, hash((int(r.block), int(r.island), number)))
                yield pd.DataFrame({"block": [r.block], "island": [r.island], "uids": [r.uids], "sizes": [r.sizes], "genome": [people[0]], "people": [people[: 1 if optimal else None]], "bins": [max(people[0]) + 1], "optimal": [optimal]})

    return run


def _solve(items: DataFrame, capacity: int, islands: int, epochs: int, generations: int, population: int, name: str) -> DataFrame:
    """items: block, uid, length -> block, uid, length, bin."""
    rows = items.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("x"))  # a block has a bounded number
    rows = written(rows.select("block", F.col("x.uid").alias("uids"), F.col("x.length").cast("array<int>").alias("sizes")), f"{name}-blocks")
    seeds = F.lit(None).cast("array<array<int>>")
    # a first individual for each block; the islands are only for the blocks that it doesn't solve
    state = written(rows.withColumns({"island": F.lit(0), "seeds": seeds}).mapInPandas(_epoch(capacity, 0, 1, 0), _EVOLVED), f"{name}-0")
    done = [state.where("optimal")]
    elites = state.where("NOT optimal")
    for k in range(1, epochs + 1):
        if elites.isEmpty():
            break
        if k == 1:  # every island starts from the first packing
            parents = elites.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("people").alias("seeds"))
        else:  # an island's population goes on, with its neighbour's elite
            sent = elites.select("block", ((F.col("island") + 1) % islands).alias("island"), F.array("genome").alias("elite"))
            parents = elites.join(sent, ["block", "island"]).select("block", "island", F.concat("people", "elite").alias("seeds"))
        start = rows.join(parents, "block")
        state = written(start.mapInPandas(_epoch(capacity, generations, population, k), _EVOLVED), f"{name}-{k}")
        solved = state.where("optimal").groupBy("block").agg(F.min("island").alias("island"))
        done.append(state.join(solved, ["block", "island"], "left_semi"))
        elites = state.join(solved, "block", "left_anti")
    best = elites.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("b")).select("block", F.col("b.island").alias("island"))
    done.append(elites.join(best, ["block", "island"], "left_semi"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    each = out.select("block", F.explode(F.arrays_zip("uids", "sizes", "genome")).alias("x"))
    return each.select("block", F.col("x.uids").alias("uid"), F.col("x.sizes").cast("long").alias("length"), F.col("x.genome").alias("bin"))


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    block: int = BLOCK,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
    population: int = POPULATION,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece of each document.

    A null or empty text is a document of the end token alone.  Repeated rows are documents of their own.  A null doc_id
    keeps its row.  An empty table gives an empty result; other columns are not read.  Pieces of equal length are
    told apart by their place in the table, so that the result is the same for the same files.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    cut = written(pieces(docs, tokenizer_path, capacity, with_ids), "packing-pieces")
    short = cut.where(F.col("length") < capacity).select("uid", "length")
    n_blocks = max(1, round(short.count() / block))
    items = short.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)))
    solved = written(_solve(items, capacity, islands, epochs, generations, population, "packing"), "packing-solved")
    if n_blocks > 1:
        fills = solved.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        worst = written(fills.groupBy("block").agg(F.min(F.struct("fill", "bin")).alias("w")).select("block", F.col("w.bin").alias("bin")), "packing-worst")
        again = solved.join(worst, ["block", "bin"], "left_semi").select("uid", "length", (F.lit(n_blocks) + F.floor(F.col("block") / REMAINDER_BLOCKS)).alias("block"))
        rest = _solve(again, capacity, islands, epochs, generations, population, "packing-rest")
        solved = solved.join(worst, ["block", "bin"], "left_anti").select("block", "uid", "length", "bin").unionByName(rest)
        solved = written(solved, "packing-all")
    own_bin = F.shiftleft(F.col("block"), 24) + F.col("bin")
    placed = solved.select("uid", (own_bin * 2).alias("sequence_id"), "length")
    before = F.array_sort(F.collect_list(F.struct("uid", "length")))
    total = F.aggregate(  # running sums within a sequence
        "x",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<uid:bigint,offset:bigint>>").alias("out")),
        lambda s, x: F.struct((s["at"] + x["length"]).alias("at"), F.concat(s["out"], F.array(F.struct(x["uid"].alias("uid"), s["at"].alias("offset")))).alias("out")),
        lambda s: s["out"],
    )
    offsets = placed.groupBy("sequence_id").agg(before.alias("x")).select("sequence_id", F.explode(total).alias("o"))
    offsets = offsets.select("sequence_id", F.col("o.uid").alias("uid"), F.col("o.offset").alias("offset"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    full = cut.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("uid") * 2 + 1, "offset": F.lit(0).cast("long")})
    return cut.join(offsets, "uid").select(*columns).unionByName(full.select(*columns))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of each sequence (of at most ``capacity``), from ``pack(with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
