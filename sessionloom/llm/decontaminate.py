"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Every stretch of ``window`` characters of a benchmark item is a window, and so is a shorter item as a whole.  A window of ``m`` characters within
``e`` edits of a stretch of text shares at least ``m - q + 1 - q * e`` of its q-grams with it, at diagonals (text place minus
window place) that differ by at most ``e``.  The shared q-grams are therefore counted by piece of an item in diagonal bands of width
``2 * (e + 1)`` that overlap by half, so that some band holds all of a match's diagonals.  Bands that meet the bound keep
their regions, and a banded alignment decides for each window, at every start, whether it is there within its edit budget: a
passage of ``window`` characters is found wherever it stands in its item.  Items of fewer than q characters are looked for verbatim, as whole words.

The q-gram index is the small side: it is built for blocks of items with at most ``block_chars`` characters and sent to the
executors block by block, so that its size is bounded however large the benchmark grows; documents are read once a block and
never shuffled.  All q-grams of whole texts are looked up, a bounded number of hits at a time; there is no cap on matches or candidates.
A stretch that repeats a few characters over and over is shortened to what the longest match can reach.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import own_columns, table, text_batches

Q = 8
WINDOW = 120
EDIT_SHARE = 0.1
BLOCK_CHARS = 4_000_000
STEP_CHARS = 1 << 18
HIT_STEP = 1 << 18
PIECE = 1024
PERIODS = 8
ALIGN_STEP = 1 << 12
_P1, _P2, _P4, _GOLD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F)


def normal(text: str | None) -> str:
    """Lower case, white space made single, no NUL."""
    return " ".join(text.replace("\0", " ").lower().split()) if text else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """32-bit hashes of the 8-grams at each place."""
    if len(c) < Q:
        return np.zeros(0, np.uint32)
    h = c[:-1] * _P1 + c[1:]
    h = h[:-2] * _P2 + h[2:]
    h = h[:-4] * _P4 + h[4:]
    h ^= h >> np.uint32(15)
    return h * _GOLD


def budget(m: int, share: float = EDIT_SHARE) -> int:
    """The edits allowed in a window of m characters: a share of its length, and few enough for the lemma to ask for a q-gram."""
    return max(0, min(math.floor(share * m), (m - Q) // Q))


def windows(m: int, size: int = WINDOW) -> int:
    """The number of an item's windows: one at each place that leaves room for it; a shorter item is one window."""
    return 0 if m < Q else max(1, m - size + 1)


def banded_edits_of(patterns: np.ndarray, text: np.ndarray, lo: np.ndarray, width: int) -> np.ndarray:
    """For each pattern (a row), the fewest edits between it and a stretch of the text whose diagonals (text place minus pattern
    place) stay within [lo, lo + width)."""
    far = 1 << 20
    at = lo[:, None].astype(np.int32) + np.arange(width, dtype=np.int32)
    n, ramp = len(text), np.arange(width, dtype=np.int32)
    d = np.where((at >= 0) & (at <= n), 0, far).astype(np.int32)
    for i in range(patterns.shape[1]):
        j = at + i
        inside = (j >= 0) & (j < n)
        same = text[np.clip(j, 0, n - 1)] == patterns[:, i, None] if n else np.zeros(at.shape, bool)
        new = np.where(inside, d + ~same, far)
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        new[(j + 1 < 0) | (j + 1 > n)] = far
        d = np.minimum(np.minimum.accumulate(new - ramp, axis=1) + ramp, far)
    return d.min(axis=1)


def banded_edits(pattern: np.ndarray, text: np.ndarray, lo: int, width: int) -> int:
    """As ``banded_edits_of``, for one pattern."""
    return int(banded_edits_of(pattern[None], text, np.array([lo]), width)[0])


def verbatim(pattern: np.ndarray, text: np.ndarray, size: int, diagonals: range) -> np.ndarray:
    """The starts of the pattern's windows that stand in the text without an edit at one of the diagonals."""
    out = [np.zeros(0, np.int64)]
    for d in diagonals:
        lo, hi = max(0, -d), min(len(pattern), len(text) - d)
        if hi - lo >= size:
            sums = np.concatenate([[0], np.cumsum(pattern[lo:hi] == text[lo + d : hi + d])])
            out.append(lo + np.flatnonzero(sums[size:] - sums[:-size] == size))
    return np.unique(np.concatenate(out))


def shortened(c: np.ndarray, longest: int) -> np.ndarray:
    """The text with every stretch that repeats 1 to ``PERIODS`` characters cut to ``longest`` characters and a period.

    What is matched is never longer than ``longest``, so all that stood at the edges of the stretch or inside of it still stands
    there, as often as not at another place, and nothing new comes about.
    """
    for period in range(1, PERIODS + 1):
        if len(c) <= 2 * longest:
            break
        same = np.concatenate([[False], c[period:] == c[:-period], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)  # [first, end) of places equal to the one a period later
        spare = (edges[:, 1] - edges[:, 0] - 2 * longest) // period * period
        keep = np.ones(len(c), bool)
        for (first, _), n in zip(edges[spare > 0].tolist(), spare[spare > 0].tolist(), strict=True):
            keep[first + longest : first + longest + n] = False
        c = c[keep]
    return c


def short_hashes(c: np.ndarray, m: int) -> np.ndarray:
    """64-bit hashes of the stretches of ``m`` characters at each place."""
    h = np.zeros(max(0, len(c) - m + 1), np.uint64)
    for k in range(m):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(h)]
    return h


def is_word(c: np.ndarray) -> np.ndarray:
    """Whether each character is a letter or a digit."""
    kinds, back = np.unique(c, return_inverse=True)
    return np.array([chr(k).isalnum() for k in kinds.tolist()], bool)[back] if len(c) else np.zeros(0, bool)


@dataclass(frozen=True)
class Index:
    """The q-grams of a block of items, sorted by hash.

    Items are cut into pieces of at most PIECE characters that overlap by a window less one, so that each window lies in one piece; q-grams
    are counted by piece.  A table of a byte for each of some 32 times as many places (32 MB at most) as there are q-grams tells most of what is in none.
    """

    ids: list[int | None]
    texts: list[np.ndarray]
    band: int
    bits: int
    some: np.ndarray
    hashes: np.ndarray
    size: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    offset: np.ndarray
    piece_item: np.ndarray
    piece_start: np.ndarray
    piece_end: np.ndarray
    least: np.ndarray
    short: dict[int, dict[int, list[int]]]

    @classmethod
    def build(cls, ids: list[int | None], texts: list[str], window: int, share: float) -> Index:
        codes = [code_points(normal(t)) for t in texts]
        step = max(1, PIECE - window + 1)
        pieces = [(i, s, min(len(c), s + step + window - 1)) for i, c in enumerate(codes) if len(c) >= Q for s in range(0, windows(len(c), window), step)]
        short: dict[int, dict[int, list[int]]] = {}
        for i, c in enumerate(codes):
            if 0 < len(c) < Q:
                short.setdefault(len(c), {}).setdefault(int(short_hashes(c, len(c))[0]), []).append(i)
        grams = [gram_hashes(codes[i][s:e]) for i, s, e in pieces]
        every = np.concatenate([*grams, np.zeros(0, np.uint32)])
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(g) for g in grams])
        offset = np.concatenate([*(np.arange(s, s + len(g), dtype=np.int32) for (_, s, _), g in zip(pieces, grams, strict=True)), np.zeros(0, np.int32)])
        order = np.argsort(every, kind="stable")
        hashes, start, size = np.unique(every[order], return_index=True, return_counts=True)
        bits = min(25, max(12, len(hashes).bit_length() + 5))
        some = np.zeros(1 << bits, bool)
        some[hashes >> np.uint32(32 - bits)] = True
        item, first, end = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
        least = np.array([m - Q + 1 - Q * budget(m, share) for m in (min(len(codes[i]), window) for i in item.tolist())], np.int64)
        return cls(ids, codes, budget(window, share) + 1, bits, some, hashes, size.astype(np.int32), start.astype(np.int32), piece[order], offset[order], item, first, end, least, short)

    def find(self, texts: list[str], window: int, share: float) -> list[tuple[int, int, int, int]]:
        """(text number, item number, windows found, fewest edits) of the matches in the texts (already normal)."""
        c = code_points("\0".join(texts) + "\0")
        out: dict[tuple[int, int], dict[int, int]] = {}
        self._find_short(c, out)
        grams, places, which = self._hits(c)
        if len(places) and int(self.size[which].sum()) > 4 * len(c):  # much repetition: the same matches stand in less text
            c = shortened(c, window + budget(window, share))
            grams, places, which = self._hits(c)
        ends = np.flatnonzero(c == 0) + 1
        done: set[tuple[int, int]] = set()
        for piece, diagonal in self._bands(places, which, len(c)):
            item, low, high = int(self.piece_item[piece]), int(self.piece_start[piece]), int(self.piece_end[piece])
            reach = np.searchsorted(ends, [max(0, low + diagonal), high + diagonal + 2 * self.band], side="right").tolist()
            if all((t, piece) in done for t in range(reach[0], min(reach[1] + 1, len(texts)))):
                continue
            at = np.arange(low, high - Q + 1)
            own = gram_hashes(self.texts[item][low:high])
            p = at[None] + np.arange(diagonal, diagonal + 2 * self.band)[:, None]
            inside = (p >= 0) & (p < len(grams))
            hit = inside & (grams[np.clip(p, 0, len(grams) - 1)] == own[None])
            doc, off = np.searchsorted(ends, p[hit], side="right"), np.broadcast_to(at, p.shape)[hit]
            for t in np.unique(doc).tolist():
                if (t, piece) not in done:
                    first = int(ends[t - 1]) if t else 0
                    if self._verify(c[first : ends[t] - 1], piece, diagonal - first, off[doc == t], window, share, out.setdefault((t, item), {})):
                        done.add((t, piece))
        return [(t, item, len(found), min(found.values())) for (t, item), found in out.items() if found]

    def _find_short(self, c: np.ndarray, out: dict[tuple[int, int], dict[int, int]]) -> None:
        """Items of fewer than q characters, verbatim and as whole words."""
        if not self.short:
            return
        word, ends = is_word(c), np.flatnonzero(c == 0)
        for m, by_hash in self.short.items():
            h = short_hashes(c, m)
            for at in np.flatnonzero(np.isin(h, np.array(list(by_hash), np.uint64))).tolist():
                for i in by_hash[int(h[at])]:
                    fits = np.array_equal(c[at : at + m], self.texts[i])
                    if fits and not (at and word[at - 1] and word[at]) and not (at + m < len(c) and word[at + m - 1] and word[at + m]):
                        out.setdefault((int(np.searchsorted(ends, at)), i), {})[0] = 0

    def _hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The q-grams' hashes, the places of those in the index, and their numbers there."""
        grams = gram_hashes(c)
        places = np.flatnonzero(self.some[grams >> np.uint32(32 - self.bits)])
        which = np.searchsorted(self.hashes, grams[places])
        which[which == len(self.hashes)] = 0
        same = self.hashes[which] == grams[places] if len(self.hashes) else np.zeros(0, bool)
        return grams, places[same], which[same]

    def _bands(self, places: np.ndarray, which: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """(piece, lowest diagonal) of the bands with enough q-grams.

        Hits are made and counted a bounded number at a time, in the order of the text.  Diagonals that no later place can reach are decided and
        forgotten, so what is kept is no more than a count for each band that the index has at one place of the text.
        """
        shift = max(map(len, self.texts), default=0)
        n_bands = (length + shift) // self.band + 3
        n, first = self.size[which], self.start[which]
        sums = np.cumsum(n, dtype=np.int64)
        keys, counts, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while lo < len(places):
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + HIT_STEP)))
            m = n[lo:hi]
            k = np.repeat(first[lo:hi] - (np.cumsum(m) - m).astype(np.int32), m) + np.arange(int(m.sum()), dtype=np.int32)
            new = self.piece[k].astype(np.int64) * n_bands + (np.repeat(places[lo:hi], m) - self.offset[k] + shift) // self.band
            new.sort()
            head = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
            keys, counts = np.concatenate([keys, new[head]]), np.concatenate([counts, np.diff(np.append(head, len(new)))])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[head], np.add.reduceat(counts, head)
            piece, band = keys // n_bands, keys % n_bands
            over = (band + 2) * self.band - shift <= places[hi] - self.piece_end[piece] if hi < len(places) else np.ones(len(keys), bool)
            both = counts.copy()
            near = np.flatnonzero(keys[1:] == keys[:-1] + 1)
            both[near] += counts[near + 1]
            enough = np.flatnonzero(over & (both >= self.least[piece]))
            for at in enough[np.argsort(-both[enough], kind="stable")].tolist():  # the fullest first, as they may settle a piece
                yield int(piece[at]), int(band[at]) * self.band - shift
            keys, counts, lo = keys[~over], counts[~over], hi

    def _verify(self, text: np.ndarray, piece: int, diagonal: int, offsets: np.ndarray, window: int, share: float, found: dict[int, int]) -> bool:
        """Align the windows of a piece that have enough different q-grams in the band from ``diagonal``; whether
        nothing is left to look for: all windows are there, and one of the item's verbatim."""
        distinct = np.unique(offsets)
        pattern = self.texts[self.piece_item[piece]]
        size = min(window, len(pattern))
        edits = budget(size, share)
        first = int(self.piece_start[piece])
        every = np.arange(first, int(self.piece_end[piece]) - size + 1)
        got = np.searchsorted(distinct, every + size - Q, side="right") - np.searchsorted(distinct, every)
        starts = every[got >= size - Q + 1 - Q * edits]
        starts = self._left(starts, found)
        if len(starts):
            own = pattern[first : self.piece_end[piece]]
            found.update(dict.fromkeys((first + verbatim(own, text, size, range(diagonal + first, diagonal + first + 2 * self.band))).tolist(), 0))
            starts = self._left(starts, found)
        views = np.lib.stride_tricks.sliding_window_view(pattern, size)
        for at in range(0, len(starts), ALIGN_STEP):
            part = starts[at : at + ALIGN_STEP]
            fewest = banded_edits_of(views[part], text, diagonal + part - edits, 2 * self.band + 2 * edits)
            for s, n in zip(part.tolist(), fewest.tolist(), strict=True):
                if n <= edits:
                    found[s] = min(n, found.get(s, n))
        return not len(self._left(every, found))

    @staticmethod
    def _left(starts: np.ndarray, found: dict[int, int]) -> np.ndarray:
        """The windows that aren't found yet; until one is found verbatim, also those found with edits, as another place may need fewer."""
        if not found:
            return starts
        enough = len(found) if 0 in found.values() else 0
        return np.array([s for s in starts.tolist() if (s not in found if enough else found.get(s) != 0)], np.int64)


def _texts_in_steps(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(column):
        part, size, first = [], 0, at
        while at < len(column) and size < STEP_CHARS:
            part.append(normal(column[at].as_py()))
            size += len(part[-1])
            at += 1
        yield first, part


def _matches(shared, window: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for b in batches:
            rows = []
            for first, part in _texts_in_steps(b.column(1)):
                rows += [(b.column(0)[first + t].as_py(), index.ids[i], windows(len(index.texts[i]), window), n, e) for t, i, n, e in index.find(part, window, share)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "windows", "found", "edits"])

    return run


def _clean(shared, window: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for first, part in _texts_in_steps(b.column(b.schema.get_field_index("text"))):
                for t, *_ in index.find(part, window, share):
                    keep[first + t] = False
            yield b.filter(pa.array(keep))

    return run


def indexes(benchmark: DataFrame, window: int = WINDOW, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The q-gram indexes of the benchmark, block by block.  Null and empty items match
    nothing; an item may be longer than a block."""
    own = own_columns(benchmark, item_id="long", text="string").where("text IS NOT NULL")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / block_chars))
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()  # block_chars on average
        if rows:
            yield Index.build([r["item_id"] for r in rows], [r["text"] for r in rows], window, share)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, windows (of the item), found (of them), edits (the fewest in a window): a row for each document and item
    of which a window is in the document within its edit budget.

    Null and empty texts contain nothing.  Repeated documents and items each have rows of their own; null ids stay null.
    Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, windows int, found int, edits int"
    own = own_columns(docs, doc_id="long", text="string")
    found = [own.mapInArrow(_matches(spark.sparkContext.broadcast(i), window, share), schema) for i in indexes(benchmark, window, share, block_chars)]
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no window of any item; texts never leave their task."""
    for index in indexes(benchmark, window, share, block_chars):
        docs = text_batches(docs).mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(index), window, share), docs.schema)
    return docs


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
