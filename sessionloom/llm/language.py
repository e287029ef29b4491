"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter stands for all languages: a slot holds one bit for each language, and a lookup
takes the AND of an n-gram's slots, which is the set of all languages that contain the n-gram.  A document's
n-grams give a popcount for each language.  A filter of fill ``p`` with ``k`` hashes answers yes by chance with
probability ``p ** k``; the popcounts are corrected for that, language by language, and the largest decides.

A language contains an n-gram if its rate there is at least ``min_share`` of the highest rate that any language
has, so that stray words of one language in another's documents do no harm.

The model is learned from a bounded sample of labelled rows (``max_per_lang`` of each language, by hash of the id), from all of
its n-grams; the filter is a bit array of fixed size for each language, whose blocks the executors build.  Every whole text is then scored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import own_columns, table, written

MAX_PER_LANG = 2500
ORDERS = (2, 3, 4)
MIN_COUNT = 3
MIN_SHARE = 0.25
HASHES = 3
SLOT_BITS = 22
BLOCK_BITS = 16
MAX_LANGUAGES = 1024
UNKNOWN = "und"
STEP_CHARS = 1 << 19

_SPACE = np.uint32(32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark that belongs to one."""
    global _letters
    if _letters is None:
        out = np.zeros(0x110000, bool)
        for lo, hi in ((0, 0x33480), (0xE0100, 0xE01F0)):
            out[lo:hi] = [unicodedata.category(chr(c))[0] in "LM" for c in range(lo, hi)]
        _letters = out
    return _letters


def has_letter(text: str) -> bool:
    """Whether any character is a letter: a mark alone is none."""
    return any(map(str.isalpha, text))


def codes(text: str) -> np.ndarray:
    """Lower-cased code points with a space for whatever is no letter, and a space at either end."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[raw], raw, _SPACE)


def grams(c: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the n-grams at each place, and whether it is one: letters, or letters with one space at an end."""
    n = len(c) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    letter = c != _SPACE
    ok = letter[:n] | letter[order - 1 :]
    for k in range(1, order - 1):
        ok &= letter[k : k + n]
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = (h ^ c[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h, ok


@dataclass(frozen=True)
class Filters:
    """The bit-sliced filter: ``slots[w]`` has the bits of languages 64 w to 64 w + 63."""

    languages: list[str]
    slots: list[np.ndarray]
    chance: np.ndarray

    @staticmethod
    def positions(h: np.ndarray, size: int) -> list[np.ndarray]:
        mask = np.uint64(size - 1)
        second = (h * _MIX2) >> np.uint64(17) | np.uint64(1)
        return [((h >> np.uint64(7)) + np.uint64(k) * second) & mask for k in range(HASHES)]

    @classmethod
    def of_blocks(cls, languages: list[str], blocks: list[tuple[int, int, bytes]], bits: int) -> Filters:
        """From the blocks (number, word of 64 languages, the slots as 64-bit numbers) of a filter of 2 ** bits slots."""
        width = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
        slots = [np.zeros(1 << bits, width) for _ in range(-(-len(languages) // 64) or 1)]
        for number, word, data in blocks:
            part = np.frombuffer(data, "<u8")
            slots[word][number << BLOCK_BITS : (number << BLOCK_BITS) + len(part)] = part.astype(width)
        fill = np.array([np.count_nonzero(slots[i // 64] >> width(i % 64) & width(1)) / (1 << bits) for i in range(len(languages))])
        return cls(languages, slots, fill**HASHES)

    def lookup(self, h: np.ndarray) -> list[np.ndarray]:
        """For each word of 64 languages, the masks of the languages that contain each n-gram."""
        at = self.positions(h, len(self.slots[0]))
        out = []
        for s in self.slots:
            m = s[at[0]]
            for p in at[1:]:
                m &= s[p]
            out.append(m)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        each = [codes(t or "") for t in texts]
        found, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        lo = 0
        while lo < len(texts):  # documents together up to STEP_CHARS; a longer one alone, in overlapping parts
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(each[hi]) <= STEP_CHARS):
                size += len(each[hi])
                hi += 1
            parts = [each[lo][at : at + STEP_CHARS + max(ORDERS) - 1] for at in range(0, size, STEP_CHARS)] if hi == lo + 1 else [np.concatenate(each[lo:hi])]
            starts = np.cumsum([0, *(len(x) for x in each[lo : hi - 1])])
            for k, c in enumerate(parts):
                for order in ORDERS:
                    h, ok = grams(c, order)
                    if k < len(parts) - 1:
                        h, ok = h[:STEP_CHARS], ok[:STEP_CHARS]
                    if not len(h):
                        continue
                    at = np.minimum(starts, len(h) - 1)
                    short = starts >= len(h)
                    n[lo:hi] += np.where(short, 0, np.add.reduceat(ok.astype(np.int64), at))
                    for w, m in enumerate(self.lookup(h)):
                        m[~ok] = 0
                        any_of = int(np.bitwise_or.reduce(m))
                        for bit in range(64 if m.dtype == np.uint64 else 8 * m.dtype.itemsize):
                            if any_of >> bit & 1:
                                has = (m >> m.dtype.type(bit)) & m.dtype.type(1)
                                found[lo:hi, 64 * w + bit] += np.where(short, 0, np.add.reduceat(has.astype(np.int32), at))
            lo = hi
        share = np.clip((found - n[:, None] * self.chance) / (1 - np.minimum(self.chance, 0.999999)) / np.maximum(n, 1)[:, None], 0, 1)
        langs, scores = [], []
        for i, t in enumerate(texts):
            if t is None or not has_letter(t) or not self.languages:
                langs.append(UNKNOWN)
                scores.append(0.0)
            else:
                k = int(np.argmax(share[i]))
                langs.append(self.languages[k])
                scores.append(float(share[i, k]))
        return langs, scores


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for lang, parts in by.items():
                c = np.concatenate(parts)
                for order in ORDERS:
                    h, ok = grams(c, order)
                    u, n = np.unique(h[ok], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for text, lang in zip(b.column(0), b.column(1), strict=True):
            c = codes(text.as_py())
            by.setdefault(lang.as_py(), []).append(c)
            size += len(c)
            if size > 4 * STEP_CHARS:
                yield from flush(by)
                by, size = {}, 0
        yield from flush(by)


def _slots(bits: int):
    """Rows (gram, langs: numbers) -> slot, word, mask: the bits that the n-grams of a batch set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1)
            lengths = np.diff(langs.offsets.to_numpy())
            numbers = langs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            h = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), lengths)
            at = np.concatenate([p.astype(np.int64) for p in Filters.positions(h, 1 << bits)])
            word, mask = np.tile(numbers // 64, HASHES), np.uint64(1) << np.tile(numbers % 64, HASHES).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], ["slot", "word", "mask"])

    return run


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    data = np.zeros(1 << BLOCK_BITS, "<u8")
    data[(frame["slot"] & (1 << BLOCK_BITS) - 1).to_numpy()] = frame["mask"].to_numpy(np.int64).view(np.uint64)
    return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "word": [int(frame["word"].iloc[0])], "data": [data.tobytes()]})


def filters(members: DataFrame, languages: list[str], bits: int = SLOT_BITS) -> Filters:
    """The filters of ``members`` (gram, langs: numbers in ``languages``), of any number of rows.

    Tasks set the bits of their n-grams, the bits of a slot are joined by OR before and after one shuffle, and the driver gets the blocks of
    the finished array, whose size is fixed: 2 ** bits slots for each 64 languages.
    """
    set_ = members.mapInArrow(_slots(bits), "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    dealt = set_.withColumn("block", F.shiftright("slot", min(BLOCK_BITS, bits)))
    blocks = dealt.groupBy("block", "word").applyInPandas(_block, "block long, word int, data binary").collect()
    return Filters.of_blocks(languages, [(r["block"], r["word"], bytes(r["data"])) for r in blocks], max(bits, BLOCK_BITS))


def fit(labelled: DataFrame, max_per_lang: int = MAX_PER_LANG, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, max_languages: int = MAX_LANGUAGES) -> Filters:
    """The filters of a sample of ``labelled`` (doc_id, text, lang): about ``max_per_lang`` rows of each language, all of a rarer one.

    Rows with a null text, language or id are not learned from.  All n-grams that the sample has ``min_count`` times in a language are members.  More than
    ``max_languages`` different languages are refused with a ValueError: such a column holds something else.
    """
    own = own_columns(labelled, doc_id="long", text="string", lang="string")
    counted = own.where("doc_id IS NOT NULL AND lang IS NOT NULL").groupBy("lang").count()
    sizes = written(counted, "language-sizes")
    languages = sorted(r["lang"] for r in sizes.select("lang").limit(max_languages + 1).collect())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not languages:
        return Filters(languages, [np.zeros(1, np.uint8)], np.zeros(0))
    buckets = 1 << 20
    named = F.broadcast(sizes.select("lang", F.ceil(F.least(F.lit(1.0), max_per_lang / F.col("count")) * buckets).alias("most"), (F.row_number().over(Window.orderBy("lang")) - 1).alias("number")))  # max_languages rows
    sample = own.dropna().join(named, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)) < F.col("most"))
    counts = sample.select("text", "lang").mapInArrow(_counts, "lang string, gram long, n long")
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.where(F.col("n") >= min_count).join(F.broadcast(totals), "lang").join(named, "lang").select("gram", "number", (F.col("n") / F.col("total")).alias("rate"))
    highest = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("rate", "number")).alias("in"))  # a row for each language
    members = highest.select("gram", F.transform(F.filter("in", lambda x: x["rate"] >= min_share * F.col("top")), lambda x: x["number"]).alias("langs"))
    return filters(members, languages)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Filters = shared.value
        for b in batches:
            texts, langs, scores, at = b.column(1), [], [], 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and size < 2 * STEP_CHARS:
                    part.append(texts[at].as_py())
                    size += len(part[-1] or "")
                    at += 1
                own = model.predict(part)
                langs += own[0]
                scores += own[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Filters) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text).

    Null texts and texts without a letter are ``und`` with score 0, as is everything where no language was learned.  Ties go to
    the language that sorts first.  Repeated rows and null ids stay.  An empty table gives an empty result; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    return own_columns(docs, doc_id="long", text="string").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id's text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
