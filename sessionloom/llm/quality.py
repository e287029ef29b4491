"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

``P(grade <= k) = sigmoid(threshold[k] - w . x)`` with one weight vector for all grades and increasing
thresholds.  The features ``x`` are presences, hashed to ``2 ** HASH_BITS`` places: the distinct words of the
text, the shares of word shapes (case and trailing marks) and the share of distinct words.  From a fitted model
come the expected grade and the tail probability ``P(grade >= k)``, by which documents are selected.

Fitting uses a bounded sample of labelled rows (``max_labelled``, by hash of the id).  All hashed places have a weight, held back by the
ridge alone: the likelihood is minimised by limited-memory BFGS over the sample's presences.
Scoring reads every whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import own_columns, table, text_batches, written

HASH_BITS = 20
MAX_LABELLED = 24_000
RIDGE = 1e-4
STEPS = 80
MEMORY = 4
GRADES = 3
SELECT_GRADE = 2
SELECT_PROBABILITY = 0.5
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¡¿…–—“”‘’"
SHARES = (1 / 2, 1 / 4, 1 / 8, 1 / 16, 1 / 32)


def features(text: str | None) -> list[int]:
    """The places (distinct, sorted) of the features of a text; none for null and for texts without a word."""
    counts = Counter(text.split()) if text else None
    if not counts:
        return []
    total, cores, shapes = 0, set(), Counter()
    for token, n in counts.items():
        total += n
        core = token.rstrip(MARKS)
        tail = token[len(core) :]
        core = core.lstrip(MARKS)
        low = core.lower()
        cores.add(low)
        shapes[("" if not core else "a" if core == low else "A" if len(core) > 2 and core == core.upper() else "Aa", tail[:3])] += n
    names = ["w" + c for c in cores]
    for (case, tail), n in shapes.items():
        names += [f"s{case} {tail} {k}" for k, share in enumerate(SHARES) if n >= share * total]
    if total >= 16:
        names += [f"d{k}" for k, share in enumerate(SHARES) if len(counts) <= share * total]
    digest, mask = xxhash.xxh3_64_intdigest, (1 << HASH_BITS) - 1
    return sorted({digest(x) & mask for x in names})


@dataclass(frozen=True)
class Ordinal:
    """A fitted model: a weight for each hashed place, and the increasing thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        score = float(self.weights[np.array(features(text), np.int64)].sum())
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds.tolist()]


STEP = 1 << 20


def _group_sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sums of values[at] over the groups that start at ``starts`` (each has a member), about STEP members at a time."""
    out, bounds = np.zeros(len(starts)), np.append(starts, len(at))
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(at), STEP)), len(starts)))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        out[lo:hi] = np.add.reduceat(values[at[bounds[lo] : bounds[hi]]], starts[lo:hi] - starts[lo])
    return out


class Presences:
    """Rows of places, in row order and in place order, for sums along either."""

    def __init__(self, lengths: np.ndarray, places: np.ndarray, size: int):
        self.n, self.size, self.places = len(lengths), size, places.astype(np.int32)
        self._rows = np.flatnonzero(lengths)
        self._row_starts = (np.cumsum(lengths) - lengths)[self._rows]
        order = np.argsort(self.places, kind="stable").astype(np.int32)
        self._row_of = np.repeat(np.arange(self.n, dtype=np.int32), lengths)[order]
        by_place = self.places[order]
        self._place_starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), by_place[1:] != by_place[:-1]]))
        self._there = by_place[self._place_starts]

    def by_row(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        out[self._rows] = _group_sums(weights, self.places, self._row_starts)
        return out

    def by_place(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size)
        out[self._there] = _group_sums(values, self._row_of, self._place_starts)
        return out


def loss(par: np.ndarray, x: Presences, grades: np.ndarray, n_grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood plus ``ridge * |w|^2 / 2``, and its slope.

    ``par``: the weights, the first threshold and the logarithms of the steps to the next ones.
    """
    n, w = x.n, par[: x.size]
    up = np.exp(par[x.size + 1 :])
    th = np.cumsum(np.concatenate([par[x.size : x.size + 1], up]))
    z, at = x.by_row(w), np.arange(n)
    cum = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(z[:, None] - th[None, :], -60, 60))), np.ones((n, 1))], axis=1)
    p = np.maximum(cum[at, grades + 1] - cum[at, grades], 1e-12)
    slope = cum * (1 - cum)  # of each cumulative probability, by its threshold
    dz = (slope[at, grades + 1] - slope[at, grades]) / p / n  # of the loss, by z
    dth = np.zeros((n, n_grades + 1))
    dth[at, grades + 1] -= slope[at, grades + 1] / p / n
    dth[at, grades] += slope[at, grades] / p / n
    back = np.cumsum(dth[:, 1:-1].sum(axis=0)[::-1])[::-1]
    return float(-np.log(p).mean() + ridge * (w @ w) / 2), np.concatenate([x.by_place(dz) + ridge * w, back[:1], back[1:] * up])


def fit_ordinal(x: Presences, grades: np.ndarray, n_grades: int, ridge: float = RIDGE, steps: int = STEPS) -> Ordinal:
    """The minimum of ``loss`` by limited-memory BFGS with step halving."""
    shares = np.cumsum(np.bincount(grades, minlength=n_grades) + 1)[:-1] / (x.n + n_grades)
    first = np.log(shares / (1 - shares))
    par = np.concatenate([np.zeros(x.size), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    value, grad = loss(par, x, grades, n_grades, ridge)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, back = grad.copy(), []
        for s, y in reversed(moved):
            back.append((s @ way) / (s @ y))
            way -= back[-1] * y
        way *= (moved[-1][0] @ moved[-1][1]) / (moved[-1][1] @ moved[-1][1]) if moved else 1 / max(1.0, float(np.linalg.norm(grad)))
        for (s, y), a in zip(moved, reversed(back), strict=True):
            way += s * (a - (y @ way) / (s @ y))
        length = 1.0
        while True:
            new = par - length * way
            new_value, new_grad = loss(new, x, grades, n_grades, ridge)
            if new_value <= value - 1e-4 * length * (grad @ way) or length < 1e-8:
                break
            length /= 2
        if (new - par) @ (new_grad - grad) > 1e-12:
            moved = [*moved, (new - par, new_grad - grad)][-MEMORY:]
        par, value, grad = new, new_value, new_grad
        if np.linalg.norm(grad) < 1e-5:
            break
    return Ordinal(par[: x.size], np.cumsum(np.concatenate([par[x.size : x.size + 1], np.exp(par[x.size + 1 :])])))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good.  Rows without both ratings or without an id are left out."""
    own = own_columns(labels, doc_id="long", quality="int", toxic="int").dropna()
    return own.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).otherwise(2).alias("grade"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(0)
        found = [features(texts[i].as_py()) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column(1)], ["places", "grade"])


def fit(docs: DataFrame, grades: DataFrame, max_labelled: int = MAX_LABELLED, n_grades: int = GRADES, ridge: float = RIDGE) -> Ordinal:
    """The model of a sample of about ``max_labelled`` rated rows (all, if fewer).  No rated row: a model that
    gives every text the top grade."""
    n = grades.count()
    buckets = 1 << 20
    chosen = grades.where(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)) < math.floor(buckets * min(1.0, max_labelled / max(n, 1))))
    # the chosen ratings are bounded by max_labelled
    texts = own_columns(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id").select("text", "grade")
    seen = written(texts.mapInArrow(_places, "places array<int>, grade int"), "quality-sample")
    data = seen.withColumn("key", F.xxhash64("places")).toArrow()  # max_labelled rows
    if not data.num_rows:
        return Ordinal(np.zeros(1 << HASH_BITS), np.array([-40.0 + k for k in range(n_grades - 1)]))
    data = data.take(np.lexsort((data.column("key").to_numpy(), data.column("grade").to_numpy())))  # an order of its own, for the same sums in each run
    rated, places = data.column("grade").to_numpy().astype(np.int64), data.column("places").combine_chunks()
    x = Presences(np.diff(places.offsets.to_numpy()), places.flatten().to_numpy(), 1 << HASH_BITS)
    del data, places
    return fit_ordinal(x, rated, n_grades, ridge)


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Ordinal = shared.value
        for b in batches:
            tails = [model.tails(b.column(1)[i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(sum, tails)), pa.float64()), pa.array(tails, pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    return run


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_grade, tails (P(grade >= 1), P(grade >= 2), ...) of each row of ``docs``.

    Null and empty texts have no features: they get the grade that the thresholds alone give.  Repeated rows and null ids
    stay.  An empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** HASH_BITS weights
    return own_columns(docs, doc_id="long", text="string").mapInArrow(_scores(shared), "doc_id long, expected_grade double, tails array<double>")


def _kept(shared, grade: int, probability: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Ordinal = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            keep = [model.tails(texts[i].as_py())[grade - 1] >= probability for i in range(len(texts))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def select(docs: DataFrame, model: Ordinal, grade: int = SELECT_GRADE, probability: float = SELECT_PROBABILITY) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has ``P(grade >= grade) >= probability``, a tie included; texts never leave their task."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return text_batches(docs).mapInArrow(_kept(shared, grade, probability), docs.schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, graded(table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select(
        "doc_id",
        F.round("expected_grade", 6).alias("expected_grade"),
        F.round(F.get("tails", F.lit(0)), 6).alias("p_not_toxic"),
        F.round(F.get("tails", F.lit(1)), 6).alias("p_good"),
        (F.get("tails", F.lit(SELECT_GRADE - 1)) >= SELECT_PROBABILITY).alias("selected"),
    )
