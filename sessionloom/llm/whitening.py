"""Embedding whitening by hierarchical merging of singular value decompositions.

A part of the vectors is held as its factor: the number of vectors, the exact sums of their integer entries, and the singular values and
vectors of the part after its own mean is taken off.  Two factors merge without loss: their scaled singular vectors are stacked with one more row,
the difference of the two means times ``sqrt(n1 n2 / (n1 + n2))``, and decomposed again.  No dimension is ever dropped, so the last factor is
that of all vectors: its singular values squared over n are the eigenvalues of the covariance, its vectors the components.

Entries are integers and their sums are kept as integers of any size, so a mean is taken off exactly, however far it lies from zero.  Tasks stream their
rows in blocks of a bounded number of entries and send one factor each; factors merge FAN at a time, level by level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import drop_written, table, text_batches, written

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
FAN = 8
#: Entries of a block of vectors that is decomposed at once.
BLOCK = 1 << 20
#: Vectors of more different lengths than this are refused: each length has a model of its own, which is sent to the tasks.
MAX_LENGTHS = 64
_SAFE = 1 << 61
_FACTOR = "dim int, node long, n long, sums array<string>, scales binary, vectors binary"


@dataclass
class Part:
    """The factor of some vectors: rows of ``vectors`` are orthonormal, ``scales`` fall."""

    n: int
    sums: list[int]
    scales: np.ndarray
    vectors: np.ndarray

    @property
    def eigenvalues(self) -> np.ndarray:
        return self.scales**2 / self.n

    @property
    def rank(self) -> int:
        """The number of components with a variance above the rounding errors of the largest."""
        return int((self.scales > self.scales[:1] * len(self.sums) * 4 * np.finfo(float).eps).sum()) if len(self.scales) else 0


def integers(values: np.ndarray, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    return np.floor(values * scale).astype(np.int64) + shift


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: as longs where they hold it, else as Python's integers."""
    if n * int(np.abs(x).max(initial=0)) < _SAFE and max(map(abs, sums), default=0) < _SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, scales, vectors = np.linalg.svd(rows, full_matrices=False)
    return scales, vectors


def factor(x: np.ndarray) -> Part:
    """The factor of the rows of ``x`` (integers)."""
    n = len(x)
    wide = n * int(np.abs(x).max(initial=0)) >= _SAFE
    sums = [int(s) for s in (x.astype(object) if wide else x).sum(axis=0)]
    return Part(n, sums, *_decomposed(centred(x, n, sums).astype(float) / n))


def merge(a: Part, b: Part) -> Part:
    """The factor of the vectors of both."""
    apart = np.array([(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])
    correction = math.sqrt(a.n * b.n / (a.n + b.n)) * apart
    rows = np.concatenate([a.scales[:, None] * a.vectors, b.scales[:, None] * b.vectors, correction[None]])
    return Part(a.n + b.n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], *_decomposed(rows))


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the vectors of a batch: the length, the places of its rows, their entries."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, flat[starts[at][:, None] + np.arange(dim)]


def _row(dim: int, node: int, p: Part) -> dict:
    return {"dim": dim, "node": node, "n": p.n, "sums": [str(s) for s in p.sums], "scales": p.scales.tobytes(), "vectors": p.vectors.tobytes()}


def _part(row) -> Part:
    vectors = np.frombuffer(row["vectors"], float).reshape(-1, row["dim"])
    return Part(int(row["n"]), [int(s) for s in row["sums"]], np.frombuffer(row["scales"], float), vectors)


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One factor for each length of the task's vectors."""
    node = TaskContext.get().partitionId()
    parts: dict[int, Part] = {}
    held: dict[int, list[np.ndarray]] = {}

    def close(dim: int) -> None:
        own = factor(np.concatenate(held.pop(dim)))
        parts[dim] = merge(parts[dim], own) if dim in parts else own

    for batch in batches:
        for dim, _, values in _by_length(batch.column(0)):
            held.setdefault(dim, []).append(integers(values))
            if len(held) + len(parts) > 2 * MAX_LENGTHS:
                raise ValueError(f"vectors of more than {MAX_LENGTHS} different lengths")
            if sum(map(len, held[dim])) * dim >= BLOCK:
                close(dim)
    for dim in list(held):
        close(dim)
    kinds = {"dim": pa.int32(), "node": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.string()), "scales": pa.binary(), "vectors": pa.binary()}
    for dim, p in parts.items():
        own = _row(dim, node, p)
        yield pa.RecordBatch.from_arrays([pa.array([own[c]], t) for c, t in kinds.items()], list(kinds))


def _merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """At most FAN factors of one length, in the order of their nodes, to one."""
    parts = [_part(r) for r in frame.sort_values("node").to_dict("records")]
    out = parts[0]
    for p in parts[1:]:
        out = merge(out, p)
    return pd.DataFrame([_row(int(key[0]), int(key[1]), out)])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles): the rows whose vector has entries, none of them null, not finite or so large (2 ** 52) that its integer is no long."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 52)))
    own = text_batches(vectors).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def fit(vectors: DataFrame) -> dict[int, Part]:
    """The factor of all usable vectors, with all their dimensions, for each length of vectors.  Empty for an empty table."""
    factors = written(usable(vectors).select("v").mapInArrow(_factors, _FACTOR), "whitening-factors")
    top = factors.agg(F.max("node")).first()[0] or 0
    while top > 0:
        up = factors.groupBy("dim", (F.col("node") / FAN).cast("long").alias("up")).applyInPandas(_merged, _FACTOR)
        nxt = written(up, "whitening-factors")
        drop_written(factors)
        factors, top = nxt, top // FAN
    rows = factors.orderBy("dim").limit(MAX_LENGTHS + 1).collect()  # one row for each length
    if len(rows) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} different lengths")
    drop_written(factors)
    return {r["dim"]: _part(r) for r in rows}


def _axes(p: Part, k: int) -> np.ndarray:
    """The first k components; the entry of the largest size is positive in each."""
    own = p.vectors[: min(k, p.rank)]
    return own * np.sign(np.take_along_axis(own, np.abs(own).argmax(axis=1)[:, None], axis=1)) if len(own) else own


def _projected(models: dict[int, tuple[int, list[int], np.ndarray, np.ndarray]]):
    def squares(t: np.ndarray) -> list[int | None]:
        if t.dtype != object and float(np.abs(t).max(initial=0)) ** 2 * t.shape[1] < _SAFE:
            return (t * t).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(e * e for e in r) for r in t.astype(object).tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, values in _by_length(batch.column(1)):
                n, sums, axes, deviations = models[dim]
                t = centred(integers(values), n, sums)
                w = (t.astype(float) / n) @ axes.T / deviations
                ids = batch.column(0).take(pa.array(at))
                cols = [ids, pa.array([dim] * len(at), pa.int32()), pa.array(squares(t), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "dim", "deviation", "w"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and each of the first ``components`` components.

    Vectors that are null or empty, or hold null or non-finite entries (or entries of 2 ** 52 and more, whose integers are no longs), are left out; a null
    vec_id keeps its row; repeated rows are rows of their own.  Vectors of another length are a fit list of their own.  A component without variance has no whitened
    values and is left out, so equal vectors alone give no rows.  Of components with equal eigenvalues any orthonormal choice may come.  A deviation beyond a
    long is null.  An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    fitted = fit(vectors)
    models = {}
    about = []
    for dim, p in fitted.items():
        axes, e = _axes(p, components), p.eigenvalues
        models[dim] = p.n, p.sums, axes, np.sqrt(e[: len(axes)])
        about.append((dim, p.n, [float(x) for x in e[: len(axes)] / (e.sum() or 1)]))
    projected = written(usable(vectors).mapInArrow(_projected(models), "vec_id long, dim int, deviation long, w array<double>"), "whitening-rows")
    about = spark.createDataFrame(about, "dim int, n long, explained array<double>")  # MAX_LENGTHS rows at most
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    w = lambda i: F.get("w", F.lit(i))
    apart = [F.abs(F.covar_pop(w(i), w(j)) - F.lit(float(i == j))) for i, j in pairs]
    error = projected.groupBy("dim").agg((F.greatest(*apart) if len(apart) > 1 else apart[0]).alias("identity_error"))
    known = projected.join(F.broadcast(about), "dim").join(F.broadcast(error), "dim")
    each = known.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("w").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", "at").alias("explained"), "identity_error")


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
