"""Whitening of embeddings by a covariance with multiplicity weights.

Equal vectors are grouped first: every distinct vector is one row with the number of its copies.
A fit weighs it by that number or by one. Mean and covariance come from sums that tasks make over
blocks of rows (a matrix product of the centred block with itself) and Spark adds up; only the
dimension's square of numbers reaches the driver, which finds the eigenvectors. Each distinct vector
is whitened once and joined back to its copies by a digest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import stored

#: A digest that holds this share of the rows or more is joined apart: there are 1000 of them at most.
HOT = 1000
LARGEST = 2**63 - 1


def entries(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """``floor(scale * c) + shift`` for every entry; null where an entry is null, not finite or beyond a long."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.lit(scale) * c) < 2.0**62)
    numbers = vector.cast("array<double>")
    return F.when(F.forall(numbers, lambda c: F.coalesce(fine(c), F.lit(False))), F.transform(numbers, lambda c: F.floor(F.lit(scale) * c) + F.lit(shift).cast("long")))


def matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Rows of a list column with ``width`` entries each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def sums(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """Total weight and exact weighted sums of ``x`` per dimension."""
    row = distinct.groupBy().agg(
        F.sum(F.col("weight").cast("decimal(38,0)")), *[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)") * F.col("weight")) for i in range(width)]).first()
    return int(row[0] or 0), [int(v or 0) for v in row[1:]]


def covariance(rows: DataFrame, column: str, center: np.ndarray, whole: np.ndarray, weight: str, total: int) -> np.ndarray:
    """Weighted covariance of a list column, divisor ``total``.

    The centre is ``whole`` (integers, taken off exactly) plus ``center`` (the fraction that is left).
    """
    width = len(center)
    integers = rows.schema[column].dataType.simpleString() == "array<bigint>"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((width, width))
        for batch in batches:
            values = matrix(batch.column(0), width, np.int64 if integers else np.float64)
            centred = (values - whole).astype(np.float64) - center
            product += (centred * batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]).T @ centred
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(product[i, j])], names=["i", "j", "v"])

    parts = rows.select(column, weight).mapInArrow(multiply, "i int, j int, v double")
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    result = np.zeros((width, width))
    result[found["i"], found["j"]] = found["v"]
    return (result + np.triu(result, 1).T) / max(total, 1)


@dataclass
class Fit:
    """Total weight, sums per dimension and the leading components."""

    n: int
    sums: list[int]
    values: np.ndarray  # falling eigenvalues, one per component
    vectors: np.ndarray  # dimension x component
    trace: float

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])

    @property
    def live(self) -> np.ndarray:
        """Components with a variance above rounding; others cannot be scaled to one."""
        return self.values > max(self.trace, 0) * 64 * np.finfo(float).eps


def fit(distinct: DataFrame, width: int, components: int = 16) -> Fit:
    """Eigenvectors of the weighted covariance of ``x`` (``x``, ``weight``), by falling eigenvalue."""
    n, totals = sums(distinct, width)
    model = Fit(n, totals, np.zeros(0), np.zeros((width, 0)), 0.0)
    if not n:
        return model
    cov = covariance(distinct, "x", model.rest, model.whole, "weight", n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    model.values, model.vectors, model.trace = values[order], vectors[:, order], float(np.trace(cov))
    return model


def deviations(values: np.ndarray, model: Fit) -> list[int | None]:
    """Exact sum of ``(n * x - S)**2`` per row; null beyond a long."""
    # n * x - S = n * (x - whole) - S % n, small numbers that fit as long as the estimate does.
    near = values - model.whole
    rest = np.array([s % model.n for s in model.sums], dtype=object)
    with np.errstate(over="ignore"):
        estimate = ((np.abs(near.astype(np.float64)) + 1) ** 2).sum(axis=1) * float(model.n) ** 2
    found: list[int | None] = [None] * len(values)
    safe = estimate < 2.0**62
    if safe.any():
        gap = near[safe] * model.n - rest.astype(np.int64)
        for at, value in zip(np.flatnonzero(safe), (gap * gap).sum(axis=1).tolist()):
            found[at] = value
    for at in np.flatnonzero(~safe):
        value = sum((int(v) * model.n - int(r)) ** 2 for v, r in zip(near[at], rest))
        found[at] = value if value <= LARGEST else None
    return found


def project(distinct: DataFrame, model: Fit, width: int) -> DataFrame:
    """``key, copies, fit, deviation, whitened`` of every distinct vector; components without variance are NaN."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(model.live, 1 / np.sqrt(np.where(model.live, model.values, 1)), np.nan)
        for batch in batches:
            values = matrix(batch.column(3), width)
            white = (((values - model.whole).astype(np.float64) - model.rest) @ model.vectors) * scale
            size = white.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * size), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(deviations(values, model), pa.int64()), lists],
                                             names=["key", "copies", "weight", "deviation", "whitened"])

    return distinct.select("key", "copies", "weight", "x").mapInArrow(run, "key binary, copies long, weight long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, model: Fit) -> float:
    """Largest entry of the whitened vectors' weighted covariance minus the identity, over components with variance."""
    live = [int(i) for i in np.flatnonzero(model.live)]
    if not live:
        return 0.0
    rows = white.select("weight", F.array(*[F.get("whitened", F.lit(i)) for i in live]).alias("w"))
    means = rows.agg(*[F.sum(F.get("w", F.lit(k)) * F.col("weight")) / model.n for k in range(len(live))]).first()
    cov = covariance(rows, "w", np.array(means, float), np.zeros(len(live)), "weight", model.n)
    return float(np.abs(cov - np.eye(len(live))).max())


def whiten(table: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16, weighted: bool = False,
           scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row per input row and component: ``id, component, n, deviation, whitened, explained, identity_error``.

    ``weighted`` counts every copy of a vector in the fit, else each distinct vector counts once. Rows
    whose vector is null, has a null or non-finite entry or one that leaves the range of a long are
    left out, and so are vectors whose length is not that of the most rows (of equal ones the longest).
    Null and repeated ids keep their rows. A component without variance has null ``whitened``; without
    any variance ``explained`` is null. Empty vectors and an empty table give no rows; other columns
    are ignored.
    """
    rows = table.select(F.col(id).alias("id"), entries(F.col(vector), scale, shift).alias("x")).filter("x is not null")
    sizes = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    width, total = (sizes["width"], sizes["n"]) if sizes else (0, 0)
    kept = rows.filter(F.size("x") == width).withColumn("key", F.unhex(F.sha2(F.array_join(F.col("x").cast("array<string>"), ",").cast("binary"), 256)))
    distinct = stored(kept.groupBy("key").agg(F.count("*").alias("copies"), F.first("x").alias("x")).withColumn(
        "weight", F.col("copies") if weighted else F.lit(1).cast("long")), "distinct")
    model = fit(distinct, width, components)
    white = stored(project(distinct, model, width), "whitened")
    error = identity_error(white, model)
    hot = (F.col("copies") * HOT >= total).alias("hot")
    marks = white.select("key", "deviation", "whitened", hot)
    often = F.broadcast(marks.filter("hot").drop("hot"))
    own = kept.select("id", "key")
    joined = own.join(often, "key").unionByName(own.join(often, "key", "left_anti").join(marks.filter("not hot").drop("hot"), "key"))
    shares = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values])
    return joined.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        F.col("id").alias(id), (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"), F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"))
