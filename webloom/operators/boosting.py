"""Gradient-boosted trees from pyspark.ml, measured on a hold-out while the ensemble grows.

An ensemble of n rounds begins with that of any fewer rounds, so one training run gives the
measures of all its prefixes: every tree's answer is a column, and the running sums of those
columns are the margins after each round.

Trees see a feature by its bin only. Where there are more rows than combinations of bins and
classes, rows alike are counted first, and the trees learn from the counts as weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.features import MinMaxScale, hash_order
from webloom.operators.measures import measure_report
from webloom.session import checkpoint

#: Values of the rows that one task learns from. A file may be one row group, which one task would keep alone.
CELLS = 2**20
#: Bins of a feature, and the quantiles of ``CELLS`` rows each that its levels are taken from.
BINS, QUANTILES = 32, 4096
#: Rows that one array stands for when counts become rows again.
RUN = 2**16


def _dealt(rows: DataFrame, columns: list[str], count: int | None = None) -> DataFrame:
    """``columns`` of the rows in even parts of ``CELLS`` values at most, one per core at least.

    More rows make more parts, and their order in a part does not depend on the shuffle.
    """
    kept = rows.select(*dict.fromkeys(columns))
    cells = (kept.count() if count is None else count) * len(kept.columns)
    return kept.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-cells // CELLS))).sortWithinPartitions(*kept.columns)


def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)


def _evenly(values: np.ndarray, counts: np.ndarray, most: int) -> list[float]:
    """All distinct values where there are no more than ``most``, else the middles of so many groups of about equal size."""
    values, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, counts)
    if len(values) <= most:
        return values.tolist()
    found, start, left = [], 0, counts.sum()
    for groups in range(most, 0, -1):
        ends = np.cumsum(counts[start:])
        stop = start + min(int(np.searchsorted(ends, left / groups)) + 1, len(values) - start - groups + 1)
        size = counts[start:stop].sum()
        found.append(float(values[start + min(int(np.searchsorted(ends, size / 2)), stop - start - 1)]))
        start, left = stop, left - size
    return found


def _levels(rows: DataFrame, features: list[str]) -> tuple[int, list[list[float]]]:
    """Number of rows, and for each feature up to ``BINS`` values. A row counts as the one that is nearest to its own."""

    def quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            values = [np.sort(x[~np.isnan(x)]) for x in _doubles(batch)]
            picked = [x if len(x) <= QUANTILES else x[((np.arange(QUANTILES) + 0.5) * len(x) / QUANTILES).astype(int)] for x in values]
            yield pa.RecordBatch.from_pydict({
                "feature": np.arange(len(values), dtype="int32"), "rows": np.full(len(values), batch.num_rows),
                "points": [x for x in picked], "weight": [len(x) / max(1, len(y)) for x, y in zip(values, picked)]})

    def levels(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        weights = np.repeat(parts["weight"].to_numpy(), parts["points"].str.len())
        return pd.DataFrame({"feature": [key[0]], "rows": [parts["rows"].sum()], "levels": [_evenly(np.concatenate(parts["points"].to_numpy()), weights, BINS)]})

    parts = rows.select(*[F.col(name).cast("double").alias(name) for name in features]).mapInArrow(quantiles, "feature int, rows bigint, points array<double>, weight double")
    found = {r["feature"]: r for r in parts.groupBy("feature").applyInPandas(levels, "feature int, rows bigint, levels array<double>").collect()}
    return found[0]["rows"] if found else 0, [found[i]["levels"] if found else [] for i in range(len(features))]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to ``CELLS`` rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CELLS:
            yield pa.Table.from_batches(held)
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _doubles(batch: pa.Table) -> list[np.ndarray]:
    return [x.to_numpy() for x in batch.columns]


def _bounds(levels: list[float]) -> np.ndarray:
    """Midway between two levels, where the library puts them; what lies on one belongs to the left."""
    return np.array([(a + b) / 2 for a, b in zip(levels, levels[1:])])


def _fewer(count: int, levels: list[list[float]], classes: int) -> bool:
    """Whether there are fewer combinations of levels and classes than rows, and levels can be told apart."""
    apart = all(np.isfinite(found).all() and (np.diff(_bounds(found)) > 0).all() and np.isfinite(_bounds(found)).all() for found in levels)
    return apart and 0 < math.prod(map(len, levels)) * classes < count


def _counted(rows: DataFrame, features: list[str], label: str, levels: list[list[float]]) -> DataFrame:
    """Features as levels, ``label`` and the number ``n`` of rows alike; rows with a missing feature are skipped."""
    bounds = [_bounds(found) for found in levels]
    added = lambda tables: pa.concat_tables(tables).group_by(["_code", "_label"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, limit = [], 0
        for batch in _chunks(batches):
            columns = _doubles(batch.drop_columns("_label"))
            known = ~np.any([np.isnan(x) for x in columns], axis=0)
            code = np.zeros(known.sum(), dtype="int64")
            for x, between in zip(columns, bounds):
                code = code * (len(between) + 1) + np.searchsorted(between, x[known], "left")
            held.append(added([pa.table({"_code": code, "_label": batch["_label"].filter(pa.array(known)), "n": np.ones(len(code), dtype="int64")})]))
            if sum(map(len, held)) > limit:
                held = [added(held)]
                limit = 2 * len(held[0])
        if held:
            yield from added(held).select(["_code", "_label", "n"]).to_batches()

    known = rows.select(*[F.col(name).cast("double").alias(name) for name in features], F.col(label).alias("_label"))
    cells = known.mapInArrow(count, f"_code bigint, _label {known.schema['_label'].dataType.simpleString()}, n bigint").groupBy("_code", "_label").agg(F.sum("n").alias("n"))
    columns, rest = [], F.col("_code")
    for name, found in reversed([*zip(features, levels)]):
        columns.append(F.get(F.array(*map(F.lit, found)), F.pmod(rest, F.lit(len(found))).cast("int")).alias(name))
        rest = F.floor(rest / len(found))
    return cells.select(*reversed(columns), F.col("_label").alias(label), "n")


def train(rows: DataFrame, features: list[str], label: str, classes: int, rounds: int, seed: int, depth: int = 4,
          known: tuple[int, list[list[float]]] | None = None) -> list[GBTClassificationModel]:
    """One ensemble per class against all others; a single one where there are two classes. ``known`` are the rows' ``_levels``."""
    count, levels = known or _levels(rows, features)
    if _fewer(count, levels, classes):
        ready = checkpoint(assemble(_counted(rows, features, label, levels), features).select("features", label, "n"))
        # The library looks for bounds in as many rows as the square of its bins, here all.
        bins = max(BINS, math.isqrt(ready.count()) + 1)
    else:
        ready, bins = checkpoint(assemble(_dealt(rows, [*features, label], count), features).select("features", label, F.lit(1).alias("n"))), BINS
    fit = lambda c: GBTClassifier(featuresCol="features", labelCol="one", weightCol="n", maxBins=bins, maxIter=rounds, maxDepth=depth, seed=seed).fit(
        ready.select("features", "n", (F.col(label) == c).cast("double").alias("one")))
    return [fit(1)] if classes == 2 else [fit(c) for c in range(classes)]


def staged_margins(models: list, rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``margins``: for each ensemble the weighted answers of its trees, summed up round by round."""
    ready = assemble(rows, features)
    columns = []
    for number, model in enumerate(models):
        answers = []
        for k, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
            name = f"_tree_{number}_{k}"
            ready = tree.setFeaturesCol("features").setPredictionCol(name).transform(ready)
            answers.append(F.col(name) * weight)
        columns.append(F.array(*answers))
    sums = lambda answers: F.transform(answers, lambda a, i: F.aggregate(F.slice(answers, F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x))
    return ready.select(*rows.columns, F.array(*[sums(a) for a in columns]).alias("margins"))


def probabilities(margins: Column, after: Column | int, classes: int) -> Column:
    """Class shares after a number of rounds. A margin is half the log odds."""
    odds = F.transform(margins, lambda m: 1 / (1 + F.exp(-2 * F.element_at(m, F.lit(after) if isinstance(after, int) else after))))
    if classes == 2:
        return F.array(1 - odds[0], odds[0])
    share = F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)
    return F.transform(odds, lambda x: x / share)


def predict(models: list[GBTClassificationModel], rows: DataFrame, features: list[str], label: str, classes: int) -> DataFrame:
    """``rows`` with ``pred`` (a share per class) and ``target``, by the whole ensembles."""
    scored = staged_margins(models, rows, features)
    return scored.select(*rows.columns, probabilities(F.col("margins"), -1, classes).alias("pred"), F.col(label).cast("int").alias("target"))


def split(rows: DataFrame, ids: list[str], fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out rows; a hash of the ids decides."""
    # Eight hexadecimal digits as a share of 2^32 are below the fraction if they come before those of the first number that is not.
    cut = max(0, math.ceil(fraction * 2**32))
    digits = F.substring(hash_order(ids, seed), 1, 8)
    tagged = rows.withColumn("_test", digits < f"{cut:08x}" if cut < 2**32 else digits.isNotNull())
    return tagged.filter("not _test").drop("_test"), tagged.filter("_test").drop("_test")


def _repeated(counted: DataFrame) -> DataFrame:
    """Each row ``n`` times, from arrays of ``RUN`` entries at most."""
    rest = [c for c in counted.columns if c != "n"]
    runs = counted.select(*rest, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint"))).alias("_from"))
    size = F.least(F.lit(RUN).cast("bigint"), F.col("n") - F.col("_from"))
    return runs.select(*rest, F.explode(F.array_repeat(F.lit(True), size.cast("int"))).alias("_one")).select(*rest)


def train_report(rows: DataFrame, ids: list[str], features: list[str], label: str, classes: int, rounds: int, every: int,
                 fraction: float, seed: int, names: tuple[str, ...] = ("acc", "f1", "mcll")) -> DataFrame:
    """Measures on the held-out rows after each ``every`` rounds and after the last: ``iteration`` and a column per measure.

    Rows with a null feature are skipped. Features are scaled by the bounds of the training rows.
    """
    fit_rows, test_rows = split(rows, ids, fraction, seed)
    scale = MinMaxScale(features).fit(fit_rows)
    scaled, held = scale.transform(fit_rows), scale.transform(test_rows)
    known = count, levels = _levels(scaled, features)
    models = train(scaled, features, label, classes, rounds, seed, known=known)
    # Rows alike get the same answer, so it is sought once and holds for as many rows as were counted.
    alike = _fewer(count, levels, classes)
    ready = _counted(held, features, label, levels) if alike else _dealt(held, [*features, label]).withColumn("n", F.lit(1).cast("bigint"))
    scored = checkpoint(staged_margins(models, ready, features).select(F.col(label).cast("int").alias("target"), "n", "margins"))

    def reports() -> Iterator[DataFrame]:
        for step in sorted({*range(every, rounds + 1, every), rounds}):
            at = _repeated(scored.select("n", "target", probabilities(F.col("margins"), step, classes).alias("pred")))
            yield measure_report(at.withColumn("id", F.monotonically_increasing_id()), ["iteration", *names], classes, known={"iteration": step})

    found = reports()
    result = next(found)
    for more in found:
        result = result.unionByName(more)
    return result


def train_values(rows: DataFrame, features: list[str], label: str, rounds: int, seed: int, depth: int = 5) -> GBTRegressionModel:
    """Regression trees for a real-valued label."""
    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed).fit(
        checkpoint(assemble(_dealt(rows, [*features, label]), features).select("features", F.col(label).cast("double").alias(label))))


def predict_values(model: GBTRegressionModel, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """``rows`` with ``pred`` (an array of the one value) and ``target``, as the measures for regression want them."""
    scored = model.setPredictionCol("_value").transform(assemble(rows, features))
    return scored.select(*rows.columns, F.array("_value").alias("pred"), F.col(label).cast("double").alias("target"))
