"""Boosted trees: measures of every prefix of an ensemble, and real-valued answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import boosting as B


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    found = [(i, draw.random(), draw.random(), draw.random()) for i in range(600)]
    label = lambda a, b: int(a > 0.6) + int(a > 0.6 and b > 0.5)
    return spark.createDataFrame([(i, a, b, c, label(a, b), 3 * a - b) for i, a, b, c in found], "id long, a double, b double, c double, label int, worth double").cache()


def test_report_after_every_other_round(rows):
    report = B.train_report(rows, ["id"], ["a", "b", "c"], "label", classes=3, rounds=5, every=2, fraction=0.2, seed=1).orderBy("iteration").collect()
    assert [r["iteration"] for r in report] == [2.0, 4.0, 5.0]
    held = B.split(rows, ["id"], 0.2, 1)[1].count()
    assert {r["rows"] for r in report} == {held} and 60 < held < 180
    assert all(r["f1"] > 0.7 for r in report) and report[-1]["mcll"] < report[0]["mcll"]


def test_prefixes_are_those_of_shorter_trainings(rows):
    features = ["a", "b", "c"]
    three, two = (B.train(rows, features, "label", 3, rounds=n, seed=4) for n in (3, 2))
    of = lambda models, after: sorted((r["id"], [round(p, 9) for p in r["p"]]) for r in B.staged_margins(models, rows, features).select(
        "id", B.probabilities(F.col("margins"), after, 3).alias("p")).collect())
    assert of(three, 2) == of(two, -1) and of(three, 3) != of(two, -1)


def test_margins_are_those_of_the_library(rows):
    from pyspark.ml.functions import vector_to_array

    models = B.train(rows, ["a", "b"], "label", 3, rounds=4, seed=4)
    scored = B.staged_margins(models, rows, ["a", "b"])
    for c, model in enumerate(models):
        raw = model.transform(B.assemble(rows, ["a", "b"])).select("id", vector_to_array("rawPrediction")[1].alias("m"))
        gaps = scored.join(raw, "id").select(F.max(F.abs(F.element_at(F.col("margins")[c], -1) - F.col("m")))).first()[0]
        assert gaps < 1e-9


def test_two_classes_and_values(rows):
    two = rows.withColumn("label", (F.col("label") > 0).cast("int"))
    scored = B.predict(B.train(two, ["a", "b"], "label", 2, rounds=3, seed=1), two, ["a", "b"], "label", 2)
    # Thresholds come from binned values, so rows next to the border may fall on the other side.
    assert scored.filter((F.col("pred")[1] > 0.5) != (F.col("target") == 1)).count() <= 6
    assert scored.filter(F.abs(F.col("pred")[0] + F.col("pred")[1] - 1) > 1e-9).count() == 0
    fit_rows, held = B.split(rows, ["id"], 0.2, 1)
    valued = B.predict_values(B.train_values(fit_rows, ["a", "b"], "worth", rounds=20, seed=1), held, ["a", "b"], "worth")
    assert valued.select(F.avg(F.abs(F.col("pred")[0] - F.col("target")))).first()[0] < 0.15


def test_rows_with_missing_features_are_skipped(spark, rows):
    gap = spark.createDataFrame([(999, None, 0.5, 0.5, 1, 2.0)], rows.schema)
    models = B.train(rows.unionByName(gap), ["a", "b"], "label", 3, rounds=1, seed=1)
    assert B.staged_margins(models, gap, ["a", "b"]).count() == 0


def test_rows_of_one_partition_are_dealt_to_many_tasks(rows, monkeypatch):
    parts = []

    def watched(df):
        parts.append([r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()])
        return checkpoint(df)

    checkpoint = B.checkpoint
    monkeypatch.setattr(B, "checkpoint", watched)
    monkeypatch.setattr(B, "CELLS", 240)
    one = rows.coalesce(1)
    B.train(one, ["a", "b", "c"], "label", 2, rounds=1, seed=1)
    B.train_values(one, ["a", "b", "c"], "worth", rounds=1, seed=1)
    B.train_report(one, ["id"], ["a", "b", "c"], "label", classes=3, rounds=1, every=1, fraction=0.2, seed=1)
    # 240 values are 60 rows of three features and a label.
    assert len(parts) == 4 and all(max(found) <= 61 for found in parts) and [sum(found) for found in parts[:2]] == [600, 600]
    assert sum(parts[2]) + sum(parts[3]) == 600


@pytest.fixture(scope="module")
def many(spark):
    """5,000 rows, 60 kinds of features."""
    draw = random.Random(3)
    found = [(i, draw.randrange(6) / 2, draw.randrange(10) + 0.1, draw.random()) for i in range(5000)]
    label = lambda a, b, c: int(a > 1.2) + int(a > 1.2 and b > 5) if c > 0.1 else draw.randrange(3)
    return spark.createDataFrame([(i, a, b, label(a, b, c)) for i, a, b, c in found] + [(5000, None, 1.1, 0), (5001, 0.5, float("nan"), 1)],
                                 "id long, a double, b double, label int").repartition(3).cache()


def _stored(monkeypatch):
    found, checkpoint = [], B.checkpoint
    monkeypatch.setattr(B, "checkpoint", lambda df: found.append(checkpoint(df)) or found[-1])
    return found


def test_rows_alike_are_counted(many, monkeypatch):
    """Trees used to be grown on every row, over and over; the answers must be the same."""
    stored = _stored(monkeypatch)
    counted = B.train(many, ["a", "b"], "label", 3, rounds=3, seed=1)
    assert stored[0].count() <= 180 and stored[0].agg(F.sum("n")).first()[0] == 5000
    monkeypatch.setattr(B, "_fewer", lambda *of: False)
    one_by_one = B.train(many, ["a", "b"], "label", 3, rounds=3, seed=1)
    of = lambda models: {r["id"]: [round(x, 9) for m in r["margins"] for x in m] for r in B.staged_margins(models, many, ["a", "b"]).select("id", "margins").collect()}
    assert len(of(counted)) == 5000 and of(counted) == of(one_by_one)


def test_reports_from_counts(many, monkeypatch):
    stored = _stored(monkeypatch)
    monkeypatch.setattr(B, "RUN", 7)
    report = lambda: [tuple(round(x, 6) for x in r) for r in B.train_report(
        many.filter("id < 5001"), ["id"], ["a", "b"], "label", classes=3, rounds=3, every=2, fraction=0.3, seed=1).orderBy("iteration").collect()]
    counted = report()
    assert stored[1].count() <= 180 and stored[1].agg(F.max("n")).first()[0] > 7
    monkeypatch.setattr(B, "_fewer", lambda *of: False)
    assert counted == report()


def test_levels_lie_on_both_sides_of_the_library_s_bounds(spark, monkeypatch):
    """Values between levels must go the way of the level they were counted as."""
    draw = random.Random(4)
    rows = spark.createDataFrame([(i, draw.gauss(0, 1) ** 3, float(int(draw.expovariate(0.05))), draw.randrange(2)) for i in range(6000)], "id long, a double, b double, label int")
    rows = rows.withColumn("label", F.when(F.col("a") > 0.05, 1).when(F.col("b") > 60, 1).otherwise(0)).repartition(4).cache()
    monkeypatch.setattr(B, "CELLS", 500)
    monkeypatch.setattr(B, "QUANTILES", 200)
    count, levels = B._levels(rows, ["a", "b"])
    assert count == 6000 and [len(found) for found in levels] == [32, 32] and all(found == sorted(set(found)) for found in levels)
    models = B.train(rows, ["a", "b"], "label", 2, rounds=3, seed=1)
    last = F.element_at(F.col("margins")[0], -1)
    of_rows = B.staged_margins(models, rows, ["a", "b"]).groupBy("label").agg(F.sum(last)).orderBy("label").collect()
    of_cells = B.staged_margins(models, B._counted(rows, ["a", "b"], "label", levels), ["a", "b"]).groupBy("label").agg(F.sum(last * F.col("n"))).orderBy("label").collect()
    assert [round(r[1], 6) for r in of_rows] == [round(r[1], 6) for r in of_cells]
    assert B.predict(models, rows, ["a", "b"], "label", 2).filter((F.col("pred")[1] > 0.5) != (F.col("target") == 1)).count() < 200


def test_levels_of_uneven_values():
    import numpy as np

    assert B._evenly(np.array([3.0, 1, 3, 2]), np.ones(4), 3) == [1, 2, 3]
    values = np.arange(100.0)
    found = B._evenly(values, np.where(values == 10, 1000, 1), 8)
    assert len(found) == 8 and 10 in found and found == sorted(set(found)) and max(found) > 80
    assert not B._fewer(100, [[1.0, math.inf]], 2) and not B._fewer(100, [[]], 2) and B._fewer(100, [[1.0, 2.0]], 2)


@pytest.mark.parametrize("fraction", [0.0, 1e-9, 0.1, 0.25, 1.0, 1.5])
def test_split_is_by_the_hash_as_a_number(spark, fraction):
    rows = spark.range(3000).withColumn("x", F.col("id") % 7)
    share = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("9"))), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
    kept, held = B.split(rows, ["id"], fraction, 9)
    assert {r["id"] for r in held.collect()} == {r["id"] for r in rows.filter(share < fraction).collect()}
    assert kept.count() + held.count() == 3000
