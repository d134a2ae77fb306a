"""Whitening against numpy and exact integers."""

import collections
import math

import numpy as np
import pytest

from tests.conftest import FOLDER
from webloom.llm import QUERIES, whitening
from webloom.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, key long, weight int, n int"


def brute(rows, components=16, weighted=False):
    kept = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    copies = collections.Counter(x for _, x in kept)
    weights = [copies[x] if weighted else 1 for x in copies]
    xs = np.array(list(copies), float)
    n = sum(weights)
    totals = [sum(w * x[k] for x, w in zip(copies, weights)) for k in range(xs.shape[1])]
    centred = xs - np.array(totals) / n
    cov = (centred * np.array(weights, float)[:, None]).T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    deviation = {x: sum((n * c - s) ** 2 for c, s in zip(x, totals)) for x in copies}
    return kept, n, deviation, values, vectors, np.array(totals) / n, np.trace(cov)


def check(rows, got, **settings):
    kept, n, deviation, values, vectors, mean, trace = brute(rows, **settings)
    width = len(values)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r["vec_id"]].append(r)
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i, _ in kept for _ in range(width))
    signs = None
    for i, x in kept:
        mine = [r for r in by_id[i] if r["deviation"] == deviation[x]]
        assert {r["component"] for r in mine} == set(range(1, width + 1)) and {r["n"] for r in mine} == {n}
        white = (np.array(x) - mean) @ vectors / np.sqrt(values)
        own = np.array([next(r["whitened"] for r in mine if r["component"] == k + 1) for k in range(width)])
        if signs is None and np.abs(white).min() > 1e-6:
            signs = np.sign(white) * np.sign(own)
        assert np.allclose(np.abs(own), np.abs(white), atol=1e-6)
        assert signs is None or np.allclose(own * signs, white, atol=1e-6)
    assert all(abs(r["explained"] - values[r["component"] - 1] / trace) < 1e-9 and r["identity_error"] < 1e-8 for r in got)


@pytest.mark.parametrize("weighted", [False, True])
def test_whitening_equals_numpy(spark, weighted):
    draw = np.random.default_rng(3)
    vectors = [[float(c) for c in np.float32(draw.normal(0, [1, 2, 3, 4, 5]))] for _ in range(60)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(1000 + k, vectors[0]) for k in range(90)] + [(None, vectors[1]), (3, vectors[2]), (3, vectors[2])]
    bad = [(500, None), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [1.0, math.nan, 1.0, 1.0, 1.0]), (503, [1.0, math.inf, 1.0, 1.0, 1.0]), (504, [3e38, 1.0, 1.0, 1.0, 1.0]), (505, []), (506, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3, 4, 5) for i, v in rows + bad], SCHEMA).repartition(4)
    check(rows, whitening.whiten(df, weighted=weighted).collect(), weighted=weighted)


def test_query_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, FOLDER, "embeddings").collect()]
    check(rows, QUERIES["op12_embedding_whitening"](spark, FOLDER).collect())


def test_vectors_without_variance_and_empty_tables(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0], 1, 2, "x", 3, 4, 5) for k in range(5)], SCHEMA)
    got = whitening.whiten(same).collect()
    assert len(got) == 10 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in got)
    flat = spark.createDataFrame([(k, [1.0, float(k)], 1, 2, "x", 3, 4, 5) for k in range(4)], SCHEMA)
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(flat).collect()}
    assert all(got[k, 2] is None and got[k, 1] is not None for k in range(4))
    assert whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [], 1, 2, "x", 3, 4, 5)], SCHEMA)).count() == 0


def test_deviation_is_exact_and_null_beyond_a_long():
    model = whitening.Fit(3, [3_000_001, 2**40], np.zeros(0), np.zeros((2, 0)), 0.0)
    rows = np.array([[1_000_000, 7], [5, 2**38]], np.int64)
    assert whitening.deviations(rows, model) == [sum((3 * int(v) - s) ** 2 for v, s in zip(r, model.sums)) if sum(
        (3 * int(v) - s) ** 2 for v, s in zip(r, model.sums)) < 2**63 else None for r in rows]
