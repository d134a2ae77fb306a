"""Faults that the third round's review found."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from webloom.operators import nearest, terms
from webloom.operators.spread import spread

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

DOMAIN = """
from webloom.session import local_session
from webloom.operators.features import category_domain
spark = local_session(2, 4)
rows = [(i, "a", "b", f"Brand#{i % 25 + 1}", 1, 2.0) for i in range(100)]
df = spark.createDataFrame(rows, "a long, b string, c string, p_brand string, e long, f double")
found = {r["value"]: r["index"] for r in category_domain(df, "p_brand").collect()}
assert found == {v: i for i, v in enumerate(sorted({r[3] for r in rows}))}, found
"""


def test_domain_in_a_new_session():
    """The wrong filter on the range totals depended on column numbers, which a new session counts from zero."""
    done = subprocess.run([sys.executable, "-c", DOMAIN], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def _documents(spark, rng, ids):
    rows = []
    for i in ids:
        terms = sorted(set((rng.zipf(1.4, size=rng.integers(1, 40)) % 300).tolist()))
        rows.append((i, [f"w{t}" for t in terms], [float(w) for w in rng.random(len(terms)).round(3)]))
    return rows, spark.createDataFrame(rows, "id long, terms array<string>, weights array<double>")


def test_items_are_not_copied_for_some_hundred_queries(spark, monkeypatch):
    """Every block of 512 queries used to take a copy of all items."""
    rng = np.random.default_rng(1)
    _, queries = _documents(spark, rng, range(1100))
    _, items = _documents(spark, rng, range(5000, 5300))

    def counting(k):
        return lambda key, q, i: pd.DataFrame({"query_id": [int(key[0])], "item_id": [int(key[1])], "score": [float(len(i))]})

    monkeypatch.setattr(nearest, "_sparse_cell", counting)
    assert nearest.nearest_documents(queries, items, 1000).agg(F.sum("score")).first()[0] == 300


@pytest.mark.parametrize("sparse", [1, 10**9])
def test_tiles_and_both_ways_of_products(spark, sparse):
    """Small tiles, all terms through matrices or all pair by pair: the same as brute force."""
    rng = np.random.default_rng(2)
    (q, queries), (i, items) = _documents(spark, rng, range(40)), _documents(spark, rng, range(100, 190))
    cell = nearest._sparse_cell(4)
    before = nearest.QUERY_TILE, nearest.ITEM_TILE, nearest.SPARSE
    nearest.QUERY_TILE, nearest.ITEM_TILE, nearest.SPARSE = 7, 16, sparse
    try:
        found = cell((0, 0), *(pd.DataFrame(rows, columns=["id", "terms", "weights"]) for rows in (q, i)))
    finally:
        nearest.QUERY_TILE, nearest.ITEM_TILE, nearest.SPARSE = before
    got = {(a, b, round(c, 6)) for a, b, c in found.itertuples(index=False)}
    want = set()
    for a, terms, weights in q:
        mine = dict(zip(terms, weights))
        scores = sorted((-round(sum(mine.get(t, 0) * w for t, w in zip(ts, ws)), 9), b) for b, ts, ws in i)
        want |= {(a, b, round(-s, 6)) for s, b in scores[:4] if s < 0}
    assert got == want


def _grown(spark, folder, monkeypatch):
    """A stored table of a few pieces per core."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda x: F.sha1((F.col("doc_id") * 31 + x).cast("string"))))
    spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(words, F.lit(" twice twice")).alias("text")).write.parquet(folder)
    monkeypatch.setattr("webloom.operators.spread.PIECE", 64 * 1024)
    return spark.read.parquet(folder)


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    """There used to be one partition per core, whatever the size."""
    docs = _grown(spark, str(tmp_path / "docs"), monkeypatch)
    cores = spark.sparkContext.defaultParallelism
    assert spread(docs, "doc_id").rdd.getNumPartitions() > 4 * cores
    assert terms.rake_keywords(docs, ("the",)).rdd.getNumPartitions() > 4 * cores


def test_large_documents_are_dealt_before_they_become_words(spark, tmp_path, monkeypatch):
    """Beyond a split per core the words themselves used to be shuffled, for the counts and again for the norms."""
    docs = _grown(spark, str(tmp_path / "docs"), monkeypatch)
    monkeypatch.setattr("webloom.operators.spread.SPLIT", 1)
    bag = terms.bag_of_words(docs, F.split("text", " "))
    plan = terms.unit_weights(bag)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert bag.filter("term = 'twice' and tf = 2").count() == 2000
