"""Toxicity: the learner against the published update rule, and held-out accuracy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_operators import prose
from webloom.llm import QUERIES, lm_scoring, toxicity
from webloom.llm.common import table as given

DOCS = "doc_id long, text string, lang string, toxic int, score double, shard int"


def brute(rows, labels, alpha, beta, l1, l2, passes):
    """Per-coordinate update with dictionaries, one feature at a time."""
    z, n = {}, {}
    bias = [0.0, 0.0]
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= l1 else -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)
    lone = lambda: -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)
    for _ in range(passes):
        for row, label in zip(rows, labels):
            w, b = {f: weight(f) for f in row}, lone()
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - label
            for f in row:
                was = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / alpha * w[f]
                n[f] = was + g * g
            bias = [bias[0] + g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / alpha * b, bias[1] + g * g]
    return {f: weight(f) for f in z if weight(f)}, lone()


def test_learner_equals_the_update_rule():
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.integers(0, 40, 12)).astype(np.int32) for _ in range(80)]
    labels = [int(3 in r or 5 in r) for r in rows]
    for kw in (dict(alpha=0.5, beta=1.0, l1=1.0, l2=0.5, passes=3), dict(alpha=1.0, beta=0.5, l1=0.2, l2=0.0, passes=2)):
        model = toxicity.ftrl(rows, labels, **kw)
        want, bias = brute([r.tolist() for r in rows], labels, **kw)
        assert sorted(want) == model.names.tolist() and np.allclose([want[f] for f in sorted(want)], model.weights) and math.isclose(bias, model.bias)


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = prose(8, 3000)
    whole = toxicity.features(toxicity.Words().hashes(text))
    monkeypatch.setattr(toxicity, "BLOCK", 97)
    assert (toxicity.features(toxicity.Words().hashes(text)) == whole).all()
    assert toxicity.features(toxicity.Words().hashes("")).size == 0
    assert toxicity.Words().hashes("Ab, x").tolist() == toxicity.Words().hashes("ab\nX!").tolist()


def sample(spark, n=400):
    rows = []
    for k in range(n):
        draw = random.Random(k)
        words = prose(k, 40).split()
        if k % 5 == 0:
            words[draw.randrange(40)] = draw.choice(["vile", "Nasty,"])
            words[draw.randrange(40)] = "vile"
        rows.append((k, " ".join(words), "en", 9, 9.0, 9))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, int(k % 5 == 0), 1) for k in range(n)], "doc_id long, toxic int, quality int")


def test_scores_of_edge_rows(spark):
    docs, labels = sample(spark)
    more = spark.createDataFrame([(None, "all vile and nasty", "en", 9, 9.0, 9), (3, None, None, 9, 9.0, 9), (3, "", None, 9, 9.0, 9), (5000, prose(1, 20000), "en", 9, 9.0, 9)], DOCS)
    bad = spark.createDataFrame([(None, 1, 1), (4, None, 1), (7, 0, 1), (7, 0, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs.unionByName(more), labels.unionByName(bad))
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs.unionByName(more), model).collect()]
    assert len(got) == 404 and all(0 <= s <= 1 for _, s in got)
    assert all((s >= 0.3) == (i % 5 == 0) for i, s in got if i is not None and i < 400 and i != 3)
    assert next(s for i, s in got if i is None) > 0.3 and next(s for i, s in got if i == 5000) < 0.3
    assert sum(s < 0.3 for i, s in got if i == 3) == 3
    two = toxicity.train(docs, labels, most=300, shard_rows=160)
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in toxicity.score(docs, two).collect())


def test_no_labels_and_no_documents(spark):
    docs, labels = sample(spark, 20)
    model = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs.limit(0), labels).bias == -math.inf
    calm = toxicity.train(docs, labels.filter("toxic = 0"))
    assert all(r["score"] < 0.3 for r in toxicity.score(docs, calm).collect())


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op11_toxicity"](spark, folder)
    held = rows.join(given(spark, folder, "labels"), "doc_id").filter("held_out").collect()
    assert rows.count() == given(spark, folder, "documents").count()
    english = {r["doc_id"] for r in given(spark, folder, "documents").filter("lang = 'en'").select("doc_id").collect()}
    toxic = [r["predicted"] for r in held if r["toxic"] == 1 and r["doc_id"] in english]
    assert len(toxic) > 20 and sum(toxic) >= 0.9 * len(toxic)
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert sum(clean) <= 0.01 * len(clean)
    assert rows.filter(F.col("held_out") != (lm_scoring.remainder(4) == 2)).count() == 0
