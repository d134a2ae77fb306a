"""Distributed operators against brute force: skewed keys, ties and partition counts."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import joins, jsonblock, links, mining, nearest, ordered, terms
from webloom.operators import nodes as P


def test_running_totals_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", rng.randrange(40), i, rng.randrange(-9, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v long")
    got = ordered.running(df, ["t", "i"], {"total": ("sum", F.col("v")), "low": ("min", F.col("v"))}, ["k"]).collect()
    want, state = {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total, low = state.get(k, (0, 99))
        state[k] = want[i] = (total + v, min(low, v))
    assert {r["i"]: (r["total"], r["low"]) for r in got} == want


def test_ranges_are_balanced(spark):
    df = spark.range(20000).select((F.col("id") % 3).alias("t"), "id")
    sizes = [r["count"] for r in df.withColumn("r", ordered.range_of(df, ["t", "id"])).groupBy("r").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 20000 / 4


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_ordinals_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x")).repartition(3)
        assert all(r["ordinal"] == r["x"] + 1 for r in ordered.ordinal(df, ["x"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("small", [True, False])
def test_lookup_ways_agree(spark, small):
    facts = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("key"))
    table = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 10).alias("value"))
    got = joins.lookup(facts, table, "key", "left", spread_on="id", small=small)
    assert {(r["id"], r["value"]) for r in got.collect()} == {
        (i, k * 10 if k < 40 else None) for i in range(2000) for k in [0 if i % 3 == 0 else i % 50]}


def test_broadcast_is_checked(spark):
    assert joins.fits_broadcast(spark.range(10))
    assert not joins.fits_broadcast(spark.range(10), rows=9)
    assert not joins.fits_broadcast(spark.range(10), size=5)


@pytest.mark.parametrize("block", [4, 1000])
def test_nearest_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vector array<double>")
    got = nearest.nearest_vectors(df.filter("id < 10"), df, 3, "euclidean").collect()
    distance = np.linalg.norm(points[:10, None] - points[None], axis=2)
    want = {(q, int(np.argsort(distance[q], kind="stable")[r]), r + 1) for q in range(10) for r in range(3)}
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in got} == want


def test_keyword_categories(spark):
    urls = spark.createDataFrame([(1, "http://News.example.com/sport"), (2, "http://x.org"), (3, "a")], "id long, url string")
    words = spark.createDataFrame([("news", "media"), ("sport", "sport"), ("org", "ngo"), ("ex", "media"), ("a" * 90, "long")], "keyword string, category string")
    got = terms.keyword_categories(urls, words, "id", "url")
    assert {tuple(r) for r in got.collect()} == {(1, "media"), (1, "sport"), (2, "ngo")}


def test_crawl_depth(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")]
    got = links.crawl_depth(spark.createDataFrame([("a",)], "url string"), spark.createDataFrame(edges, "url string, link string"), 3)
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_components(spark):
    rng = random.Random(3)
    edges = [(p, a, a + 1) for p in range(2) for a in range(0, 60) if rng.random() < 0.85]
    vertices = [(p, v) for p in range(2) for v in range(61)]
    got = mining.connected(spark.createDataFrame(vertices, "page_id long, v long"), spark.createDataFrame(edges, "page_id long, a long, b long"))
    parent = {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for p, a, b in edges:
        x, y = find((p, a)), find((p, b))
        parent[max(x, y)] = min(x, y)
    assert {((r["page_id"], r["v"]), (r["page_id"], r["label"])) for r in got.collect()} == {(v, find(v)) for v in vertices}


@pytest.mark.parametrize("eps", [0.8, 1.2])
def test_similar_shapes_are_all_found(spark, eps):
    rng = random.Random(7)
    shapes = [{f"p{k}": rng.randrange(1, 5) for k in rng.sample(range(8), rng.randrange(2, 6))} for _ in range(60)]
    rows = [(1, 0, "li", [], sorted((-len(p), p, n) for p, n in s.items()), sum(s.values()), i, 1) for i, s in enumerate(shapes)]
    folded = spark.createDataFrame(rows, "page_id long, parent int, tag string, classes array<string>, "
                                         "shape array<struct<order: int, path: string, n: int>>, size int, first int, members long")
    want = set()
    for i, j in itertools.combinations(range(60), 2):
        keys = set(shapes[i]) | set(shapes[j])
        low = sum(min(shapes[i].get(k, 0), shapes[j].get(k, 0)) for k in keys)
        high = sum(max(shapes[i].get(k, 0), shapes[j].get(k, 0)) for k in keys)
        a, b = sum(shapes[i].values()), sum(shapes[j].values())
        if (2 - 2 * low / high) ** 0.5 + 1 - (1 - abs(a - b) / (a + b)) ** 2 <= eps:
            want.add((i, j))
    assert want and {(r["a"], r["b"]) for r in mining.subtree_similarity(folded, eps).collect()} == want


LISTING = "<html><body><div><h1>Shop</h1></div><ul>" + "".join(
    f'<li class="item"><h2>Title {i}</h2><a href="/p/{i}">more</a>{"<i>new</i>" if i % 4 == 0 else ""}</li>' for i in range(12)) + "</ul></body></html>"


def test_listing_page_titles_are_mined(spark):
    trees = P.page_nodes(spark.createDataFrame([(1, "http://a.com/", LISTING)], "page_id long, url string, html string"))
    rows = P.node_rows(trees)
    clusters = mining.cluster_subtrees(mining.node_shapes(trees))
    kept = mining.separate_clusters(clusters)
    best = mining.ranked_clusters(mining.score_clusters(kept), 6).filter("rank = 1")
    assert best.first()["items"] == 12
    items = mining.regularize_items(mining.extract_items(rows, kept, best))
    fields = mining.align_fields(rows, items)
    assert {f"Title {i}" for i in range(12)} <= {r["value"] for r in fields.collect()}
    schema = {r["key"]: r for r in mining.item_schema(fields).collect()}
    assert schema["0:li/a#0"]["type"] == "url" and schema["0:li/h2/[T]#0"]["vary"]
    assert schema["0:li/h2/[T]#0"]["required"] and not schema["0:li/i/[T]#0"]["required"]


def test_duplicate_pages_are_mined_alike(spark):
    pages = spark.createDataFrame([(i, "u", LISTING) for i in (1, 2)], "page_id long, url string, html string")
    got = mining.cluster_subtrees(mining.node_shapes(P.page_nodes(pages))).drop("path").collect()
    by_page = lambda p: {tuple(r)[1:] for r in got if r["page_id"] == p}
    assert by_page(1) == by_page(2) != set()


def test_equal_vectors_are_neighbours_but_not_the_query_itself(spark):
    from webloom.operators.nearest import nearest_vectors

    vectors = spark.createDataFrame([(k, [1.0 + 1e-7 * (k // 3), 2.0]) for k in range(9)], "id long, vector array<double>")
    got = nearest_vectors(vectors.filter("id = 4"), vectors, 4, "euclidean", itself=False).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"]) for r in got] == [(3, 1), (5, 2), (0, 3), (1, 4)]
    assert got[0]["distance"] == 0 and abs(got[2]["distance"] - 1e-7) < 1e-9


def test_leaf_paths_of_mixed_documents(spark):
    texts = ['{"a": [{"b": 1}, {"b": {"c": null}}, [2, "x"]], "m": {}}', '{"a": "s", "d.e": {"f": true}, "n": []}', '7', 'null', None, '[]', "[" * 300 + "1" + "]" * 300]
    docs = spark.createDataFrame([(t,) for t in texts * 50], "j string").select(F.parse_json("j").alias("v")).repartition(5)
    got = [r["path"] for r in jsonblock.leaf_paths(docs, "v").collect()]
    assert sorted(got) == sorted([".a[*].b", ".a[*].b.c", ".a[*][*]", ".a", ".d.e.f", "", "[*]" * 300])
    assert jsonblock.leaf_paths(docs.limit(0), "v").count() == 0
