"""Mining of repeated items: similar sibling subtrees, clusters, items and their fields.

Everything is keyed by page. Node rows are partitioned by page once; the groupings and
windows that follow reuse that partitioning. Siblings of equal shape are folded into one
weighted row before any comparison, and comparisons are found by a prefix filter, so a
list of ten thousand equal entries costs one row and no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.vectors import boost, class_similarity, size_distance
from webloom.operators.nodes import TEXT, shared_prefix
from webloom.session import checkpoint, ship

EPS = 1.2
MIN_CLUSTER = 6
DEPTH = 2
NEIGHBOURS = 4
# Distance grows with 1 - similarity: an edge at EPS needs at least this similarity.
MIN_SIMILARITY = 1 - EPS * EPS / 2
BLOCK = ["page_id", "parent", "tag"]


def node_shapes(trees: DataFrame) -> DataFrame:
    """Tag nodes with their shape: the tag paths below them to depth two, counted.

    Built from the page's own array: (page_id, node, parent, tag, classes, size, path, shape).
    """
    nodes = F.col("nodes")

    def shape(n: Column) -> Column:
        cut = F.length(n["tag_path"]) - F.length(n["tag"]) + 1
        near = F.filter(F.slice(nodes, n["node"] + 1, n["end_node"] - n["node"]), lambda x: x["depth"] <= n["depth"] + DEPTH)
        paths = F.transform(near, lambda x: F.substring(x["tag_path"], cut, F.length(x["tag_path"])))
        counted = F.transform(F.array_distinct(paths), lambda p: F.struct(
            (-F.length(p)).alias("order"), p.alias("path"), F.size(F.filter(paths, lambda q: q == p)).alias("n")))
        return F.array_sort(counted)

    tagged = F.transform(F.filter(nodes, lambda n: n["tag"] != TEXT), lambda n: F.struct(
        n["node"].alias("node"), n["parent"].alias("parent"), n["tag"].alias("tag"), n["classes"].alias("classes"),
        (n["end_node"] - n["node"]).alias("size"), n["path"].alias("path"), shape(n).alias("shape")))
    return trees.select("page_id", F.inline(tagged))


def marked_shapes(shapes: DataFrame) -> DataFrame:
    """Every node with ``first``, the smallest sibling of equal tag, classes, shape and size, and
    ``members``, how many there are. Only the first one keeps the shape."""
    equal = Window.partitionBy(*BLOCK, "classes", "shape", "size")
    marked = shapes.withColumn("first", F.min("node").over(equal)).withColumn("members", F.count("*").over(equal))
    return marked.withColumn("shape", F.when(F.col("node") == F.col("first"), F.col("shape")))


def folded_shapes(marked: DataFrame) -> DataFrame:
    """One row per group of equal siblings: ``first`` node and ``members``."""
    return marked.filter(F.col("node") == F.col("first")).select(*BLOCK, "classes", "shape", "size", "first", "members")


def _prefix(shape: Column, least: float) -> Column:
    """Paths that any shape of similarity >= ``least`` must share at least one of."""
    total = F.aggregate(shape, F.lit(0), lambda s, x: s + x["n"])
    rest = lambda i: F.aggregate(F.slice(shape, i + 1, F.size(shape)), F.lit(0), lambda s, x: s + x["n"])
    return F.transform(F.filter(shape, lambda x, i: rest(i) >= least * total), lambda x: x["path"])


def shape_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard: sum of the smaller counts over sum of the larger."""
    counts = lambda s: F.map_from_entries(F.transform(s, lambda x: F.struct(x["path"], x["n"])))
    both = F.map_values(F.map_zip_with(counts(a), counts(b), lambda k, x, y: F.struct(
        F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("low"), F.greatest(x, y).alias("high"))))
    total = lambda name: F.aggregate(both, F.lit(0), lambda s, x: s + x[name])
    return total("low") / total("high")


def subtree_similarity(folded: DataFrame, eps: float = EPS) -> DataFrame:
    """Pairs of sibling shapes within ``eps``: (page_id, parent, tag, a, b, similarity, distance)."""
    least = max(1 - eps * eps / 2, 1e-9)
    keyed = folded.withColumn("prefix", _prefix(F.col("shape"), least))
    side = lambda name: keyed.select(
        *BLOCK, F.explode("prefix").alias("token"), F.struct("first", "members", "classes", "shape", "size", "prefix").alias(name))
    pairs = side("l").join(side("r"), [*BLOCK, "token"]).filter(F.col("l.first") < F.col("r.first"))
    # A pair meets once per shared token; only the first shared one counts.
    once = pairs.filter(F.col("token") == F.get(F.array_intersect("l.prefix", "r.prefix"), 0))
    similarity = shape_similarity(F.col("l.shape"), F.col("r.shape")) * class_similarity(F.col("l.classes"), F.col("r.classes"))
    measured = once.select(*BLOCK, F.col("l.first").alias("a"), F.col("r.first").alias("b"), F.col("l.members").alias("a_members"),
                           F.col("r.members").alias("b_members"), similarity.alias("similarity"),
                           boost(size_distance(F.col("l.size"), F.col("r.size"))).alias("size_part"))
    distance = F.sqrt(F.greatest(2 - 2 * F.col("similarity"), F.lit(0.0))) + F.col("size_part")
    return measured.withColumn("distance", distance).drop("size_part").filter(F.col("distance") <= eps)


def connected(vertices: DataFrame, edges: DataFrame, scope: str = "page_id") -> DataFrame:
    """(scope, v, label): smallest vertex of each component. ``vertices`` holds (scope, v),
    ``edges`` (scope, a, b); no edge leaves its scope.

    One shuffle brings the edges of a scope together, sorted; they then stream through a union-find
    that knows the vertices of one scope at a time, however many edges there are.
    """
    # A stated number of partitions is never merged: small edge rows would else meet in few tasks.
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.select(scope, "a", "b").repartition(tasks, scope).sortWithinPartitions(scope)
    kinds = [edges.schema[scope].dataType, edges.schema["a"].dataType]
    schema = T.StructType([T.StructField(scope, kinds[0]), T.StructField("v", kinds[1]), T.StructField("label", kinds[1])])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        done: list[tuple] = []
        current = None

        def root(v):
            while above[v] != v:
                above[v] = v = above[above[v]]
            return v

        def close() -> bool:
            done.extend((current, v, root(v)) for v in above)
            above.clear()
            return len(done) >= 8192

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=[scope, "v", "label"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in (0, 1, 1)]
            for of, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if of != current:
                    if close():
                        yield rows()
                    current = of
                above.setdefault(a, a)
                above.setdefault(b, b)
                low, high = sorted((root(a), root(b)))
                above[high] = low
        close()
        if done:
            yield rows()

    found = checkpoint(rows.mapInArrow(find, schema))
    return vertices.select(scope, "v").join(found, [scope, "v"], "left").withColumn("label", F.coalesce("label", "v"))


def cluster_subtrees(shapes: DataFrame, eps: float = EPS, min_size: int = MIN_CLUSTER) -> DataFrame:
    """(page_id, parent, node, tag, size, path, cluster, members) of nodes in clusters of similar
    siblings with at least ``min_size`` nodes. A cluster is named by its smallest node."""
    marked = checkpoint(marked_shapes(shapes))
    folded = folded_shapes(marked)
    labels = connected(folded.select("page_id", F.col("first").alias("v")), subtree_similarity(folded, eps))
    named = folded.select("page_id", "first", "members").join(labels.withColumnRenamed("v", "first"), ["page_id", "first"])
    total = F.sum("members").over(Window.partitionBy("page_id", "label"))
    kept = named.withColumn("members", total).filter(F.col("members") >= min_size)
    return marked.drop("members", "shape").join(kept, ["page_id", "first"]).select(
        "page_id", "parent", "node", "tag", "size", "path", F.col("label").alias("cluster"), "members")


def tournament_counts(clusters: DataFrame) -> DataFrame:
    """(page_id, outer, inner, n): how often a node of one cluster contains a node of another."""
    above = clusters.select("page_id", F.col("cluster").alias("inner"), F.explode(F.slice("path", 1, F.size("path") - 1)).alias("node"))
    owners = clusters.select("page_id", "node", F.col("cluster").alias("outer"))
    return above.join(owners, ["page_id", "node"]).groupBy("page_id", "outer", "inner").agg(F.count("*").alias("n"))


def separate_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters without the nodes that lie inside a node of a higher-ranked cluster. Rank:
    clusters contained in it, then the smaller name."""
    counts = tournament_counts(clusters).filter("outer <> inner")
    back = counts.select("page_id", F.col("outer").alias("inner"), F.col("inner").alias("outer"), F.col("n").alias("m"))
    wins = (counts.join(back, ["page_id", "outer", "inner"], "left").filter(F.col("n") > F.coalesce("m", F.lit(0)))
            .groupBy("page_id", F.col("outer").alias("cluster")).agg(F.count("*").alias("wins")))
    ranked = clusters.join(wins, ["page_id", "cluster"], "left").withColumn("rank", F.struct(-F.coalesce("wins", F.lit(0)), F.col("cluster")))
    owners = ranked.select("page_id", F.col("node").alias("above"), F.col("rank").alias("above_rank"))
    inside = (ranked.select("page_id", "node", "rank", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("above"))
              .join(owners, ["page_id", "above"]).filter(F.col("above_rank") < F.col("rank")).select("page_id", "node").distinct())
    return clusters.join(inside, ["page_id", "node"], "left_anti")


def score_clusters(clusters: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(page_id, cluster, items, score): smaller size over squared distance, summed over each
    node's ``k`` nearest cluster mates. Mates are siblings, two hops apart, so the nearest ones
    are the next in order; they are read with a bounded window instead of a self-join."""
    order = Window.partitionBy("page_id", "cluster").orderBy("node")
    mates = [F.struct(F.lit(d).alias("steps"), F.lit(s).alias("side"), (F.lag if s == 0 else F.lead)("size", d).over(order).alias("size"))
             for d in range(1, k + 1) for s in (0, 1)]
    near = F.slice(F.array_sort(F.filter(F.col("mates"), lambda m: m["size"].isNotNull())), 1, k)
    share = F.aggregate(near, F.lit(0.0), lambda s, m: s + F.least(m["size"], F.col("size")) / 4.0)
    return (clusters.select("page_id", "cluster", "size", F.array(*mates).alias("mates"))
            .groupBy("page_id", "cluster").agg(F.count("*").alias("items"), F.sum(share).alias("score")))


def ranked_clusters(scores: DataFrame, min_items: int) -> DataFrame:
    """Clusters of a page from best to worst score."""
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "cluster")
    return scores.filter(F.col("items") >= min_items).withColumn("rank", F.row_number().over(order).cast("bigint"))


def extract_items(rows: DataFrame, clusters: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, label, parent, item, node, pos, root_label): items as runs of tag children.

    Under a parent that has a child of the label, a new item starts whenever the first label
    seen there comes again; items without a root of the label are dropped. ``labels`` limits
    the (page_id, cluster) pairs that are extracted.
    """
    wanted = clusters if labels is None else clusters.join(labels.select("page_id", "cluster"), ["page_id", "cluster"], "left_semi")
    parents = wanted.select("page_id", "parent", F.col("cluster").alias("label")).distinct()
    children = rows.filter(F.col("tag") != TEXT).select("page_id", "parent", "node").join(parents, ["page_id", "parent"])
    named = children.join(clusters.select("page_id", "node", F.col("cluster").alias("root_label")), ["page_id", "node"], "left")
    family = Window.partitionBy("page_id", "label", "parent")
    order = family.orderBy("node")
    first = F.first("root_label", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = F.sum((F.coalesce("root_label", F.lit(-1)) == F.col("first")).cast("int")).over(order)
    cut = named.withColumn("first", first).withColumn("item", F.greatest(starts, F.lit(1)))
    item = Window.partitionBy("page_id", "label", "parent", "item")
    return (cut.withColumn("hit", F.max((F.col("root_label") == F.col("label")).cast("int")).over(item))
            .withColumn("pos", (F.row_number().over(item.orderBy("node")) - 1).cast("bigint"))
            .filter("hit = 1").select("page_id", "label", "parent", "item", "node", "pos", "root_label"))


def regularize_items(items: DataFrame, max_cut: float = 0.33) -> DataFrame:
    """Items of the most frequent length. Longer ones keep the roots with the most frequent
    labels; shorter ones go; a label with too many longer items is given up."""
    lengths = items.groupBy("page_id", "label", "parent", "item").agg(F.count("*").alias("length"))
    votes = lengths.groupBy("page_id", "label", "length").agg(F.count("*").alias("votes"))
    mode = votes.groupBy("page_id", "label").agg(
        F.max_by("length", F.struct(F.col("votes"), -F.col("length"))).alias("mode"), F.sum("votes").alias("total"))
    longer = votes.join(mode, ["page_id", "label"]).groupBy("page_id", "label", "mode", "total").agg(
        F.sum(F.when(F.col("length") > F.col("mode"), F.col("votes")).otherwise(0)).alias("cut"))
    usable = longer.filter(F.col("cut") <= max_cut * F.col("total")).select("page_id", "label", "mode")
    kept = items.join(lengths, ["page_id", "label", "parent", "item"]).join(usable, ["page_id", "label"]).filter("length >= mode")
    common = F.count("*").over(Window.partitionBy("page_id", "label", "root_label"))
    best = Window.partitionBy("page_id", "label", "parent", "item").orderBy(F.desc("common"), F.desc("node"))
    chosen = kept.withColumn("common", common).withColumn("place", F.row_number().over(best)).filter("place <= mode")
    again = Window.partitionBy("page_id", "label", "parent", "item").orderBy("node")
    return chosen.withColumn("pos", (F.row_number().over(again) - 1).cast("bigint")).select(*items.columns)


def divide_records(items_by_separator: DataFrame) -> DataFrame:
    """(page_id, parent, separator, records, score) of the best separator per parent.

    Input: (page_id, parent, separator, record, label) rows. Agreement of two records is the
    number of entries (label, ordinal) both have; over all pairs an entry held by m records
    counts m(m-1)/2, so no pair is built. The score is the mean agreement per record length.
    """
    key = ["page_id", "parent", "separator"]
    numbered = items_by_separator.groupBy(*key, "record", "label").agg(F.count("*").alias("n"))
    entries = numbered.select(*key, "record", "label", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("ordinal"))
    held = entries.groupBy(*key, "label", "ordinal").agg(F.count("*").alias("m"))
    shared = held.groupBy(*key).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("shared"), F.sum("m").alias("length"))
    records = numbered.groupBy(*key).agg(F.countDistinct("record").alias("records"))
    pairs = F.col("records") * (F.col("records") - 1) / 2
    scored = shared.join(records, key).withColumn("score", F.col("shared") / (pairs + 1) / (F.col("length") / F.col("records")))
    best = F.max_by(F.struct("separator", "records", "score"), F.struct(F.col("score"), -F.col("separator")))
    return scored.groupBy("page_id", "parent").agg(best.alias("b")).select("page_id", "parent", "b.separator", "b.records", "b.score")


def separated(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Children of every clustered parent, cut once per separator label found among them."""
    children = (rows.filter(F.col("tag") != TEXT).select("page_id", "parent", "node")
                .join(clusters.select("page_id", "parent").distinct(), ["page_id", "parent"], "left_semi")
                .join(clusters.select("page_id", "node", F.col("cluster").alias("label")), ["page_id", "node"], "left")
                .withColumn("label", F.coalesce("label", F.lit(-1))))
    separators = clusters.select("page_id", "parent", F.col("cluster").alias("separator")).distinct()
    order = Window.partitionBy("page_id", "parent", "separator").orderBy("node")
    return children.join(separators, ["page_id", "parent"]).withColumn(
        "record", F.sum((F.col("label") == F.col("separator")).cast("int")).over(order))


def align_fields(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(page_id, label, parent, item, key, column, node, tag, value): fields of all items in
    shared columns. A column is (root position, tag path below the root, ordinal in the item);
    columns are numbered by their smallest node."""
    roots = items.select("page_id", "label", "parent", "item", "pos", F.col("node").alias("root"))
    interesting = rows.filter(F.col("tag").isin(TEXT, "a", "img")).select(
        "page_id", "node", "tag", "path", "tag_path", F.coalesce(
            F.col("text"), F.try_element_at("attrs", F.lit("href")), F.try_element_at("attrs", F.lit("src"))).alias("value"))
    inside = interesting.select("*", F.posexplode("path").alias("up", "root")).join(roots, ["page_id", "root"])
    below = F.concat_ws("/", F.slice(F.split(F.substring("tag_path", F.lit(2), F.length("tag_path")), "/"), F.col("up") + 1, F.size("path")))
    keyed = inside.withColumn("below", F.concat_ws(":", "pos", below))
    ordinal = F.row_number().over(Window.partitionBy("page_id", "label", "parent", "item", "below").orderBy("node")) - 1
    fields = keyed.withColumn("key", F.concat_ws("#", "below", ordinal.cast("string")))
    start = F.min("node").over(Window.partitionBy("page_id", "label", "key"))
    numbered = fields.withColumn("start", start).withColumn(
        "column", (F.dense_rank().over(Window.partitionBy("page_id", "label").orderBy("start", "key")) - 1).cast("bigint"))
    return numbered.select("page_id", "label", "parent", "item", "key", "column", "node", "tag", "value")


def item_schema(fields: DataFrame) -> DataFrame:
    """(page_id, label, column, key, type, required, vary, present, items) per column.

    The items of a label are numbered where their fields lie, so that ``fields`` are read once.
    """
    label = Window.partitionBy("page_id", "label")
    numbered = fields.withColumn("place", F.dense_rank().over(label.orderBy("parent", "item")))
    kind = F.when(F.bool_and(F.col("tag") == "img"), "image").when(F.bool_and(F.col("tag") == "a"), "url").otherwise("text")
    columns = numbered.groupBy("page_id", "label", "column", "key").agg(
        kind.alias("type"), F.countDistinct("parent", "item").alias("present"), F.countDistinct("value").alias("values"), F.max("place").alias("place"))
    return columns.withColumn("items", F.max("place").over(label).cast("bigint")).select(
        "page_id", "label", "column", "key", "type", (F.col("present") == F.col("items")).alias("required"),
        (F.col("values") > 1).alias("vary"), "present", "items")


def pair_sequences(own: list[str], seed: list[str]) -> list[int]:
    """For every field of ``own`` the place of its partner in ``seed``, -1 without one.

    Fields are tag paths. Partners keep their order and are used once. The most fields with equal paths are paired,
    then the most with equal last tags, and of such pairings the one whose ordinals differ least.
    """
    if not own or not seed:
        return [-1] * len(own)
    shift = len(own) * len(seed) + 1  # more than all ordinals can differ
    near, equal = shift, shift * (min(len(own), len(seed)) + 1)
    last = lambda path: path.replace(":", "/").rsplit("/", 1)[-1]
    paths, tags = np.array(seed), np.array([last(p) for p in seed])
    places = np.arange(len(seed))
    best = np.zeros((len(own) + 1, len(seed) + 1), np.int64)
    for i, path in enumerate(own):
        gain = np.where(paths == path, equal, np.where(tags == last(path), near, 0))
        paired = np.where(gain > 0, best[i, :-1] + gain - np.abs(places - i), -1)
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], paired))
    found = [-1] * len(own)
    i, j = len(own), len(seed)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            found[i - 1] = j - 1
            i, j = i - 1, j - 1
    return found


def matched_fields(fields: DataFrame) -> DataFrame:
    """(page_id, label, parent, item, node, key, seed_key): every field with its partner in the seed, null without one.

    The seed of a label is its item with the most fields, the first of equal ones. Each item is compared with
    the seed alone, so the work grows with the items, not with their pairs.
    """
    path = F.substring_index("key", "#", 1)
    one = F.struct("node", "key", path.alias("path"))
    items = fields.groupBy("page_id", "label", "parent", "item").agg(F.array_sort(F.collect_list(one)).alias("own"))
    seeds = items.groupBy("page_id", "label").agg(F.max_by(
        F.transform("own", lambda f: F.struct(f["key"].alias("key"), f["path"].alias("path"))), F.struct(F.size("own"), -F.col("parent"), -F.col("item"))).alias("seed"))
    ship(fields.sparkSession)

    @F.pandas_udf("array<int>")
    def partners(own: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([pair_sequences(list(a), list(b)) for a, b in zip(own, seed)])

    joined = items.join(seeds, ["page_id", "label"]).withColumn("to", partners(F.transform("own", lambda f: f["path"]), F.transform("seed", lambda f: f["path"])))
    each = joined.select("page_id", "label", "parent", "item", "seed", F.inline(F.arrays_zip("own", "to")))
    return each.select("page_id", "label", "parent", "item", "own.node", "own.key", F.when(F.col("to") >= 0, F.get("seed", F.col("to"))["key"]).alias("seed_key"))


def match_sequences(fields: DataFrame, share: float = 0.5) -> DataFrame:
    """(page_id, label, key, present, items): fields of the seed that have a partner in at least ``share`` of the items."""
    pairs = matched_fields(fields)
    items = pairs.groupBy("page_id", "label").agg(F.countDistinct("parent", "item").alias("items"))
    found = pairs.filter("seed_key is not null").groupBy("page_id", "label", F.col("seed_key").alias("key")).agg(F.count("*").alias("present"))
    return found.join(items, ["page_id", "label"]).filter(F.col("present") >= share * F.col("items")).select("page_id", "label", "key", "present", "items")


def seed_alignment(fields: DataFrame) -> DataFrame:
    """(page_id, label, key, place, in_seed): union of all columns, ordered by their mean
    relative position in the items; the seed is the item with most fields."""
    item = Window.partitionBy("page_id", "label", "parent", "item")
    placed = fields.withColumn("at", (F.row_number().over(item.orderBy("node")) - 1) / F.count("*").over(item)).withColumn("width", F.count("*").over(item))
    whole = Window.partitionBy("page_id", "label")
    best = F.max(F.struct(F.col("width"), -F.col("parent"), -F.col("item"))).over(whole)
    marked = placed.withColumn("in_seed", F.struct(F.col("width"), -F.col("parent"), -F.col("item")) == best)
    columns = marked.groupBy("page_id", "label", "key").agg(F.avg("at").alias("at"), F.bool_or("in_seed").alias("in_seed"))
    return columns.withColumn("place", (F.row_number().over(whole.orderBy("at", "key")) - 1).cast("bigint")).select("page_id", "label", "key", "place", "in_seed")


def records_to_json(fields: DataFrame) -> DataFrame:
    """(page_id, label, parent, item, record): every item as an object of its columns."""
    cells = F.array_sort(F.collect_list(F.struct("column", "key", "value")))
    grouped = fields.groupBy("page_id", "label", "parent", "item").agg(cells.alias("cells"))
    return grouped.select("page_id", "label", "parent", "item", F.to_json(F.map_from_entries(
        F.transform("cells", lambda c: F.struct(c["key"], c["value"])))).alias("record"))


def common_prefix_suffix(items: DataFrame, rows: DataFrame) -> DataFrame:
    """(page_id, label, prefix, suffix): tags all items of a label begin and end with.

    The tag sequences of a label share what their smallest and largest share.
    """
    inside = rows.select("page_id", "node", "tag", F.explode("path").alias("root"))
    tags = items.select("page_id", "label", "parent", "item", F.col("node").alias("root")).join(inside, ["page_id", "root"])
    sequence = F.transform(F.array_sort(F.collect_list(F.struct("node", "tag"))), lambda x: x["tag"])
    per_item = tags.groupBy("page_id", "label", "parent", "item").agg(sequence.alias("seq"))
    ends = per_item.withColumn("back", F.reverse("seq")).groupBy("page_id", "label").agg(
        F.min("seq").alias("a"), F.max("seq").alias("b"), F.min("back").alias("c"), F.max("back").alias("d"))
    return ends.select("page_id", "label", shared_prefix(F.col("a"), F.col("b")).alias("prefix"),
                       F.reverse(shared_prefix(F.col("c"), F.col("d"))).alias("suffix"))


def item_field_count_filter(schema: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """(page_id, label) of item types with an acceptable number of columns; without ``most`` no number is too large."""
    return schema.groupBy("page_id", "label").agg(F.count("*").alias("fields")).filter((F.col("fields") >= least) & (F.lit(True) if most is None else F.col("fields") <= most))
