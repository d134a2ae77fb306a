"""Pages as trees of nodes.

``page_nodes`` is the one place where HTML is read, a page at a time in Arrow batches.
Its result keeps one row per page with the nodes as an array in document order. A
subtree is a slice of that array, so selection and extraction are array expressions
and need no shuffle. ``node_rows`` turns the array into a relational table.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEXT = "[T]"
BACKTRACK = 20
NODE = ("struct<node: int, end_node: int, parent: int, depth: int, child_ix: int, tag: string, classes: array<string>, "
        "attrs: map<string, string>, text: string, inner_from: int, inner_to: int, path: array<int>, tag_path: string, "
        "element_ix: int, n_elements: int, tag_ix: int, n_same_tag: int>")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?")
_RAW = ("script", "style")


def parse_page(body: str) -> list[dict]:
    """Nodes of one page. A closing tag ends the nearest open tag of its name among the last
    twenty; tags that are never closed have no descendants; blank text is no node."""
    nodes, at, size = [], 0, len(body)
    chain: list[int] = []  # elements still open, outermost first
    depths: dict[str, list[int]] = {}  # where the open elements of a name stand in the chain
    while at < size:
        token = _TOKEN.match(body, at)
        at, name = token.end(), token.group(2)
        if name is None:
            text = token.group()
            if not text.startswith(("<!", "<?")) and text.strip():
                nodes.append({"tag": TEXT, "attrs": [], "classes": [], "text": entities.unescape(text), "span": (token.start(), at)})
            continue
        name = name.lower()
        if token.group(1):
            own = depths.get(name)
            if own and len(chain) - own[-1] <= BACKTRACK:
                depth = own[-1]
                ended = nodes[chain[depth]]
                ended.update(end=len(nodes), span=(ended["span"][0], token.start()))
                for left in chain[depth:]:
                    depths[nodes[left]["tag"]].pop()
                chain = chain[:depth]
            continue
        attributes = {}
        for found in _ATTRIBUTE.finditer(token.group(3)):
            attributes.setdefault(found.group(1).lower(), entities.unescape((found.group(2) or "").strip("\"'")))
        nodes.append({"tag": name, "attrs": list(attributes.items()), "classes": sorted(set(attributes.get("class", "").split())),
                      "text": None, "span": (at, at)})
        if not token.group(3).rstrip().endswith("/"):
            depths.setdefault(name, []).append(len(chain))
            chain.append(len(nodes) - 1)
            if name in _RAW:
                closing = re.compile(f"</{name}", re.I).search(body, at)
                at = closing.start() if closing else size
    open_nodes, children, elements = [], {}, {}
    for i, node in enumerate(nodes):
        while open_nodes and nodes[open_nodes[-1]]["end_node"] <= i:
            open_nodes.pop()
        parent = open_nodes[-1] if open_nodes else -1
        up = nodes[parent] if open_nodes else {"path": [], "tag_path": ""}
        node.update(node=i, end_node=max(i + 1, node.get("end", i)), parent=parent, depth=len(open_nodes), child_ix=children.get(parent, 0),
                    inner_from=node["span"][0], inner_to=node["span"][1], path=up["path"] + [i], tag_path=f"{up['tag_path']}/{node['tag']}")
        children[parent] = children.get(parent, 0) + 1
        if node["tag"] != TEXT:
            for kind, among in (("element_ix", (parent, "*")), ("tag_ix", (parent, node["tag"]))):
                node[kind] = elements.get(among, 0)
                elements[among] = node[kind] + 1
        if node["end_node"] > i + 1:
            open_nodes.append(i)
    for node in nodes:
        node["n_elements"], node["n_same_tag"] = (elements.get((node["parent"], name)) for name in ("*", node["tag"]))
    return nodes


_FIELDS = ("node", "end_node", "parent", "depth", "child_ix", "tag", "classes", "attrs", "text", "inner_from", "inner_to", "path", "tag_path",
           "element_ix", "n_elements", "tag_ix", "n_same_tag")
_INTS = {"node", "end_node", "parent", "depth", "child_ix", "inner_from", "inner_to", "element_ix", "n_elements", "tag_ix", "n_same_tag"}
#: Characters of HTML whose nodes a worker holds at a time, but for a single larger page.
_HELD = 1 << 20
_TYPES = {"classes": pa.list_(pa.string()), "attrs": pa.map_(pa.string(), pa.string()), "path": pa.list_(pa.int32())}
_STRUCT = pa.struct([(f, pa.int32() if f in _INTS else _TYPES.get(f, pa.string())) for f in _FIELDS])


def page_nodes(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``html`` and ``nodes``. Filter the pages before, not after."""
    selected = pages.select(*keep, "html")

    def read(batches):
        for batch in batches:
            start, held, parsed = 0, 0, []
            for row in range(batch.num_rows):
                body = batch.column("html")[row].as_py() or ""
                parsed.append([{f: n.get(f) for f in _FIELDS} for n in parse_page(body)])
                held += len(body)
                if held >= _HELD or row == batch.num_rows - 1:
                    part = batch.slice(start, row + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(parsed, pa.list_(_STRUCT))], [*part.schema.names, "nodes"])
                    start, held, parsed = row + 1, 0, []

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in selected.schema) + f", nodes array<{NODE}>"
    return selected.mapInArrow(read, schema)


def node_rows(trees: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    return trees.select(*keep, F.inline("nodes"))


def subtree(nodes: Column, node: Column, end_node: Column) -> Column:
    return F.slice(nodes, node + 1, end_node - node)


def text_of(nodes: Column, node: Column, end_node: Column) -> Column:
    """All text below a node, in document order."""
    return F.array_join(F.transform(F.filter(subtree(nodes, node, end_node), lambda n: n["tag"] == TEXT), lambda n: n["text"]), "")


def subtree_size(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "node", (F.col("end_node") - F.col("node")).alias("size"))


def child_counts(trees: DataFrame) -> DataFrame:
    """Ordinal among the siblings and number of children of every node."""
    counted = F.transform("nodes", lambda n: F.struct(
        n["node"].alias("node"), n["child_ix"].alias("child_ix"),
        F.size(F.filter(subtree(F.col("nodes"), n["node"], n["end_node"]), lambda c: c["parent"] == n["node"])).alias("n_children")))
    return trees.select("page_id", F.inline(counted))


def depth_path(rows: DataFrame) -> DataFrame:
    """Nodes from each node up to its root."""
    return rows.select("page_id", "node", F.reverse("path").alias("path"))


def ancestor_join(rows: DataFrame) -> DataFrame:
    """(page_id, ancestor, node): the path of a node lists its ancestors, so no range join."""
    above = F.slice("path", 1, F.col("depth"))
    return rows.select("page_id", F.explode(above).alias("ancestor"), "node")


def sibling_join(rows: DataFrame) -> DataFrame:
    """Previous and next sibling and the number of siblings, instead of all sibling pairs."""
    family = Window.partitionBy("page_id", "parent")
    order = family.orderBy("node")
    return rows.select("page_id", "node", F.lag("node").over(order).alias("previous"), F.lead("node").over(order).alias("next"),
                       (F.count("*").over(family) - 1).alias("siblings"))


def same_tag_pairs(rows: DataFrame) -> DataFrame:
    """Number of node pairs (a <= b) with equal tags, counted without building them."""
    n = F.count("*")
    return rows.groupBy("page_id", "tag").agg((n * (n + 1) / 2).cast("bigint").alias("pairs"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Shared beginning of two paths."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    other = F.array_position(same, False).cast("int")
    return F.slice(a, 1, F.when(other == 0, F.size(a)).otherwise(other - 1))


def tree_distance(a: Column, b: Column) -> Column:
    """Hops between two nodes given their paths; separate trees hang from the page itself."""
    return F.size(a) + F.size(b) - 2 * F.size(shared_prefix(a, b))


def common_ancestor(rows: DataFrame, by: list[str]) -> DataFrame:
    """Deepest node containing all rows of a group, -1 when there is none.

    Smallest and largest path of a group share exactly what all its paths share.
    """
    ends = rows.groupBy(*by).agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count("*").alias("members"))
    shared = shared_prefix(F.col("low"), F.col("high"))
    return ends.select(*by, F.coalesce(F.try_element_at(shared, F.lit(-1)), F.lit(-1)).alias("node"), "members")


def interesting_nodes(rows: DataFrame) -> DataFrame:
    """Text, link and image nodes."""
    return rows.filter(F.col("tag").isin("a", "img", TEXT))


def page_meta(trees: DataFrame) -> DataFrame:
    """Title, description, keywords, canonical link, OpenGraph fields, first image and the body
    text taken from the element with most text in its paragraphs."""
    nodes = F.col("nodes")
    named = lambda tag: F.filter(nodes, lambda n: n["tag"] == tag)
    attr = lambda n, name: F.try_element_at(n["attrs"], F.lit(name))
    first = lambda found, value: F.get(F.transform(F.slice(found, 1, 1), value), 0)
    meta = lambda key, name: first(F.filter(named("meta"), lambda n: F.lower(attr(n, key)) == name), lambda n: attr(n, "content"))
    texts = F.filter(nodes, lambda n: (n["tag"] == TEXT) & n["tag_path"].contains("/p/"))
    density = F.transform(named("article"), lambda n: F.struct(
        F.length(text_of(nodes, n["node"], n["end_node"])).alias("size"), n["node"].alias("node"), n["end_node"].alias("end_node")))
    best = F.array_max(density)
    plain = F.array_join(F.transform(texts, lambda n: n["text"]), "")
    return trees.select(
        "page_id",
        first(named("title"), lambda n: text_of(nodes, n["node"], n["end_node"])).alias("title"),
        meta("name", "description").alias("description"), meta("name", "keywords").alias("keywords"),
        first(F.filter(named("link"), lambda n: attr(n, "rel") == "canonical"), lambda n: attr(n, "href")).alias("canonical"),
        meta("property", "og:title").alias("og_title"), meta("property", "og:image").alias("og_image"),
        first(named("img"), lambda n: attr(n, "src")).alias("image"),
        F.when(best["size"] > 0, text_of(nodes, best["node"], best["end_node"])).otherwise(plain).alias("body"))


def candidate_regions(rows: DataFrame) -> DataFrame:
    """Regions that may hold records: parents of text are grouped by path without positions,
    every group votes for its deepest common ancestor, ancestors need two children."""
    parents = rows.filter(F.col("tag") == TEXT).select("page_id", F.col("parent").alias("node")).distinct()
    shaped = rows.select("page_id", "node", "tag_path", "path").join(parents, ["page_id", "node"], "left_semi")
    shared = common_ancestor(shaped, ["page_id", "tag_path"])
    votes = shared.filter("node >= 0").groupBy("page_id", "node").agg(F.count("*").alias("votes"))
    wide = rows.filter(F.col("tag") != TEXT).groupBy("page_id", F.col("parent").alias("node")).agg(F.count("*").alias("n")).filter("n >= 2")
    return votes.join(wide, ["page_id", "node"], "left_semi")


def records_per_candidate(rows: DataFrame) -> DataFrame:
    """Texts per region path over all pages, combined per page first."""
    shared = common_ancestor(rows.filter(F.col("tag") == TEXT), ["page_id", "tag_path"])
    return shared.groupBy("tag_path").agg(F.count("*").alias("pages"), F.sum("members").alias("texts"))


def sanitize_html(trees: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """HTML rebuilt from allow-listed tags and attributes; text of other tags stays."""
    tags = list(allowed)
    names = F.create_map(*[x for tag in tags for x in (F.lit(tag), F.array(*[F.lit(a) for a in allowed[tag]]).cast("array<string>"))])
    escape = lambda s: F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&#34;"))
    shown = lambda n: F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter(
        n["attrs"], lambda k, v: F.array_contains(F.try_element_at(names, n["tag"]), k)))), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), "")
    kept = F.filter("nodes", lambda n: n["tag"].isin(TEXT, *tags))
    # Opening and closing marks in document order: closings of inner nodes come first.
    opening = F.transform(kept, lambda n: F.struct(n["node"].alias("at"), F.lit(1).alias("kind"), n["node"].alias("tie"), F.when(
        n["tag"] == TEXT, escape(n["text"])).otherwise(F.concat(F.lit("<"), n["tag"], shown(n), F.lit(">"))).alias("mark")))
    closing = F.transform(F.filter(kept, lambda n: n["end_node"] > n["node"] + 1), lambda n: F.struct(
        n["end_node"].alias("at"), F.lit(0).alias("kind"), (-n["node"]).alias("tie"), F.concat(F.lit("</"), n["tag"], F.lit(">")).alias("mark")))
    marks = F.array_sort(F.concat(opening, closing))
    return trees.select("page_id", F.array_join(F.transform(marks, lambda m: m["mark"]), "").alias("clean"))
