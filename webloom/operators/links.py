"""Links between pages: extraction, link graph, crawl depth and set operations on URLs."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.functions.vectors import bind
from webloom.session import checkpoint

#: The attributes of a tag: quoted values may hold ``>``. All repetitions are possessive, so no text makes them backtrack.
TAG = r"(?i)<{}(?=[\s/])((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++"
#: The first attribute of that very name; its value is double-quoted, single-quoted, bare or missing.
HREF = (r"(?i)^[\s/]*+(?:(?!href(?:[\s=/]|$))[^\s=/]++(?:\s*+=\s*+(?:" + VALUE + r"))?+[\s/]*+)*+"
        r"href(?=[\s=/]|$)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
SCRIPT_OR_COMMENT = r"(?is)<script\b.*?</script>|<!--.*?-->"


def href_of(attributes: Column) -> Column:
    """Value of ``href`` among a tag's attributes; NULL without one."""
    value = F.concat(*[F.regexp_extract(attributes, HREF, k) for k in (1, 2, 3)])
    return F.when(attributes.rlike(HREF), unescape(value))


def found_links() -> Column:
    """The page's links as an array of (href, link). The page is searched once for its links
    and once for its base; both results are bound before the links are resolved."""
    def resolved(body: Column) -> Column:
        tags = F.regexp_extract_all(body, F.lit(TAG.format("a")), F.lit(1))
        hrefs = F.filter(F.transform(tags, href_of), lambda h: h.isNotNull())
        root = U.site_root(F.col("url"))
        base = F.coalesce(href_of(F.regexp_extract(body, TAG.format("base"), 1)), F.lit(""))
        page = F.struct(root.alias("root"), U.link_base(root, base).alias("base"))
        return bind(page, lambda p: F.transform(hrefs, lambda h: F.struct(h.alias("href"), U.absolute(p["root"], p["base"], h).alias("link"))))

    return bind(F.regexp_replace("html", SCRIPT_OR_COMMENT, ""), resolved)


def raw_links(pages: DataFrame) -> DataFrame:
    """Every ``a[href]`` of every page: page_id, url, pos, href and its absolute form."""
    return pages.select("page_id", "url", F.posexplode(found_links()).alias("pos", "l")).select("page_id", "url", "pos", "l.href", "l.link")


def resolved_links() -> Column:
    """The page's links in absolute form, as an array."""
    return F.transform(found_links(), lambda x: x["link"])


def internal_links(pages: DataFrame) -> Column:
    """The page's links to its own host, as an array."""
    return bind(U.authority(F.col("url")), lambda own: F.filter(resolved_links(), lambda link: U.authority(link) == own))


NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def unescape(text: Column) -> Column:
    """Named, decimal and hexadecimal entities as characters; texts without an ampersand pass at once."""
    names = F.create_map(*[F.lit(x) for item in NAMED.items() for x in item])

    def piece(part: Column) -> Column:
        code = F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.substring(part, F.length(code) + 2, F.length(part))
        number = F.when(code.rlike("^#[xX]"), F.conv(F.substring(code, F.lit(3), F.lit(6)), 16, 10)).otherwise(F.substring(code, F.lit(2), F.lit(7))).cast("bigint")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number)), 8, "0")), "UTF-32")
        found = F.when(code.startswith("#"), char).when(code != "", F.element_at(names, code))
        return F.when(found.isNotNull(), F.concat(found, rest)).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&", -1)
    decoded = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(piece(part)))
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


def page_links(pages: DataFrame) -> DataFrame:
    """Resolved links that stay on the page's host."""
    return raw_links(pages).filter(U.authority(F.col("link")) == U.authority(F.col("url")))


def external_links(pages: DataFrame) -> DataFrame:
    """Absolute links to another registered domain."""
    return raw_links(pages).filter(
        F.col("href").startswith("http") & (U.registered_domain(F.col("link")) != U.registered_domain(F.col("url"))))


def skip_script_links(pages: DataFrame) -> DataFrame:
    return raw_links(pages).filter(~F.lower("href").startswith("javascript:"))


def same_site_links(pages: DataFrame, limit: int = 5) -> DataFrame:
    """Per page the root of its site, then distinct links below that root, ``limit`` in all."""
    root = U.site_root(F.col("url"))
    inside = F.filter(resolved_links(), lambda link: F.contains(link, root))
    chosen = F.slice(F.array_distinct(F.concat(F.array(root), inside)), 1, limit)
    return pages.select("page_id", F.posexplode(chosen).alias("pos", "link")).select("page_id", "link", (F.col("pos") + 1).alias("rank"))


def link_graph(pages: DataFrame) -> DataFrame:
    """Per URL, fetched or only linked: in-degree, out-degree and whether it was fetched.

    A page speaks for itself (fetched, number of links) and for its targets (one link each)
    in the same pass, so pages are read once and one shuffle by URL adds everything up. It
    is summed on the map side first: a URL most pages link to costs one row per task.
    """
    fact = lambda url, fetched, into, out: F.struct(
        url.alias("url"), F.lit(fetched).alias("fetched"), F.lit(into).alias("into"), out.cast("bigint").alias("out"))
    links = pages.select("url", internal_links(pages).alias("links"))
    facts = F.concat(F.array(fact(F.col("url"), 1, 0, F.size("links"))),
                     F.transform("links", lambda link: fact(link, 0, 1, F.lit(0))))
    return links.select(F.inline(facts)).groupBy("url").agg(
        (F.max("fetched") == 1).alias("fetched"), F.sum("into").alias("in_degree"), F.sum("out").alias("out_degree"))


def broken_links(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Linked URLs that were never fetched or answered with status 400 and up, with the links to them.

    URLs meet in canonical form, so ``HTTP://H:80/a#x`` and ``http://h/a`` are one. ``answers``
    holds url and status; a URL counts as broken if its worst answer is, or if it has none.
    """
    normal = lambda c: U.canonical(F.col(c)).alias("link")
    links = pages.select(F.explode(internal_links(pages)).alias("to")).select(normal("to")).groupBy("link").agg(F.count("*").alias("in_degree"))
    known = answers.select(normal("url"), "status").groupBy("link").agg(F.max("status").alias("status"))
    return links.join(known, "link", "left").filter("status is null or status >= 400").select("link", "in_degree", "status")


def new_urls(found: DataFrame, visited: DataFrame, url: str = "url") -> DataFrame:
    """Distinct found URLs that are not visited yet."""
    return found.select(url).distinct().join(visited.select(url).distinct(), url, "left_anti")


def crawl_depth(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Breadth-first depth of every URL reached from the seeds, each visited once.

    ``edges`` holds url -> link. Only the newest layer is joined per round, and every
    layer is written to the shared folder, so a lost executor does not replay the rounds.
    """
    edges = checkpoint(edges.select("url", "link").distinct())
    layer = checkpoint(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    reached = layer
    for depth in range(1, max_depth + 1):
        following = layer.join(edges, "url").select(F.col("link").alias("url"))
        layer = checkpoint(new_urls(following, reached).withColumn("depth", F.lit(depth)))
        if layer.isEmpty():
            break
        reached = reached.unionByName(layer)
    return reached


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs on exactly one side, marked with the side; duplicates stay."""
    only_left = left.join(right.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    only_right = right.join(left.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def site_dimension(pages: DataFrame) -> DataFrame:
    """One row per registered domain with its hosts and pages counted."""
    return pages.withColumn("domain", U.registered_domain(F.col("url"))).groupBy("domain").agg(
        F.count("*").alias("pages"), F.countDistinct(U.hostname(F.col("url"))).alias("hosts"))


def upsert_dimension(dimension: DataFrame, incoming: DataFrame, name: str) -> DataFrame:
    """Dimension plus the incoming names it lacks, compared without case; a name that is null or blank is an error."""
    blank = F.coalesce(F.trim(F.col(name)), F.lit("")) == ""
    key = F.when(blank, F.raise_error(F.lit(f"a row has no {name}"))).otherwise(F.lower(F.trim(F.col(name))))
    fresh = (
        incoming.withColumn("_key", key)
        .groupBy("_key").agg(F.min(name).alias(name))
        .join(dimension.select(key.alias("_key")), "_key", "left_anti").drop("_key"))
    return dimension.select(name).unionByName(fresh)
