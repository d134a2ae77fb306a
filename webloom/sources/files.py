"""Readers and writers for the file formats pages and training data arrive in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_type(body: Column, header: Column | None = None) -> Column:
    """The header's content type, else a guess from the first characters of the body."""
    sniffed = (
        F.when(body.rlike(r"(?i)\A\s*(?:<!--.*?-->\s*)?(?:<!doctype html|<html|<head|<body)"), "text/html")
        .when(body.rlike(r"(?i)\A\s*<\?xml"), "text/xml")
        .otherwise("text/plain"))
    return sniffed if header is None else F.coalesce(F.nullif(header, F.lit("")), sniffed)


def keyword_dictionary(pairs: DataFrame) -> DataFrame:
    """(keyword, category), lower-cased; every category is a keyword of itself."""
    low = pairs.select(F.lower("keyword").alias("keyword"), F.lower("category").alias("category"))
    own = low.select(F.col("category").alias("keyword"), "category")
    return low.unionByName(own).groupBy("keyword").agg(F.min("category").alias("category"))


def scan_csv(spark: SparkSession, path: str, sep: str = ",", id: str | None = None, label: str | None = None,
             ignore: tuple[str, ...] = (), schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header row. Ignored columns are never parsed; id and label must exist."""
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    df = df.toDF(*[c.strip().rstrip("\r") for c in df.columns])
    for name in (id, label):
        if name and name not in df.columns:
            raise ValueError(f"no column {name} in the header")
    return df.drop(*ignore)


def scan_csv_numeric(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns but ``keep`` as numbers; empty cells stay empty, other text is an error."""
    names = [c for c in df.columns if c not in keep]
    bad = lambda c: F.count_if((F.trim(c) != "") & F.trim(c).try_cast("double").isNull())
    wrong = df.agg(*[bad(F.col(c)).alias(c) for c in names]).first().asDict()
    for name, count in wrong.items():
        if count:
            raise ValueError(f"column {name} holds {count} cells that are no number")
    return df.select(*[F.trim(c).try_cast("double").alias(c) if c in names else c for c in df.columns])


def scan_seed_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``|``-separated site list with ``#`` comment lines."""
    return spark.read.schema(schema).option("sep", "|").option("comment", "#").option("mode", "PERMISSIVE").csv(path)


def scan_libsvm(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """``label idx:val ...`` lines as (line, label, feature, value); unknown features are left out."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("parts"), F.monotonically_increasing_id().alias("line"))
    checked = lines.select("line", F.when(F.size("parts") > 1, F.col("parts")).otherwise(
        F.raise_error(F.lit("empty row"))).alias("parts"))
    cells = checked.select("line", F.get("parts", 0).cast("double").alias("label"),
                           F.explode(F.slice("parts", F.lit(2), F.size("parts"))).alias("cell"))
    pair = F.split("cell", ":")
    out = cells.select("line", "label", F.get(pair, 0).cast("int").alias("feature"), F.get(pair, 1).cast("double").alias("value"))
    return out if known is None else out.join(known.select("feature"), "feature", "left_semi").select(*out.columns)


def _class_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def scan_labeled_dirs(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """One folder per class, one file per document: (path, class, text)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    out = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("class", _class_of(F.col("path")))
    return out if known is None else out.join(known.select("class"), "class", "left_semi").select(*out.columns)


def scan_labeled_images(spark: SparkSession, path: str) -> DataFrame:
    """One folder per class: (path, class, size). File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", _class_of(F.col("path")).alias("class"), F.col("length").alias("size"))


def _locations(body: Column, tag: str) -> Column:
    inside = F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}>.*?<loc>\s*(.*?)\s*</loc>.*?</{tag}>"), F.lit(1))
    plain = lambda u: F.replace(F.replace(F.replace(u, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return F.transform(inside, plain)


def scan_sitemap(bodies: DataFrame) -> DataFrame:
    """(loc, body) sitemaps to page URLs; a body without ``</urlset>`` is no sitemap."""
    return bodies.filter(F.contains("body", F.lit("</urlset>"))).select(
        F.col("loc").alias("sitemap"), F.explode(_locations(F.col("body"), "url")).alias("url"))


def scan_sitemap_index(indexes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Index files to their child sitemaps to page URLs."""
    children = indexes.filter(F.contains("body", F.lit("</sitemapindex>"))).select(
        F.explode(_locations(F.col("body"), "sitemap")).alias("loc"))
    return scan_sitemap(children.join(bodies, "loc"))


def scan_sitemap_any(files: DataFrame, bodies: DataFrame) -> DataFrame:
    """URLs of files that may be an index, a sitemap or both."""
    return scan_sitemap_index(files, bodies).unionByName(scan_sitemap(files))


def scan_json(spark: SparkSession, path: str, schema: str, collection: bool = False) -> DataFrame:
    """JSON lines, or files whose top level is one array."""
    return spark.read.schema(schema).option("multiLine", collection).option("mode", "FAILFAST").json(path)


def scan_xml_map(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType) -> DataFrame:
    """XML elements as nested rows; attributes carry the prefix ``-``."""
    return (spark.read.format("xml").schema(schema).option("rowTag", row_tag)
            .option("attributePrefix", "-").option("valueTag", "#text").load(path))


def scan_feed(spark: SparkSession, path: str, fields: tuple[str, ...], row_tag: str = "item") -> DataFrame:
    """Feed items with at least one of the wanted fields; names are lower-cased."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    items = spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)
    return items.toDF(*[f.lower() for f in fields]).dropna("all")


def scan_json_lines_typed(lines: DataFrame, schema: str) -> DataFrame:
    """Typed posts; a blank unique slug is built from slug and id."""
    post = lines.select(F.from_json("value", schema).alias("p")).select("p.*")
    return post.withColumn("uniqueSlug", F.coalesce(F.nullif("uniqueSlug", F.lit("")), F.concat_ws("-", "slug", "id")))


def sink_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def sink_page_archive(pages: DataFrame, path: str) -> None:
    """Pages under md5(url): URL line, blank line, body; folders by the first two digits."""
    keyed = pages.select(F.md5("url").alias("key"), F.concat("url", F.lit("\n\n"), "html").alias("content"))
    keyed.withColumn("shard", F.substring("key", 1, 2)).repartition("shard", F.substring("key", 3, 1)).write.partitionBy("shard").parquet(path)


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.select("term", "pos").write.parquet(path)


def load_vocab(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """The stored vocabulary; an absent one is an error only when it is required."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], "term string, pos bigint")


def cached_result(requests: DataFrame, cache: DataFrame, now: Column, ttl_us: int, compute) -> DataFrame:
    """(key, made_at, result): stored results younger than the TTL, the others computed anew."""
    fresh = cache.filter(F.col("made_at") > now - ttl_us).join(requests.select("key").distinct(), "key", "left_semi")
    stale = requests.select("key").distinct().join(fresh, "key", "left_anti")
    return fresh.select("key", "made_at", "result").unionByName(compute(stale).select("key", now.alias("made_at"), "result"))


def dedup_append(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Stored rows plus one row per unseen key of the batch."""
    return store.unionByName(batch.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))
