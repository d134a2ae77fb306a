"""Sources and sinks. Each query stages a table as files of the format and reads them back."""

import uuid

from pyspark.sql import functions as F

from webloom.functions import jsonpath as J
from webloom.operators import terms as W
from webloom.operators.jsonblock import json_block, leaf_paths
from webloom.plans.registry import query
from webloom.plans.search_plans import BAG, VOCAB, words
from webloom.session import shared_dir
from webloom.sources import files as S
from webloom.sources.archives import scan_warc as scan_warc_files


def stage(t) -> str:
    return f"{shared_dir(t.spark).rstrip('/')}/stage-{uuid.uuid4().hex}"


@query("scan_pages", "select page_id, 'text/html' as content_type, length(html) as size from pages")
def scan_pages(t):
    return t.pages.select("page_id", S.content_type(F.col("html")).alias("content_type"), F.length("html").cast("bigint").alias("size"))


@query("scan_csv", "select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey from customer")
def scan_csv(t):
    path = stage(t)
    S.sink_csv(t.customer, path)
    return S.scan_csv(t.spark, path, id="c_custkey", label="c_nationkey", ignore=("c_acctbal", "c_mktsegment"))


@query("scan_csv_numeric", "select c_name, c_custkey::double as c_custkey, c_nationkey::double as c_nationkey, c_acctbal from customer")
def scan_csv_numeric(t):
    path = stage(t)
    S.sink_csv(t.customer, path)
    return S.scan_csv_numeric(S.scan_csv(t.spark, path, ignore=("c_mktsegment",)), keep=("c_name",))


@query("scan_seed_list", "select page_id, url from pages where page_id % 3 <> 0")
def scan_seed_list(t):
    path = stage(t)
    line = F.concat(F.when(F.col("page_id") % 3 == 0, "# ").otherwise(""), F.concat_ws("|", "page_id", "url"))
    t.pages.select(line.alias("value")).write.text(path)
    return S.scan_seed_list(t.spark, path, "page_id bigint, url string")


@query("scan_libsvm", """select l_orderkey % 7 + 0.0::double as label, count(*) as n, sum(l_quantity) as value from lineitem
  where l_linenumber in (1, 2, 3) group by all""")
def scan_libsvm(t):
    path = stage(t)
    label = (F.col("l_orderkey") % 7).cast("string")
    line = F.concat_ws(" ", label, F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_quantity").cast("string")))
    t.lineitem.select(line.alias("value")).write.text(path)
    known = t.lineitem.filter("l_linenumber <= 3").select(F.col("l_linenumber").alias("feature")).distinct()
    return S.scan_libsvm(t.spark, path, known).groupBy("label").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def benchmark_files(t):
    path = stage(t)
    (t.benchmark.select(F.concat(F.lit("class"), F.col("item_id") % 3).alias("class"), "text")
     .write.option("maxRecordsPerFile", 1).partitionBy("class").text(path))
    return path


@query("scan_labeled_dirs", "select 'class=class' || item_id % 3 as class, md5(text || chr(10)) as digest from benchmark where item_id % 3 <> 2")
def scan_labeled_dirs(t):
    known = t.benchmark.filter("item_id % 3 <> 2").select(F.concat(F.lit("class=class"), F.col("item_id") % 3).alias("class")).distinct()
    return S.scan_labeled_dirs(t.spark, benchmark_files(t), known).select("class", F.md5("text").alias("digest"))


@query("scan_labeled_images", "select 'class=class' || item_id % 3 as class, strlen(text) + 1 as size from benchmark")
def scan_labeled_images(t):
    return S.scan_labeled_images(t.spark, benchmark_files(t)).select("class", "size")


def sitemaps(t):
    """Sitemap files of fifty pages each, and index files of ten sitemaps each."""
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    part = F.floor(F.col("page_id") / 50)
    bodies = (
        t.pages.groupBy(part.alias("part")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
        .select(F.concat(F.lit("http://maps.example.com/"), "part").alias("loc"), "part",
                F.concat(F.lit('<?xml version="1.0"?><urlset>'), "body", F.when(F.col("part") == 3, "").otherwise("</urlset>")).alias("body")))
    child = F.concat(F.lit("<sitemap><loc>"), "loc", F.lit("</loc></sitemap>"))
    indexes = (
        bodies.filter("part <> 1").groupBy(F.floor(F.col("part") / 10).alias("group")).agg(F.array_join(F.collect_list(child), "").alias("body"))
        .select(F.concat(F.lit("http://maps.example.com/index/"), "group").alias("loc"),
                F.concat(F.lit("<sitemapindex>"), "body", F.lit("</sitemapindex>")).alias("body")))
    return indexes, bodies.select("loc", "body")


@query("scan_sitemap", "select 'http://maps.example.com/' || page_id // 50 as sitemap, url from pages where page_id // 50 <> 3")
def scan_sitemap(t):
    return S.scan_sitemap(sitemaps(t)[1])


@query("scan_sitemap_index", "select 'http://maps.example.com/' || page_id // 50 as sitemap, url from pages where page_id // 50 not in (1, 3)")
def scan_sitemap_index(t):
    return S.scan_sitemap_index(*sitemaps(t))


@query("scan_sitemap_any", """select 'http://maps.example.com/' || page_id // 50 as sitemap, url from pages where page_id // 50 not in (1, 3)
  union all select 'http://maps.example.com/' || page_id // 50 as sitemap, url from pages where page_id // 50 <> 3""")
def scan_sitemap_any(t):
    indexes, bodies = sitemaps(t)
    return S.scan_sitemap_any(indexes.unionByName(bodies), bodies)


@query("sitemap_child_join", "select 'http://maps.example.com/' || page_id // 50 as loc, count(*) as urls from pages where page_id // 50 not in (1, 3) group by all")
def sitemap_child_join(t):
    return S.scan_sitemap_index(*sitemaps(t)).groupBy(F.col("sitemap").alias("loc")).agg(F.count("*").alias("urls"))


ORDER = "o_orderkey bigint, o_orderstatus string, o_totalprice double"


@query("scan_json", "select o_orderkey, o_orderstatus, o_totalprice from orders union all select p_partkey, p_brand, p_retailprice from part")
def scan_json(t):
    """JSON lines from orders, and files holding one array each from part."""
    lines, arrays = stage(t), stage(t)
    S.sink_json(t.orders, lines)
    as_order = F.to_json(F.struct(F.col("p_partkey").alias("o_orderkey"), F.col("p_brand").alias("o_orderstatus"), F.col("p_retailprice").alias("o_totalprice")))
    chunk = t.part.groupBy(F.floor(F.col("p_partkey") / 500).alias("chunk")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(as_order), ","), F.lit("]")).alias("value"))
    chunk.select("value").write.option("maxRecordsPerFile", 1).text(arrays)
    return S.scan_json(t.spark, lines, ORDER).unionByName(S.scan_json(t.spark, arrays, ORDER, collection=True))


@query("scan_xml_map", 'select s_suppkey as id, s_name as name, s_acctbal as acctbal from supplier')
def scan_xml_map(t):
    path = stage(t)
    nested = F.struct(F.col("s_name").alias("-name"), F.col("s_acctbal").alias("balance"))
    (t.supplier.select(F.col("s_suppkey").alias("-id"), nested.alias("entry")).write.format("xml")
     .option("rowTag", "supplier").option("rootTag", "suppliers").option("attributePrefix", "-").save(path))
    read = S.scan_xml_map(t.spark, path, "supplier", "`-id` bigint, entry struct<`-name`: string, balance: double>")
    return read.select(F.col("`-id`").alias("id"), F.col("entry.`-name`").alias("name"), F.col("entry.balance").alias("acctbal"))


FEED_SQL = r"select case when page_id % 4 <> 0 then regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) end as title, case when page_id % 6 <> 0 then url end as link from pages where page_id % 12 <> 0"


def feed(t):
    path = stage(t)
    items = t.pages.select(
        F.when(F.col("page_id") % 4 != 0, F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)).alias("Title"),
        F.when(F.col("page_id") % 6 != 0, F.col("url")).alias("Link"), F.col("page_id").alias("guid"))
    items.write.format("xml").option("rowTag", "item").option("rootTag", "rss").save(path)
    return path


@query("scan_feed", FEED_SQL)
def scan_feed(t):
    return S.scan_feed(t.spark, feed(t), ("Title", "Link"))


@query("feed_block", "select * from (" + FEED_SQL + ") where link is not null")
def feed_block(t):
    return S.scan_feed(t.spark, feed(t), ("Title", "Link")).filter("link is not null")


@query("scan_warc", """select url, case when page_id % 2 = 0 then 'response' else 'resource' end as type, page_id % 3 as kind,
  case when page_id % 3 = 0 then md5(html) when page_id % 3 = 1 then md5('WARC/1.0' || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) || 'WARC/1.1' || chr(13) || chr(10) || html)
  else md5(unhex(hex(encode(html)) || 'FF00FE')) end as digest, true as complete from pages""")
def scan_warc(t):
    """Both versions in one archive; bodies with a record separator inside and bodies that are no UTF-8."""
    path = stage(t)
    kind = F.when(F.col("page_id") % 2 == 0, "response").otherwise("resource")
    nested = F.concat(F.lit("WARC/1.0\r\n\r\n"), "html", F.lit("\r\n\r\nWARC/1.1\r\n"), "html")
    body = F.when(F.col("page_id") % 3 == 0, F.col("html").cast("binary")).when(F.col("page_id") % 3 == 1, nested.cast("binary")).otherwise(
        F.concat(F.col("html").cast("binary"), F.unhex(F.lit("FF00FE"))))
    head = F.concat(F.lit("WARC/1."), F.when(F.col("page_id") % 2 == 0, "0").otherwise("1"), F.lit("\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Target-URI: "), "url",
                    F.lit("\r\nX-Kind: "), F.col("page_id") % 3, F.lit("\r\ncontent-length: "), F.octet_length(body), F.lit("\r\n\r\n"))
    t.pages.select(F.concat(head.cast("binary"), body).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
    read = scan_warc_files(t.spark, path)
    header = lambda name: F.col("headers")[name]
    return read.select(header("warc-target-uri").alias("url"), header("warc-type").alias("type"), header("x-kind").cast("bigint").alias("kind"),
                       F.md5("body").alias("digest"), "complete")


@query("scan_json_lines_typed", """select cast(doc_id as varchar) as id, source as author, lang,
   case when doc_id % 3 = 0 then lang || '-' || doc_id else 'post-' || doc_id end as slug from documents""")
def scan_json_lines_typed(t):
    post = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("slug"),
                              F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("post-"), "doc_id")).alias("uniqueSlug"),
                              F.struct(F.col("source").alias("username")).alias("creator"), F.col("lang").alias("detectedLanguage")))
    schema = "id string, slug string, uniqueSlug string, creator struct<username: string>, detectedLanguage string"
    read = S.scan_json_lines_typed(t.documents.select(post.alias("value")), schema)
    return read.select("id", F.col("creator.username").alias("author"), F.col("detectedLanguage").alias("lang"), F.col("uniqueSlug").alias("slug"))


@query("sink_json", "select p_partkey, p_name, p_retailprice from part")
def sink_json(t):
    path = stage(t)
    S.sink_json(t.part, path)
    return t.spark.read.schema("p_partkey bigint, p_name string, p_retailprice double").json(path)


@query("sink_csv", "select p_partkey, p_name, p_retailprice from part")
def sink_csv(t):
    path = stage(t)
    S.sink_csv(t.part.select("p_partkey", "p_name", "p_retailprice"), path)
    return t.spark.read.option("header", True).schema("p_partkey bigint, p_name string, p_retailprice double").csv(path)


@query("sink_page_archive", "select left(md5(url), 2) as shard, md5(url) as key, md5(url || chr(10) || chr(10) || html) as digest from pages")
def sink_page_archive(t):
    path = stage(t)
    S.sink_page_archive(t.pages, path)
    read = t.spark.read.schema("key string, content string, shard string").parquet(path)
    return read.select("shard", "key", F.md5("content").alias("digest"))


@query("save_load_vocab", f"with {BAG}, {VOCAB} select term, row_number() over (order by term) - 1 as pos from vocab")
def save_load_vocab(t):
    path = stage(t)
    S.save_vocab(W.vocabulary(t.documents, words()), path)
    return S.load_vocab(t.spark, path)


@query("save_label_map", "select name, row_number() over (order by name) - 1 as index from (select distinct p_brand as name from part)")
def save_label_map(t):
    from webloom.operators.features import category_domain
    path = stage(t)
    category_domain(t.part, "p_brand").select(F.col("value").alias("name"), "index").write.parquet(path)
    return t.spark.read.parquet(path)


@query("cached_result", """with c as (select user_id as key, max(epoch_us(ts)) as made_at, arg_max(value, (epoch_us(ts), event_id)) as result from events where user_id % 3 <> 0 group by user_id),
  n as (select max(epoch_us(ts)) as now from events), f as (select c.* from c, n where made_at > now - 7200000000)
  select * from f union all select user_id, now, round(max(value), 6) from events, n where user_id not in (select key from f) group by user_id, now""")
def cached_result(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = t.events.withColumn("at", at)
    cache = events.filter("user_id % 3 <> 0").groupBy(F.col("user_id").alias("key")).agg(
        F.max("at").alias("made_at"), F.max_by("value", F.struct("at", "event_id")).alias("result"))
    now = events.select(F.max("at")).scalar()
    compute = lambda keys: keys.join(events, F.col("key") == F.col("user_id")).groupBy("key").agg(F.round(F.max("value"), 6).alias("result"))
    return S.cached_result(events.select(F.col("user_id").alias("key")), cache, now, 7_200_000_000, compute)


@query("dedup_append", """with s as (select distinct url from pages where page_id % 2 = 0) select url from pages
  union all select distinct url || 'x' from pages where page_id % 5 = 0""")
def dedup_append(t):
    store = t.pages.filter("page_id % 2 = 0").select("url")
    batch = t.pages.select("url").unionByName(t.pages.select("url")).unionByName(
        t.pages.filter("page_id % 5 = 0").select(F.concat("url", F.lit("x")).alias("url")))
    return S.dedup_append(store, batch, "url")


# ---------------------------------------------------------------- JSON documents

@query("json_kinds", """with j as (select event_id, case event_id % 5 when 0 then props when 1 then '[' || props || ',1]' when 2 then '"' || event_type || '"'
   when 3 then 'null' else '{bad' || event_id end as body from events)
 select event_id, event_id % 5 in (0, 3) as is_object, event_id % 5 in (1, 3) as is_array, event_id % 5 in (2, 3) as is_string from j""")
def json_kinds(t):
    m = F.col("event_id") % 5
    body = (F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("["), "props", F.lit(",1]"))).when(m == 2, F.concat(F.lit('"'), "event_type", F.lit('"')))
            .when(m == 3, F.lit("null")).otherwise(F.concat(F.lit("{bad"), "event_id")))
    b = t.events.select("event_id", body.alias("body"))
    return b.select("event_id", J.is_json(F.col("body")).alias("is_object"), J.is_json_array(F.col("body")).alias("is_array"), J.is_json_string(F.col("body")).alias("is_string"))


@query("unwrap_jsonp", "select event_id, props as body from events")
def unwrap_jsonp(t):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("cb("), "props", F.lit(");"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("(function(){go("), "props", F.lit(");})();"))).otherwise(F.col("props"))
    return t.events.select("event_id", wrapped.alias("w")).select("event_id", J.unwrap_jsonp(F.col("w")).alias("body"))


def order_docs(t):
    """One JSON document per part: its price twice and a list of sizes."""
    row = lambda n: F.struct((F.col("p_size") + n).alias("b"), F.col("p_brand").alias("brand"), (F.col("p_size") % (n + 2)).cast("string").alias("c"))
    doc = F.to_json(F.struct(F.array(row(0), row(1), row(2)).alias("a"), F.struct(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).alias("m")))
    return t.part.select("p_partkey", doc.alias("doc"), F.parse_json(doc).alias("v"))


@query("json_path", """select p_partkey, p_size as first_b, p_size + 2 as last_b, '[' || p_size || ',' || (p_size + 1) || ',' || (p_size + 2) || ']' as all_b,
  '[' || p_size || ',' || (p_size + 1) || ',' || (p_size + 2) || ']' as mapped, '[' || (p_size + 1) || ',' || (p_size + 2) || ']' as tail_b,
  case when p_size % 2 = 1 then p_size when p_size % 3 = 1 then p_size + 1 when p_size % 4 = 1 then p_size + 2 end as picked, p_name as name, null::varchar as absent from part""")
def json_path(t):
    get = lambda path, kind: F.try_variant_get(J.json_path(F.col("v"), path), "$", kind)
    text = lambda path: F.to_json(J.json_path(F.col("v"), path))
    return order_docs(t).select(
        "p_partkey", get("a[0].b", "int").alias("first_b"), get("a[-1].b", "int").alias("last_b"), text("a[:].b").alias("all_b"),
        text("a.b").alias("mapped"), text("a[1:].b").alias("tail_b"), get("a.(c=1)[0].b", "int").alias("picked"),
        get("m.name", "string").alias("name"), get("m.nothing", "string").alias("absent"))


@query("json_block", """select p_partkey, pos, cast(p_size + pos as int) as size, p_brand as brand, '{"brand":"' || p_brand || '","n":' || (p_size + pos) || '}' as both
   from part, (select unnest([0, 1, 2]) as pos)""")
def json_block_query(t):
    rows = json_block(order_docs(t), "v", "a", {"size": ["b"], "brand": ["brand"], "both": ["brand", "b|n"]}, keep=("p_partkey",))
    return rows.select("p_partkey", "pos", F.expr("cast(size as int)").alias("size"), F.expr("cast(brand as string)").alias("brand"),
                       F.to_json("both").alias("both"))


@query("json_condition", """select p_partkey, (p_size % 2 = 1)::int + (p_size % 3 = 1)::int + (p_size % 4 = 1)::int as hits from part""")
def json_condition(t):
    listed = F.try_variant_get(F.col("v"), "$.a", "array<variant>")
    return order_docs(t).select("p_partkey", F.size(F.filter(listed, lambda e: J.condition(e, "(c=1)"))).alias("hits"))


@query("json_query_filter", "select p_partkey, p_name, p_size from part where (p_size < 10 or (p_name like 'red%' and p_brand = 'Brand#2')) and p_retailprice = p_retailprice * 2 / 2 and regexp_matches(p_name, 'b.*')")
def json_query_filter(t):
    """Predicate text applied to typed JSON rows."""
    rows = t.part.select(F.to_json(F.struct("*")).alias("j")).select(
        F.from_json("j", "p_partkey bigint, p_name string, p_brand string, p_size int, p_retailprice double").alias("r")).select("r.*")
    return rows.filter("(p_size < 10 or (p_name like 'red%' and p_brand = 'Brand#2')) and p_retailprice = p_retailprice * 2 / 2 and p_name rlike 'b.*'").select("p_partkey", "p_name", "p_size")


@query("where_select", "select o_orderkey, o_totalprice * 2 as doubled from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def where_select(t):
    return t.orders.filter("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))


@query("leaf_paths", "select unnest(['.a[*].b', '.a[*].brand', '.a[*].c', '.m.name', '.m.price', '.k']) as path")
def leaf_paths_query(t):
    docs = order_docs(t).select("v").unionByName(t.events.select(F.parse_json("props").alias("v")))
    return leaf_paths(docs, "v")


@query("slice_range", """with l as (select doc_id, string_split(text, chr(10)) as x from documents)
  select doc_id, array_to_string(x[2:3], '|') as middle, array_to_string(case when len(x) >= 2 then x[len(x) - 1:] else x end, '|') as last_two, x[1] as head from l""")
def slice_range(t):
    lines = F.split("text", "\n")
    padded = F.when(F.size(lines) >= 4, F.array_join(J.slice_range(lines, 1, 3), "|"))
    return t.documents.select(
        "doc_id", F.array_join(F.slice(lines, 2, 2), "|").alias("middle"),
        F.array_join(F.when(F.size(lines) >= 2, J.slice_range(lines, -2, 0)).otherwise(lines), "|").alias("last_two"),
        F.get(lines, 0).alias("head"))


@query("distinct_values", "select distinct p_brand, p_type from part")
def distinct_values(t):
    return t.part.select("p_brand", "p_type").dropDuplicates()


@query("category_counts", """select cat, count(*) as n from (select unnest([lang, source, 'all']) as cat from documents) group by cat""")
def category_counts(t):
    return t.documents.select(F.explode(F.array("lang", "source", F.lit("all"))).alias("cat")).groupBy("cat").agg(F.count("*").alias("n"))


@query("priority_pick", """with c as (select unnest([lang, source]) as cat, n_chars from documents), v as (select distinct lang as cat from documents where lang <> 'de')
  select cat, cast(sum(n_chars) as bigint) as followers from c where cat not in (select cat from v) group by cat having count(*) > 1 order by followers desc, cat limit 1""")
def priority_pick(t):
    from webloom.operators.search import priority_pick as run
    seen = t.documents.select(F.explode(F.array("lang", "source")).alias("cat"), F.col("n_chars").alias("followers"))
    return run(seen, t.documents.filter("lang <> 'de'").select(F.col("lang").alias("cat")), "cat")
