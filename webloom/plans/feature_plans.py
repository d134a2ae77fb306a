"""Feature preparation and array functions over the business tables and embeddings."""

from pyspark.sql import functions as F

from webloom.functions import vectors as V
from webloom.operators import features as X
from webloom.operators import nearest as N
from webloom.operators import terms as W
from webloom.operators.joins import lookup
from webloom.plans.registry import query
from webloom.plans.search_plans import BAG, VOCAB, words
from webloom.plans.text_plans import WORDS_SQL
from webloom.session import checkpoint

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("column_bounds", " union all ".join(f"select '{c}' as name, min({c}) + 0 as low, max({c}) + 0 as high from lineitem" for c in NUMBERS))
def column_bounds(t):
    return X.column_bounds(t.lineitem, NUMBERS)


@query("category_domain", "select value, row_number() over (order by value) - 1 as index from (select distinct p_brand as value from part)")
def category_domain(t):
    return X.category_domain(t.part, "p_brand")


@query("categorical_mapping", """with m as (select v, row_number() over (order by v) - 1 as index from (select distinct o_orderpriority as v from orders))
  select o_orderkey, index from orders join m on v = o_orderpriority""")
def categorical_mapping(t):
    mapping = X.category_domain(t.orders, "o_orderpriority")
    return X.categorical_mapping(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", mapping, "o_orderkey").select("o_orderkey", "index")


@query("lookup_join", """select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def lookup_join(t):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return lookup(t.customer.select("c_custkey", "c_nationkey"), nations, "c_nationkey", "left", "c_custkey").select("c_custkey", "n_name", "r_name")


@query("one_hot", """select l_orderkey, l_linenumber, (l_returnflag = 'A')::int as l_returnflag_A, (l_returnflag = 'N')::int as l_returnflag_N,
  (l_returnflag = 'R')::int as l_returnflag_R, (l_linestatus = 'F')::int as l_linestatus_F, (l_linestatus = 'O')::int as l_linestatus_O from lineitem""")
def one_hot(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return X.OneHot(["l_returnflag", "l_linestatus"]).fit(rows).transform(rows)


SCALED = ", ".join(f"round(({c} - (select min({c}) from lineitem)) / (select max({c}) - min({c}) from lineitem), 9) as {c}" for c in NUMBERS)


@query("min_max_scale", f"select l_orderkey, l_linenumber, {SCALED} from lineitem")
def min_max_scale(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", *NUMBERS)
    scaled = X.MinMaxScale(NUMBERS).fit(rows).transform(rows)
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in NUMBERS])


@query("fit_transform", """select l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 9) as l_quantity from lineitem,
  (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem where l_returnflag = 'R' and l_quantity < 40)""")
def fit_transform(t):
    """Bounds learnt on one part of the rows are applied to all of them."""
    scale = X.MinMaxScale(["l_quantity"]).fit(t.lineitem.filter("l_returnflag = 'R' and l_quantity < 40"))
    return scale.transform(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")).withColumn("l_quantity", F.round("l_quantity", 9))


@query("label_offset", "select vec_id, label - 1 as label from embeddings")
def label_offset(t):
    return X.label_offset(t.embeddings.select("vec_id", "label"), "label", -1)


@query("missing_value_filter", " union all ".join(f"select l_orderkey, l_linenumber, '{c}' as name, {c} as value from lineitem where {c} <> 0" for c in NUMBERS))
def missing_value_filter(t):
    return X.missing_value_filter(t.lineitem, ["l_orderkey", "l_linenumber"], NUMBERS, 0.0)


@query("drop_label_or_id", "select c_name, c_acctbal, c_mktsegment from customer")
def drop_label_or_id(t):
    return X.drop_label_or_id(t.customer, ("c_custkey", "c_nationkey"))


@query("shuffle", "select o_orderkey, row_number() over (order by md5(o_orderkey || ':7'), o_orderkey) as position from orders")
def shuffle(t):
    return X.shuffle(t.orders.select("o_orderkey"), ["o_orderkey"], 7)


@query("train_test_split", """with s as (select o_orderkey, row_number() over (order by md5(o_orderkey || ':11'), o_orderkey) as position from orders)
  select o_orderkey, position, case when position <= floor((select count(*) from orders) * 0.9::double) then 'train' else 'test' end as part from s""")
def train_test_split(t):
    return X.train_test_split(t.orders.select("o_orderkey"), ["o_orderkey"], 0.1, 11)


@query("channel_means", """select pos, round(avg(v), 6) as mean from (select generate_subscripts(embedding, 1)::int - 1 as pos, unnest(embedding)::double as v from embeddings) group by pos""")
def channel_means(t):
    vectors = t.embeddings.select(F.col("embedding").cast("array<double>").alias("v"))
    return X.channel_means(vectors, "v", 64).withColumn("mean", F.round("mean", 6))


@query("class_weights", """with c as (select label, count(*) as n from embeddings group by label)
  select label, round((select sum(n) from c)::double / ((select count(*) from c) * n), 9) as weight from c""")
def class_weights(t):
    return X.class_weights(t.embeddings, "label").withColumn("weight", F.round("weight", 9))


@query("document_term_matrix", f"""with {BAG}, {VOCAB}, v as (select term, row_number() over (order by term) - 1 as pos from vocab)
  select doc_id, string_agg(pos || ':' || tf, ' ' order by pos) as row from bag join v using (term) group by doc_id""")
def document_term_matrix(t):
    vocab = checkpoint(W.vocabulary(t.documents, words()))
    rows = X.document_term_matrix(W.bag_of_words(t.documents, words()), vocab)
    cell = F.zip_with("positions", "values", lambda p, v: F.concat_ws(":", p.cast("string"), v.cast("int").cast("string")))
    return rows.select("doc_id", F.array_join(cell, " ").alias("row"))


@query("embed_index_sequence", f"""with {BAG}, {VOCAB}, v as (select term, row_number() over (order by term) - 1 as pos from vocab),
  w as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as term from (select doc_id, {WORDS_SQL} as x from documents)),
  f as (select doc_id, term, min(i) as i from w group by all), k as (select *, row_number() over (partition by doc_id order by i) as n from f),
  s as (select doc_id, list(pos order by n) as p from k join v using (term) where n <= 20 group by doc_id)
  select doc_id, array_to_string(list_concat(coalesce(p, []), list_transform(range(20), lambda x: 0))[1:20], ' ') as row from documents left join s using (doc_id)""")
def embed_index_sequence(t):
    vocab = checkpoint(W.vocabulary(t.documents, words()))
    rows = X.embed_index_sequence(t.documents, words(), vocab, 20)
    return rows.select("doc_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), " ").alias("row"))


@query("nearest_vectors", """with q as (select vec_id, embedding::double[] as e from embeddings), s as (select a.vec_id as query_id, b.vec_id as item_id,
    round(list_cosine_distance(a.e, b.e), 6) as d from q a, q b where a.vec_id % 100 = 0)
  select query_id, item_id, round(sqrt(2 * d), 3) as distance, row_number() over (partition by query_id order by d, item_id) as rank from s qualify rank <= 5""")
def nearest_vectors(t):
    """Every hundredth vector against all of them, five nearest by angle."""
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = N.nearest_vectors(vectors.filter("id % 100 = 0"), vectors, 5)
    return found.select("query_id", "item_id", F.round("distance", 3).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("nearest_euclidean", """with q as (select vec_id, embedding::double[] as e from embeddings), s as (select a.vec_id as query_id, b.vec_id as item_id,
    round(list_distance(a.e, b.e), 7) as d from q a, q b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
  select query_id, item_id, round(d, 3) as distance, row_number() over (partition by query_id order by d, item_id) as rank from s qualify rank <= 5""")
def nearest_euclidean(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = N.nearest_vectors(vectors.filter("id % 100 = 0"), vectors, 5, "euclidean", itself=False)
    return found.select("query_id", "item_id", F.round("distance", 3).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("binarize", """select vec_id, array_to_string(list_transform(embedding, lambda x: case when x <= 0 then '0' else '1' end), '') as bits,
  list_sum(list_transform(embedding, lambda x: case when x <= 0 then 0 else 1 end))::bigint as ones from embeddings""")
def binarize(t):
    v = F.col("embedding")
    return t.embeddings.select("vec_id", V.bit_string(v).alias("bits"), F.aggregate(V.binarize(v), F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("ones"))


@query("feature_vectors", """select label as uri, arg_min(vec_id, vec_id) as vec_id, arg_min(md5(array_to_string(list_transform(embedding, lambda x: case when x <= 0 then '0' else '1' end), '')), vec_id) as digest
  from embeddings group by label""")
def feature_vectors(t):
    """First vector per uri."""
    first = F.min_by(F.struct("vec_id", "embedding"), F.col("vec_id"))
    return t.embeddings.groupBy(F.col("label").alias("uri")).agg(first.alias("f")).select(
        "uri", "f.vec_id", F.md5(V.bit_string(F.col("f.embedding"))).alias("digest"))


@query("path_distances", """with p as (select p_partkey, string_split(p_name || ' ' || p_type, ' ') as a, string_split(p_name || ' ' || p_brand, ' ') as b, p_size, p_partkey % 50 + 1 as s from part),
  d as (select *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) as shared from p)
  select p_partkey, cast(greatest(len(a), len(b)) - shared as int) as prefix, round(abs(p_size - s)::double / (p_size + s), 9) as size,
   round(1 - (1 - abs(p_size - s)::double / (p_size + s)) * (1 - abs(p_size - s)::double / (p_size + s)), 9) as boosted from d""")
def path_distances(t):
    a, b = F.split(F.concat_ws(" ", "p_name", "p_type"), " "), F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")
    size = V.size_distance(F.col("p_size"), F.col("p_partkey") % 50 + 1)
    return t.part.select("p_partkey", V.prefix_distance(a, b).alias("prefix"), F.round(size, 9).alias("size"), F.round(V.boost(size), 9).alias("boosted"))


@query("class_similarity", """with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))))) as pos, string_split(text, chr(10)) as lines from documents),
  c as (select doc_id, pos, list_distinct(list_filter(string_split(lines[pos], ' '), lambda x: x <> '')) as a,
    list_distinct(list_filter(string_split(lines[pos + 1], ' '), lambda x: x <> '')) as b from l),
  n as (select doc_id, pos, least(3, len(a)) as a, least(3, len(b)) as b, least(3, len(list_intersect(a, b))) as k from c)
  select doc_id, pos, round((1 + k)::double / (1 + a + b - k), 9) as similarity from n""")
def class_similarity(t):
    """Every line of a text against the next one."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    pairs = F.arrays_zip(lines.alias("a"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("b"))
    return t.documents.select("doc_id", F.posexplode(F.filter(pairs, lambda p: p["b"].isNotNull())).alias("at", "p")).select(
        "doc_id", (F.col("at") + 1).cast("bigint").alias("pos"), F.round(V.class_similarity(F.col("p.a"), F.col("p.b"), 3), 9).alias("similarity"))


@query("deep_merge", """select o_orderkey, '/a/status=' || case when o_orderkey % 2 = 0 then 'new' else o_orderstatus end || ';/b/price=' || o_totalprice || ';/c/rank=' || o_orderpriority as merged from orders""")
def deep_merge(t):
    left = F.create_map(F.lit("/a/status"), "o_orderstatus", F.lit("/b/price"), F.col("o_totalprice").cast("string"))
    right = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("/a/status"), F.lit("new"), F.lit("/c/rank"), "o_orderpriority")).otherwise(
        F.create_map(F.lit("/c/rank"), "o_orderpriority"))
    entries = F.array_sort(F.map_entries(V.deep_merge(left, right)))
    return t.orders.select("o_orderkey", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("merged"))


@query("merge_annotations", """with a as (select p_brand as key, p_type as name, p_partkey, p_name from part)
  select key, name, arg_min(p_name, p_partkey) as value from a group by all""")
def merge_annotations(t):
    """Rows of one key united: the first value of every name stays."""
    return t.part.groupBy(F.col("p_brand").alias("key"), F.col("p_type").alias("name")).agg(F.min_by("p_name", "p_partkey").alias("value"))


@query("path_to_nested", """select p_partkey, 'table,product,' || p_size || ',name' as keys from part""")
def path_to_nested(t):
    path = F.format_string("/table/product[%d]/name", "p_size")
    return t.part.select("p_partkey", F.array_join(V.nested_path(path), ",").alias("keys"))


@query("mail_body", """select conv_id, turn, case when turn % 4 = 3 then 'snippet of ' || conv_id when role = 'user' then text || role else text end as body from conversations""")
def mail_body(t):
    """Text parts of a mail, else its first part, else its body, else the snippet."""
    from webloom.operators.search import mail_body as run
    mime = F.when(F.col("role") == "user", "text/plain").otherwise("text/html")
    part = lambda data: F.struct(mime.alias("mime"), data.alias("data"))
    parts = F.when(F.col("turn") % 4 != 3, F.array(part(F.col("text")), part(F.col("role"))))
    snippet = F.concat(F.lit("snippet of "), "conv_id")
    return t.conversations.select("conv_id", "turn", run(F.coalesce(parts, F.array().cast("array<struct<mime: string, data: string>>")), F.lit(""), snippet).alias("body"))


@query("paragraph_text", """with l as (select doc_id, lang, source, list_filter(string_split(text, chr(10)), lambda x: length(x) % 2 = 0) as p from documents)
  select doc_id, array_to_string(p, '') as body, lang || ',' || source as tags from l""")
def paragraph_text(t):
    from webloom.operators.search import paragraph_text as run
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct((2 - F.when(F.length(x) % 2 == 0, 1).otherwise(0)).alias("type"), x.alias("text")))
    tags = F.array(F.struct(F.col("lang").alias("slug")), F.struct(F.col("source").alias("slug")))
    return t.documents.select("doc_id", run(lines).alias("body"), F.array_join(F.transform(tags, lambda x: x["slug"]), ",").alias("tags"))


@query("score_priority_levels", """select vec_id, cast(trunc((embedding[1]::double + 0.5) * 20) as int) as level from embeddings""")
def score_priority_levels(t):
    score = F.get("embedding", 0).cast("double") + 0.5
    return t.embeddings.select("vec_id", (score * 20).cast("int").alias("level"))


#: Rows that the hash of their ids and the seed holds out of training.
HELD = "cast('0x' || substr(md5({}), 1, 8) as bigint) / 4294967296::double < 0.1"


@query("train_boosted_trees", f"""with r as (select {HELD.format("l_orderkey || ':' || l_linenumber || ':3'")} as held from lineitem)
  select s.step as iteration, count(*) filter (held) as rows, count(*) filter (not held) as trained, true as good from r, (select unnest([2, 4, 5]) as step) s group by s.step""")
def train_boosted_trees(t):
    """Boosted trees on scaled order features, measured on the held-out rows after every second round."""
    from webloom.operators.boosting import split, train_report
    ids = ["l_orderkey", "l_linenumber"]
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                             F.when(F.col("l_extendedprice") > 50000, 1).when(F.col("l_quantity") > 25, 2).otherwise(0).alias("label"))
    report = train_report(rows, ids, NUMBERS, "label", classes=3, rounds=5, every=2, fraction=0.1, seed=3)
    trained = split(rows, ids, 0.1, 3)[0].count()
    return report.select(F.col("iteration").cast("bigint").alias("iteration"), "rows", F.lit(trained).cast("bigint").alias("trained"), (F.col("f1") > 0.7).alias("good"))


@query("predict_best", f"""select p_partkey, case when p_size > 25 then 1 else 0 end as cat, true as sure, true as near from part where {HELD.format("p_partkey || ':5'")}""")
def predict_best(t):
    """Best class of the held-out rows, and a value for them by regression trees that must come near the true one."""
    from webloom.operators.boosting import predict, predict_values, split, train, train_values
    features = ["size", "p_retailprice"]
    size = F.col("p_size").cast("double")
    rows = t.part.select("p_partkey", size.alias("size"), "p_retailprice", (size > 25).cast("int").alias("label"), (size * 20 + F.col("p_retailprice") / 10).alias("worth"))
    fit_rows, held = split(rows, ["p_partkey"], 0.1, 5)
    classed = predict(train(fit_rows, features, "label", 2, rounds=5, seed=5), held, features, "label", classes=2)
    valued = predict_values(train_values(fit_rows, features, "worth", rounds=10, seed=5), held, features, "worth")
    best = F.get(V.best_categories(F.col("pred"), 1), 0)
    return classed.select("p_partkey", best["cat"].alias("cat"), (best["prob"] > 0.75).alias("sure")).join(
        valued.select("p_partkey", (F.abs(F.col("pred")[0] - F.col("target")) < 100).alias("near")), "p_partkey")
