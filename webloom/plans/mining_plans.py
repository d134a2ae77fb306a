"""Repeated items of the generated pages. Their lists have four to six entries, so clusters
of four count here."""

from pyspark.sql import functions as F

from webloom.operators import mining as M
from webloom.operators import nodes as P
from webloom.plans.page_plans import TREE
from webloom.plans.registry import query
from webloom.session import checkpoint

MIN = 4
# Shapes, brute-force pairs and components of the page tree.
SHAPES = r""", rels as (select n.page_id, n.node, n.parent, n.tag, n.end_node - n.node as size, case when contains(n.tok, 'class="') then regexp_extract(n.tok, 'class="([^"]*)"', 1) else '' end as cls,
     n.path, substr(x.tag_path, length(n.tag_path) - length(n.tag) + 1) as rel from tree n join tree x on x.page_id = n.page_id and x.node >= n.node and x.node < n.end_node and x.depth <= n.depth + 2
     where n.tag <> '[T]'),
 cnt as (select page_id, node, parent, tag, size, cls, any_value(path) as path, rel, count(*) as n from rels group by page_id, node, parent, tag, size, cls, rel),
 shp as (select page_id, node, parent, tag, size, cls, any_value(path) as path, string_agg(rel || '=' || n, ' ' order by rel) as shape from cnt group by page_id, node, parent, tag, size, cls),
 named as (select *, min(node) over (partition by page_id, parent, tag, size, cls, shape) as first, count(*) over (partition by page_id, parent, tag, size, cls, shape) as same from shp),
 fold as (select distinct page_id, parent, tag, size, cls, first, same from named),
 lows as (select a.page_id, a.node as a, b.node as b, sum(least(a.n, b.n)) as low from cnt a join cnt b on a.page_id = b.page_id and a.parent = b.parent and a.tag = b.tag and a.rel = b.rel and a.node < b.node
    where (a.page_id, a.node) in (select page_id, first from fold) and (b.page_id, b.node) in (select page_id, first from fold) group by all),
 tot as (select page_id, node, sum(n) as total from cnt group by all),
 sims as (select f.page_id, f.parent, f.tag, f.first as a, g.first as b, f.same as a_members, g.same as b_members,
    low::double / (ta.total + tb.total - low) * (case when f.cls = g.cls then case when f.cls = '' then 1.0::double else 1.0::double end else 1.0::double / (1 + (f.cls <> '')::int + (g.cls <> '')::int) end) as similarity,
    1 - (1 - abs(f.size - g.size)::double / (f.size + g.size)) * (1 - abs(f.size - g.size)::double / (f.size + g.size)) as sp
    from lows l join fold f on f.page_id = l.page_id and f.first = l.a join fold g on g.page_id = l.page_id and g.first = l.b
    join tot ta on ta.page_id = l.page_id and ta.node = l.a join tot tb on tb.page_id = l.page_id and tb.node = l.b),
 edges as (select *, sqrt(greatest(2 - 2 * similarity, 0)) + sp as distance from sims where sqrt(greatest(2 - 2 * similarity, 0)) + sp <= 1.2),
 und as (select page_id, a, b from edges union select page_id, b, a from edges),
 reach as (select page_id, first as v, first as r from fold union select e.page_id, e.b, reach.r from reach join und e on e.page_id = reach.page_id and e.a = reach.v),
 lab as (select page_id, v, min(r) as label from reach group by all),
 raw_clusters as (select n.page_id, n.parent, n.node, n.tag, n.size, n.path, lab.label as cluster, count(*) over (partition by n.page_id, lab.label) as members
    from named n join lab on lab.page_id = n.page_id and lab.v = n.first),
 clusters as (select * from raw_clusters where members >= 4)"""
ITEMS = SHAPES + r""", par as (select distinct page_id, parent, cluster as label from clusters),
 kid as (select t.page_id, p.label, t.parent, t.node, c.cluster as root_label from tree t join par p on p.page_id = t.page_id and p.parent = t.parent
    left join clusters c on c.page_id = t.page_id and c.node = t.node where t.tag <> '[T]'),
 fst as (select page_id, label, parent, arg_min(root_label, node) as first from kid where root_label is not null group by all),
 cut as (select k.*, greatest(1, sum(case when root_label = first then 1 else 0 end) over (partition by k.page_id, k.label, k.parent order by node))::bigint as item from kid k join fst using (page_id, label, parent)),
 items as (select page_id, label, parent, item, node, row_number() over (partition by page_id, label, parent, item order by node) - 1 as pos, root_label from cut
    where (page_id, label, parent, item) in (select page_id, label, parent, item from cut where root_label = label))"""


def mine(rest, with_=SHAPES):
    return f"with recursive {TREE}{with_} {rest}"


def stored(t):
    """The page trees are read by several steps, so they are stored once, with what the steps use of a node."""
    used = lambda n: F.struct(
        *[n[c].alias(c) for c in ("node", "end_node", "parent", "depth", "tag", "classes", "path", "tag_path", "text")],
        F.map_filter(n["attrs"], lambda k, v: k.isin("href", "src")).alias("attrs"))
    return checkpoint(P.page_nodes(t.pages, keep=("page_id",)).select("page_id", F.transform("nodes", used).alias("nodes")))


def clustered(t):
    trees = stored(t)
    return trees, checkpoint(M.cluster_subtrees(M.node_shapes(trees), min_size=MIN))


def itemized(t):
    trees, clusters = clustered(t)
    rows = P.node_rows(trees)
    return rows, clusters, M.extract_items(rows, clusters)


def aligned(t):
    rows, _, items = itemized(t)
    return M.align_fields(rows, M.regularize_items(items))


@query("subtree_similarity", mine("select page_id, parent, tag, a, b, a_members, b_members, round(similarity, 9) as similarity, round(distance, 9) as distance from edges").replace("<= 1.2)", "<= 1.6)"))
def subtree_similarity(t):
    """Wider than the clustering distance, so that the generated pages have some pairs."""
    found = M.subtree_similarity(M.folded_shapes(M.marked_shapes(M.node_shapes(P.page_nodes(t.pages)))), eps=1.6)
    return found.withColumn("similarity", F.round("similarity", 9)).withColumn("distance", F.round("distance", 9))


@query("cluster_subtrees", mine("select page_id, parent, node, tag, size, cluster, members from clusters"))
def cluster_subtrees(t):
    return clustered(t)[1].drop("path")


@query("tournament_counts", mine("""select a.page_id, a.cluster as outer, b.cluster as inner, count(*) as n from raw_clusters a join raw_clusters b on a.page_id = b.page_id
   and b.node <> a.node and list_contains(b.path, a.node) group by all""").replace("as outer", 'as "outer"').replace("as inner", 'as "inner"'))
def tournament_counts(t):
    trees = stored(t)
    return M.tournament_counts(M.cluster_subtrees(M.node_shapes(trees), min_size=1))


@query("separate_clusters", mine("""select page_id, cluster, node from clusters c where not exists (select 1 from clusters a where a.page_id = c.page_id and a.node <> c.node and list_contains(c.path, a.node))"""))
def separate_clusters(t):
    return M.separate_clusters(clustered(t)[1]).select("page_id", "cluster", "node")


SCORES = """, o as (select *, row_number() over (partition by page_id, cluster order by node) as ord from clusters),
  d as (select a.page_id, a.cluster, a.node, least(a.size, b.size) / 4.0::double as v, row_number() over (partition by a.page_id, a.cluster, a.node
    order by abs(a.ord - b.ord), case when b.ord < a.ord then 0 else 1 end) as rn from o a join o b on a.page_id = b.page_id and a.cluster = b.cluster and a.node <> b.node),
  scores as (select page_id, cluster, (select count(*) from clusters c where c.page_id = d.page_id and c.cluster = d.cluster) as items, sum(v) as score from d where rn <= 4 group by all)"""


@query("score_clusters", mine("select page_id, cluster, items, round(score, 6) as score from scores", SHAPES + SCORES))
def score_clusters(t):
    return M.score_clusters(clustered(t)[1]).withColumn("score", F.round("score", 6))


@query("ranked_clusters", mine("select page_id, cluster, items, round(score, 6) as score, row_number() over (partition by page_id order by score desc, cluster) as rank from scores where items >= 5", SHAPES + SCORES))
def ranked_clusters(t):
    return M.ranked_clusters(M.score_clusters(clustered(t)[1]), 5).withColumn("score", F.round("score", 6))


@query("extract_items", mine("select page_id, label, parent, item, node, pos, root_label from items", ITEMS))
def extract_items(t):
    return itemized(t)[2].withColumn("item", F.col("item").cast("bigint"))


REGULAR = ITEMS + """, len_ as (select page_id, label, parent, item, count(*) as length from items group by all),
  votes as (select page_id, label, length, count(*) as v from len_ group by all),
  mode_ as (select page_id, label, length as m from votes qualify row_number() over (partition by page_id, label order by v desc, length) = 1),
  use_ as (select page_id, label, any_value(m) as m from votes join mode_ using (page_id, label) group by all having sum(case when length > m then v else 0 end) <= 0.33 * sum(v)),
  kept as (select i.*, m, count(*) over (partition by i.page_id, i.label, i.root_label) as common from items i join len_ using (page_id, label, parent, item) join use_ using (page_id, label) where length >= m),
  best as (select * from kept qualify row_number() over (partition by page_id, label, parent, item order by common desc, node desc) <= m),
  regular as (select page_id, label, parent, item, node, row_number() over (partition by page_id, label, parent, item order by node) - 1 as pos, root_label from best)"""


@query("regularize_items", mine("select * from regular", REGULAR))
def regularize_items(t):
    return M.regularize_items(itemized(t)[2])


DIVIDE = SHAPES + """, kid as (select t.page_id, t.parent, t.node, coalesce(c.cluster, -1) as label from tree t left join clusters c on c.page_id = t.page_id and c.node = t.node
     where t.tag <> '[T]' and (t.page_id, t.parent) in (select page_id, parent from clusters)),
  sep as (select distinct page_id, parent, cluster as separator from clusters),
  cut as (select k.*, separator, sum(case when label = separator then 1 else 0 end) over (partition by k.page_id, k.parent, separator order by node) as record from kid k join sep using (page_id, parent)),
  ent as (select *, row_number() over (partition by page_id, parent, separator, record, label order by node) as ord from cut),
  recs as (select page_id, parent, separator, count(distinct record) as records, count(*) as length from ent group by all),
  shared as (select a.page_id, a.parent, a.separator, count(*) as shared from ent a join ent b on a.page_id = b.page_id and a.parent = b.parent and a.separator = b.separator
     and a.label = b.label and a.ord = b.ord and a.record < b.record group by all),
  scored as (select r.*, coalesce(shared, 0) / (records * (records - 1) / 2.0::double + 1) / (length::double / records) as score from recs r left join shared using (page_id, parent, separator))"""


@query("divide_records", mine("select page_id, parent, separator, records, round(score, 6) as score from scored qualify row_number() over (partition by page_id, parent order by score desc, separator) = 1", DIVIDE))
def divide_records(t):
    """Best separator of every parent of repeated children."""
    trees, clusters = clustered(t)
    return M.divide_records(M.separated(P.node_rows(trees), clusters)).withColumn("score", F.round("score", 6))


UNESC = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
FIELDS = REGULAR + f""", inside as (select r.page_id, r.label, r.parent, r.item, r.pos, t.node, t.tag, r.pos || ':' || array_to_string(string_split(substr(t.tag_path, 2), '/')[list_position(t.path, r.node):], '/') as below,
    case when t.tag = '[T]' then {UNESC.format('t.tok')} else {UNESC.format("regexp_extract(t.tok, 'href=\"([^\"]*)\"', 1)")} end as value
    from regular r join tree t on t.page_id = r.page_id and list_contains(t.path, r.node) where t.tag in ('[T]', 'a', 'img')),
  keyed as (select *, below || '#' || (row_number() over (partition by page_id, label, parent, item, below order by node) - 1) as key from inside),
  started as (select *, min(node) over (partition by page_id, label, key) as start from keyed),
  fields as (select page_id, label, parent, item, key, dense_rank() over (partition by page_id, label order by start, key) - 1 as col, node, tag, value from started)"""


@query("align_fields", mine('select page_id, label, parent, item, key, col as "column", node, tag, value from fields', FIELDS))
def align_fields(t):
    return aligned(t)


SCHEMA = FIELDS + """, n_items as (select page_id, label, count(distinct (parent, item)) as items from fields group by all),
  schema_ as (select page_id, label, col, key, case when bool_and(tag = 'img') then 'image' when bool_and(tag = 'a') then 'url' else 'text' end as type,
    count(distinct (parent, item)) as present, count(distinct value) as vals from fields group by all),
  described as (select page_id, label, col as "column", key, type, present = items as required, vals > 1 as vary, present, items from schema_ join n_items using (page_id, label))"""


@query("item_schema", mine("select * from described", SCHEMA))
def item_schema(t):
    return M.item_schema(aligned(t))


@query("field_type", mine("select page_id, label, key, type from described", SCHEMA))
def field_type(t):
    return M.item_schema(aligned(t)).select("page_id", "label", "key", "type")


#: Rows of the pairing table: the best score up to each place of the seed, and the places paired so far. A third of the fields is
#: left out by item, so that fields are missing and their ordinals shift.
PAIRING = FIELDS + """, thinned as (select *, regexp_extract(key, '^[^#]*', 0) as p from fields where (parent + item) % 3 <> 0 or col % 2 = 0),
  ms_seq as (select page_id, label, parent, item, list({'k': key, 'p': p, 't': regexp_extract(p, '[^/:]*$', 0)} order by node) as own from thinned group by all),
  ms_pick as (select page_id, label, arg_max(own, (len(own), -parent, -item)) as seed from ms_seq group by all),
  ms_start as (select s.*, p.seed, len(own) * len(seed) + 1 as near, (len(own) * len(seed) + 1) * (least(len(own), len(seed)) + 1) as equal from ms_seq s join ms_pick p using (page_id, label)),
  ms_steps as (select page_id, label, parent, item, own, seed, near, equal, 0 as i, list_transform(range(0, len(seed) + 1), lambda x: {'s': 0::bigint, 'm': []::bigint[]}) as best from ms_start
    union all
    select page_id, label, parent, item, own, seed, near, equal, i + 1, list_transform(cand, lambda c, z: list_sort(cand[1:z])[-1])
    from (select *, list_transform(best, lambda b, z: case
        when z > 1 and own[i + 1].p = seed[z - 1].p and best[z - 1].s + equal - abs(z - 2 - i) > b.s then {'s': best[z - 1].s + equal - abs(z - 2 - i), 'm': list_append(best[z - 1].m, z - 1)}
        when z > 1 and own[i + 1].p <> seed[z - 1].p and own[i + 1].t = seed[z - 1].t and best[z - 1].s + near - abs(z - 2 - i) > b.s
          then {'s': best[z - 1].s + near - abs(z - 2 - i), 'm': list_append(best[z - 1].m, z - 1)}
        else b end) as cand from ms_steps where i < len(own))),
  ms_matched as (select page_id, label, seed[j].k as key from (select page_id, label, seed, unnest(best[-1].m) as j from ms_steps where i = len(own))),
  ms_kinds as (select page_id, label, count(*) as items from ms_seq group by all),
  ms_majority as (select page_id, label, key, count(*) as present, any_value(items) as items from ms_matched join ms_kinds using (page_id, label) group by all)"""


@query("match_sequences", mine("select page_id, label, key, present, items from ms_majority where present >= 0.5 * items", PAIRING))
def match_sequences(t):
    """Fields that half of the items have, where every third item lacks each second field."""
    whole = (F.col("parent") + F.col("item")) % 3 != 0
    thinned = aligned(t).filter(whole | (F.col("column") % 2 == 0))
    return M.match_sequences(checkpoint(thinned.select("page_id", "label", "parent", "item", "node", "key")))


@query("item_field_count_filter", mine("select page_id, label, count(*) as fields from described group by all having count(*) >= 2", SCHEMA))
def item_field_count_filter(t):
    return M.item_field_count_filter(M.item_schema(aligned(t)))


@query("seed_alignment", mine("""select page_id, label, key, row_number() over (partition by page_id, label order by at_, key) - 1 as place, in_seed from (
   select page_id, label, key, avg(place_) as at_, bool_or(seed) as in_seed from (select *, (parent, item) = first_value((parent, item)) over (partition by page_id, label order by width desc, parent, item) as seed
     from (select *, (row_number() over (partition by page_id, label, parent, item order by node) - 1)::double / count(*) over (partition by page_id, label, parent, item) as place_,
       count(*) over (partition by page_id, label, parent, item) as width from fields)) group by all)""", FIELDS))
def seed_alignment(t):
    return M.seed_alignment(aligned(t))


@query("records_to_json", mine("""select page_id, label, parent, item, '{' || string_agg(to_json(key)::varchar || ':' || to_json(value)::varchar, ',' order by col, key) || '}' as record
   from fields group by all""", FIELDS))
def records_to_json(t):
    return M.records_to_json(aligned(t))


@query("record_pairs", mine("select page_id, label, count(*) * (count(*) - 1) // 2 as pairs from (select distinct page_id, label, parent, item from items) group by all", ITEMS))
def record_pairs(t):
    """Number of unordered record pairs per item type, counted without building them."""
    items = itemized(t)[2].select("page_id", "label", "parent", "item").distinct()
    n = F.count("*")
    return items.groupBy("page_id", "label").agg((n * (n - 1) / 2).cast("bigint").alias("pairs"))


@query("common_prefix_suffix", mine("""select page_id, label, array_to_string(list_filter(a, lambda x, i: a[1:i] = b[1:i]), ',') as prefix,
   array_to_string(list_reverse(list_filter(c, lambda x, i: c[1:i] = d[1:i])), ',') as suffix from (
   select page_id, label, min(s) as a, max(s) as b, min(list_reverse(s)) as c, max(list_reverse(s)) as d from (
     select i.page_id, i.label, i.parent, i.item, list(t.tag order by t.node) as s from items i join tree t on t.page_id = i.page_id and list_contains(t.path, i.node) group by all) group by all)""", ITEMS))
def common_prefix_suffix(t):
    rows, _, items = itemized(t)
    found = M.common_prefix_suffix(items, rows)
    return found.select("page_id", "label", F.array_join("prefix", ",").alias("prefix"), F.array_join("suffix", ",").alias("suffix"))
