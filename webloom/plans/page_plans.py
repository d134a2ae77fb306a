"""Page trees: structure queries and record extraction."""

from pyspark.sql import functions as F

from webloom.operators import extract as E
from webloom.operators import nodes as P
from webloom.operators.select import select
from webloom.plans.registry import query

# The page tree in SQL: tokens, a stack that closes tags, and containment by node number.
TREE = r"""toks as (select page_id, generate_subscripts(x, 1) as i, unnest(x) as tok from (select page_id, regexp_extract_all(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)(<script\b[^>]*>).*?(</script)', '\1\2', 'g'), '(?is)(<style\b[^>]*>).*?(</style)', '\1\2', 'g'), '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '<[^>]+>|[^<]+') as x from pages)),
 kinds as (select *, case when starts_with(tok, '</') then 'close' when starts_with(tok, '<') then 'open' else 'text' end as kind,
    lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) as name from toks),
 nums as (select *, sum(case when kind = 'open' or (kind = 'text' and trim(tok, E' \n\t\r') <> '') then 1 else 0 end) over (partition by page_id order by i)::int as upto from kinds),
 tags as (select page_id, kind, name, upto, row_number() over (partition by page_id order by i) as k from nums where kind <> 'text'),
 walk as (select page_id, 0::bigint as k, []::struct(t varchar, n int)[] as stack, null::int as done, null::int as ends from pages
  union all select w.page_id, w.k + 1, case when kind = 'open' then list_append(stack, {'t': name, 'n': upto - 1})
      when hit is not null then stack[1:len(stack) - hit] else stack end,
    case when kind = 'close' and hit is not null then stack[len(stack) - hit + 1].n end, upto
  from (select walk.*, t.kind, t.name, t.upto, list_position(list_transform(list_reverse(walk.stack)[1:20], lambda s: s.t), t.name) as hit
        from walk join tags t on t.page_id = walk.page_id and t.k = walk.k + 1) w),
 ends as (select page_id, done as node, ends from walk where done is not null),
 base as (select n.page_id, upto - 1 as node, greatest(upto, coalesce(ends, 0))::int as end_node, case when kind = 'text' then '[T]' else name end as tag, tok
   from nums n left join ends e on e.page_id = n.page_id and e.node = n.upto - 1 where kind = 'open' or (kind = 'text' and trim(tok, E' \n\t\r') <> '')),
 rel as (select d.page_id, d.node, a.node as anc, a.tag as atag from base d join base a on a.page_id = d.page_id and a.node < d.node and a.end_node > d.node),
 up as (select page_id, node, max(anc) as parent, count(*)::int as depth, list(anc order by anc) as anc, string_agg('/' || atag, '' order by anc) as above from rel group by all),
 tree as (select b.page_id, b.node, b.end_node, b.tag, b.tok, coalesce(parent, -1)::int as parent, coalesce(depth, 0) as depth,
    list_append(coalesce(anc, []), b.node) as path, coalesce(above, '') || '/' || b.tag as tag_path from base b left join up u using (page_id, node))"""


def tree_sql(rest):
    return f"with recursive {TREE} {rest}"


def trees(t):
    return P.page_nodes(t.pages)


def rows(t):
    return P.node_rows(trees(t))


@query("page_nodes", tree_sql("select page_id, node, end_node, parent, depth, tag, tag_path from tree"))
def page_nodes(t):
    return rows(t).select("page_id", "node", "end_node", "parent", "depth", "tag", "tag_path")


@query("subtree_size", tree_sql("select page_id, node, end_node - node as size from tree"))
def subtree_size(t):
    return P.subtree_size(rows(t))


@query("child_index", tree_sql("""select page_id, node, (row_number() over (partition by page_id, parent order by node) - 1)::int as child_ix,
   (select count(*) from tree c where c.page_id = tree.page_id and c.parent = tree.node)::int as n_children from tree"""))
def child_index(t):
    return P.child_counts(trees(t))


@query("depth_path", tree_sql("select page_id, node, array_to_string(list_reverse(path), ',') as path from tree"))
def depth_path(t):
    return P.depth_path(rows(t)).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ","))


@query("ancestor_join", tree_sql("select page_id, anc as ancestor, node from rel"))
def ancestor_join(t):
    return P.ancestor_join(rows(t))


@query("sibling_join", tree_sql("""select page_id, node, lag(node) over (partition by page_id, parent order by node) as previous,
  lead(node) over (partition by page_id, parent order by node) as next, count(*) over (partition by page_id, parent) - 1 as siblings from tree"""))
def sibling_join(t):
    return P.sibling_join(rows(t))


@query("same_tag_pairs", tree_sql("select page_id, tag, count(*) * (count(*) + 1) // 2 as pairs from tree group by all"))
def same_tag_pairs(t):
    return P.same_tag_pairs(rows(t))


@query("tree_distance", tree_sql("""select a.page_id, a.node, len(a.path) + len(b.path) - 2 * len(list_filter(range(1, least(len(a.path), len(b.path)) + 1), lambda i: a.path[1:i] = b.path[1:i])) as hops
  from (select *, lead(node) over (partition by page_id order by node) as nxt from tree where tag = '[T]') a join tree b on a.page_id = b.page_id and a.nxt = b.node"""))
def tree_distance(t):
    """Hops from each text to the next one."""
    from pyspark.sql import Window
    texts = rows(t).filter(F.col("tag") == P.TEXT).withColumn("next", F.lead("path").over(Window.partitionBy("page_id").orderBy("node")))
    return texts.filter("next is not null").select("page_id", "node", P.tree_distance(F.col("path"), F.col("next")).cast("bigint").alias("hops"))


@query("common_ancestor", tree_sql("""select page_id, coalesce((select max(anc) from (select anc from rel where rel.page_id = t.page_id and node in (select node from tree x where x.page_id = t.page_id and x.tag = 'a')
   group by anc having count(*) = t.members)), -1) as node, members from (select page_id, count(*) as members from tree where tag = 'a' group by all) t"""))
def common_ancestor(t):
    return P.common_ancestor(rows(t).filter("tag = 'a'"), ["page_id"])


@query("interesting_nodes", tree_sql("select page_id, node, tag from tree where tag in ('a', 'img', '[T]')"))
def interesting_nodes(t):
    return P.interesting_nodes(rows(t)).select("page_id", "node", "tag")


@query("node_predicate", tree_sql("select page_id, node, tag from tree where depth >= 2 and regexp_matches(tag, '^(li|p)$')"))
def node_predicate(t):
    """A caller's own predicate: any function from node columns to a condition."""
    of_interest = lambda depth, tag: (depth >= 2) & tag.rlike("^(li|p)$")
    return rows(t).filter(of_interest(F.col("depth"), F.col("tag"))).select("page_id", "node", "tag")


@query("field_ordinal", tree_sql("""select page_id, node, tag_path, (row_number() over (partition by page_id, tag_path order by node) - 1) as ordinal from tree where tag = '[T]'"""))
def field_ordinal(t):
    from pyspark.sql import Window
    w = Window.partitionBy("page_id", "tag_path").orderBy("node")
    return rows(t).filter(F.col("tag") == P.TEXT).select("page_id", "node", "tag_path", (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"))


@query("candidate_regions", tree_sql("""select page_id, node, count(*) as votes from (
   select page_id, tag_path, max(anc) as node from (select p.page_id, p.tag_path, a.anc, count(*) as seen, any_value(g.members) as members
     from par p join (select page_id, node, unnest(path) as anc from tree) a using (page_id, node)
     join (select page_id, tag_path, count(*) as members from par group by all) g using (page_id, tag_path) group by p.page_id, p.tag_path, a.anc) where seen = members group by all)
  where (page_id, node) in (select page_id, parent from tree where tag <> '[T]' group by all having count(*) >= 2) group by all""").replace(
      "tree as (", "tree as (", 1).replace(" select page_id, node, count(*) as votes", """, par as (select page_id, node, tag_path from tree
   where (page_id, node) in (select page_id, parent from tree where tag = '[T]')) select page_id, node, count(*) as votes""", 1))
def candidate_regions(t):
    return P.candidate_regions(rows(t))


@query("records_per_candidate", tree_sql("select tag_path, count(distinct page_id) as pages, count(*) as texts from tree where tag = '[T]' group by tag_path"))
def records_per_candidate(t):
    return P.records_per_candidate(rows(t))


UNESC = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@query("select_css", tree_sql("""select t.page_id, t.node, 'nav > ul a[href^="/e"]' as selector from tree t join rel using (page_id, node) join tree a on a.page_id = t.page_id and a.node = rel.anc
   join tree n on n.page_id = t.page_id and n.node = a.parent where t.tag = 'a' and contains(t.tok, 'href="/e') and a.tag = 'ul' and n.tag = 'nav'
  union all select page_id, node, 'div.ad, h1' from tree where tag = 'h1' or (tag = 'div' and contains(tok, 'class="ad"'))
  union all select page_id, node, 'li:nth-child(2):not([class])' from (select *, row_number() over (partition by page_id, parent order by node) as k from tree where tag <> '[T]')
    where tag = 'li' and k = 2 and not contains(tok, 'class=')
  union all select page_id, node, 'h1 ~ p' from tree t where tag = 'p' and exists (select 1 from tree h where h.page_id = t.page_id and h.parent = t.parent and h.tag = 'h1' and h.node < t.node)"""))
def select_css(t):
    found = [(s, select(F.col("nodes"), s)) for s in ('nav > ul a[href^="/e"]', "div.ad, h1", "li:nth-child(2):not([class])", "h1 ~ p")]
    named = lambda places, s: F.transform(places, lambda p: F.struct(p["node"].alias("node"), F.lit(s).alias("selector")))
    return trees(t).select("page_id", F.inline(F.flatten(F.array(*[named(places, s) for s, places in found]))))


NAV = r"""nav as (select page_id, url, generate_subscripts(x, 1) - 1 as record, unnest(x) as item from (select page_id, url, regexp_extract_all(html, '<li>(.*?)</li>', 1) as x from pages)),
  li as (select page_id, url, record, regexp_extract(item, 'href="([^"]*)"', 1) as href, regexp_extract(item, '>([^<]*)<', 1) as title from nav)"""


@query("extract_records", rf"""with {NAV} select page_id, record::int as record, {UNESC.format('title')} as title, {UNESC.format('href')} as link,
   {UNESC.format("regexp_extract(href, '^/(.)', 1)")} as initial, regexp_replace({UNESC.format('title')}, '[aeiou]', '_') as masked from li
   where title <> '' and regexp_matches(href, '^/.')""")
def extract_records(t):
    """Navigation entries of every page as records."""
    config = E.Extraction(items="nav li", fields={"title": "a", "link": ["a", "@href"], "initial": ["a", "@href", "/^\\/(.)/"], "masked": ["a", "s/[aeiou]/_/"]})
    return E.extract_records(trees(t), config)


@query("extract_page_record", rf"""with {NAV}, j as (select page_id, string_agg({UNESC.format('title')}, ',' order by record) as entries from li group by page_id)
  select p.page_id, 0 as record, {UNESC.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} as title, entries, regexp_extract(html, 'lang="(\w+)"', 1) as lang,
   null::varchar as missing from pages p join j using (page_id)""")
def extract_page_record(t):
    """Without an item selector every page is one record, complete or not."""
    config = E.Extraction({"title": "title", "entries": "nav a", "lang": ["html", "first()", "@lang"], "missing": "table td"})
    return E.extract_records(trees(t), config)


@query("strict_filter", """select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus end as a, case when o_orderkey % 3 = 0 then o_orderpriority end as b, true as strict
   from orders where o_orderkey % 6 = 0 union all select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus end, case when o_orderkey % 3 = 0 then o_orderpriority end, false
   from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0""")
def strict_filter(t):
    r = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("b"))
    return E.keep_records(r, ["a", "b"], True).withColumn("strict", F.lit(True)).unionByName(E.keep_records(r, ["a", "b"], False).withColumn("strict", F.lit(False)))


@query("css_block", rf"""with {NAV} select page_id, record::int as record, nullif(trim({UNESC.format('title')}), '') as name,
   regexp_extract(url, '^[a-z]+://[^/?#]*') || {UNESC.format('href')} as url from li""")
def css_block(t):
    from webloom.functions import urls as U
    config = E.Extraction(items="nav li", fields={"name": "a", "url": ["a", "@href"]}, strict=False)
    return E.css_block(trees(t), config, base=U.site_root(F.col("_page_url")))


@query("xpath_block", rf"with {NAV} select page_id, record::int as record, nullif({UNESC.format('title')}, '') as name, {UNESC.format('href')} as url from li")
def xpath_block(t):
    return E.xpath_block(trees(t), "//nav[last()]/ul[1]/li[not(@class)]", {"name": "/a[last()]/text()", "url": "//a[contains(@href, '/')][1]"})


@query("multi_block_union", rf"""with {NAV} select page_id, 'nav' as block, record::int as record, {UNESC.format('title')} as title, null::varchar as advert from li where title <> ''
  union all select page_id, 'ad', 0, null, {UNESC.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} from pages""")
def multi_block_union(t):
    return E.multi_block_union(trees(t), {"nav": E.Extraction(items="nav li", fields={"title": "a"}), "ad": E.Extraction(items="div.ad", fields={"advert": ["/[^<]+/"]})})


@query("join_texts", rf"""with {NAV} select page_id, string_agg({UNESC.format('title')}, ',' order by record) as texts from li group by page_id""")
def join_texts(t):
    texts = F.transform(select(F.col("nodes"), "nav a"), lambda p: P.text_of(F.col("nodes"), p["node"], p["end_node"]))
    return trees(t).select("page_id", F.array_join(texts, ",").alias("texts"))


@query("first_match", rf"""with {NAV} select page_id, {UNESC.format('title')} as first from li where record = 0""")
def first_match(t):
    first = F.slice(select(F.col("nodes"), "nav a"), 1, 1)
    return trees(t).select("page_id", F.get(F.transform(first, lambda p: P.text_of(F.col("nodes"), p["node"], p["end_node"])), 0).alias("first"))


@query("attr", rf"""with {NAV} select page_id, record::int as record, {UNESC.format('href')} as href from li""")
def attr(t):
    hrefs = F.transform(select(F.col("nodes"), "li a"), lambda p: F.get(F.col("nodes"), p["node"])["attrs"]["href"])
    return trees(t).select("page_id", F.posexplode(hrefs).alias("record", "href"))


@query("page_meta", rf"""select page_id, {UNESC.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} as title, null::varchar as description, null::varchar as og_title, null::varchar as image from pages""")
def page_meta(t):
    return P.page_meta(trees(t)).select("page_id", "title", "description", "og_title", "image")


@query("page_body", tree_sql(f"""select p.page_id, md5(coalesce(nullif((select string_agg({UNESC.format('x.tok')}, '' order by x.node) from tree a join tree x on x.page_id = a.page_id
     and x.node > a.node and x.node < a.end_node where a.page_id = p.page_id and a.tag = 'article' and x.tag = '[T]'), ''),
   (select string_agg({UNESC.format('x.tok')}, '' order by x.node) from tree x where x.page_id = p.page_id and x.tag = '[T]' and contains(x.tag_path, '/p/')), '')) as digest from pages p"""))
def page_body(t):
    """Text of the densest element. Pages whose article tag is out of reach of the backtrack fall back to paragraphs."""
    return P.page_meta(trees(t)).select("page_id", F.md5("body").alias("digest"))


@query("sanitize_html", rf"""with {NAV} select page_id, string_agg('<li><a href="' || href || '">' || title || '</a></li>', '' order by record) as clean from li group by page_id""")
def sanitize_html(t):
    """The navigation list of each page with links only."""
    lists = t.pages.withColumn("html", F.concat(F.lit('<div onclick="x">'), F.regexp_extract("html", "(?s)<ul>(.*?)</ul>", 1), F.lit("</div>")))
    return P.sanitize_html(P.page_nodes(lists), {"li": (), "a": ("href",)})
