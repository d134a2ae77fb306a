"""URL functions and link jobs over the pages table."""

from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators import links as K
from webloom.operators.joins import lookup
from webloom.plans.registry import query

AUTH = r"regexp_extract({}, '^[a-z]+://([^/?#]*)', 1)"
ROOT = r"regexp_extract({}, '^[a-z]+://[^/?#]*')"
# Tags first, then their attributes one by one: not the way the job reads them.
LINKS = rf"""tags as (select page_id, url, unnest(x) as tag, generate_subscripts(x, 1) as n from (select page_id, url,
   regexp_extract_all(regexp_replace(html, '(?is)<script\b.*?</script>|<!--.*?-->', '', 'g'), '(?i)<a[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>') as x from pages)),
 attrs as (select page_id, url, n, list_filter(regexp_extract_all(tag[3:len(tag) - 1], '[^\s=/"'']+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"'']+))?'),
   lambda x: lower(regexp_extract(x, '^[^\s=]+')) = 'href')[1] as attr from tags),
 raw as (select page_id, url, row_number() over (partition by page_id order by n) - 1 as pos,
   trim(regexp_replace(attr, '(?i)^href\s*=?\s*', ''), chr(34) || chr(39)) as href from attrs where attr is not null),
 links as (select page_id, url, pos, href, regexp_replace(case when starts_with(href, '/') then {ROOT.format('url')} || href
   when starts_with(href, 'http://') or starts_with(href, 'https://') then href
   else {ROOT.format('url')} || '/' || href end, '#.*$', '') as link
   from (select page_id, url, pos, replace(replace(replace(replace(href, '&eacute;', chr(233)), '&#233;', chr(233)), '&#xE9;', chr(233)), '&amp;', '&') as href from raw)),
 internal as (select * from links where {AUTH.format('link')} = {AUTH.format('url')})"""
# The generated pages quote their links doubly and link to their own host only. This view sends a third of the links
# elsewhere, quotes singly or not at all, adds other attributes and writes letters as entities.
MIXED = """replace(replace(case page_id % 4 when 1 then replace(html, '<a href="', '<a data-href="/no" title=''a > b'' HREF = "')
  when 2 then regexp_replace(html, '<a href="([^"]*)"', '<a class=x href=''\\1&eacute;?a=1&amp;b=&#233;&#xE9;''', 'g')
  when 3 then regexp_replace(html, '<a href="([^"\\s]*)"', '<a href=\\1 hreflang=en', 'g') else html end,
  '<a href="/e', '<a href="http://other.example.org/e'), '<a href="/t', '<a href="javascript:t')"""
MIXED_LINKS = LINKS.replace("regexp_replace(html,", f"regexp_replace({MIXED},", 1)


def mixed(t):
    form, html = F.col("page_id") % 4, F.col("html")
    shaped = (F.when(form == 1, F.replace(html, F.lit('<a href="'), F.lit("<a data-href=\"/no\" title='a > b' HREF = \"")))
              .when(form == 2, F.regexp_replace(html, '<a href="([^"]*)"', "<a class=x href='$1&eacute;?a=1&amp;b=&#233;&#xE9;'"))
              .when(form == 3, F.regexp_replace(html, r'<a href="([^"\s]*)"', "<a href=$1 hreflang=en")).otherwise(html))
    shaped = F.replace(F.replace(shaped, F.lit('<a href="/e'), F.lit('<a href="http://other.example.org/e')),
                       F.lit('<a href="/t'), F.lit('<a href="javascript:t'))
    return t.pages.withColumn("html", shaped)


@query("normalize_url", rf"""
with p as (select page_id, unnest([url, replace(url, '://', ':/x/'), regexp_replace(url, '^[a-z]+://', ''), '', 'facebook', '%2i23jr93udn.com', 'facebook.com/']) as raw,
  generate_subscripts([1,2,3,4,5,6,7], 1) as form from pages),
 s as (select *, lower(regexp_extract(raw, '^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)', 1)) as scheme,
   regexp_replace(regexp_extract(raw, '^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)', 2), ':[0-9]*$', '') as name,
   regexp_extract(raw, '^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)', 3) as path from p),
 h as (select *, case when name <> '' then name else replace(path, '/', '') end as host from s),
 e as (select *, case when raw = '' then 'the url string is empty'
   when contains(regexp_replace(path, '%[0-9a-fA-F][0-9a-fA-F]', '', 'g'), '%') then 'invalid URL escape'
   when not contains(host, '.') then 'url domain e.g .com, .net was missing' end as error from h)
select page_id, form, case when error is null then (case when scheme = '' then 'http' else scheme end) || '://' || host ||
  case when length(path) - length(replace(path, '/', '')) > 1 then path else '' end end as normal, error from e""")
def normalize_url(t):
    url = F.col("url")
    forms = F.array(url, F.replace(url, F.lit("://"), F.lit(":/x/")), F.regexp_replace(url, "^[a-z]+://", ""),
                    F.lit(""), F.lit("facebook"), F.lit("%2i23jr93udn.com"), F.lit("facebook.com/"))
    raw = t.pages.select("page_id", F.posexplode(forms).alias("form", "raw"))
    normal, error = U.normalize_url(F.col("raw"))
    return raw.select("page_id", (F.col("form") + 1).cast("bigint").alias("form"), normal.alias("normal"), error.alias("error"))


@query("url_parts", rf"""
select page_id, regexp_replace({AUTH.format('url')}, ':[0-9]*$', '') as host, regexp_extract({AUTH.format('url')}, ':([0-9]+)$', 1) as port,
  regexp_extract(regexp_replace({AUTH.format('url')}, ':[0-9]*$', ''), '([^.]+\.[^.]+)$', 1) as domain,
  regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from pages""")
def url_parts(t):
    url = F.col("url")
    return t.pages.select("page_id", U.hostname(url).alias("host"), U.port(url).alias("port"),
                          U.registered_domain(url).alias("domain"), U.slug(url).alias("slug"))


@query("query_param", r"""
select page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) as page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) as ref,
  'a b&c' as packed from pages""")
def query_param(t):
    url = F.col("url")
    packed = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("z=a+b%26c"))
    no_fragment = F.regexp_replace(url, "#.*$", "")
    packed = F.concat(no_fragment, F.when(no_fragment.contains("?"), "&").otherwise("?"), F.lit("z=a+b%26c"))
    return t.pages.select("page_id", U.query_param(url, "page").alias("page"), U.query_param(url, "ref").alias("ref"),
                          U.query_param(packed, "z").alias("packed"))


@query("request_key", "select page_id, md5(url || chr(10) || html) as md5, sha1(url || chr(10) || html) as sha1 from pages")
def request_key(t):
    content = F.concat_ws("\n", "url", "html")
    return t.pages.select("page_id", F.md5(content).alias("md5"), F.sha1(content).alias("sha1"))


@query("private_ip_filter", """
with ip as (select event_id, (event_id * 7919 + user_id * 104729) % 4294967296 as n from events),
all_ip as (select event_id, n, (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) as ip
  from (select event_id, case event_id % 5 when 0 then 167772160 + n % 16777216 when 1 then 3232235520 + n % 65536 when 2 then 3221225472 + n % 512 else n end as n from ip))
select event_id, ip from all_ip where n between 167772160 and 184549374 or n between 1681915904 and 1686110206 or n between 2886729728 and 2887778302
  or n between 3221225472 and 3221225726 or n between 3232235520 and 3232301054 or n between 3323068416 and 3323199486""")
def private_ip_filter(t):
    n = (F.col("event_id") * 7919 + F.col("user_id") * 104729) % 4294967296
    spread = (F.when(F.col("event_id") % 5 == 0, 167772160 + n % 16777216).when(F.col("event_id") % 5 == 1, 3232235520 + n % 65536)
              .when(F.col("event_id") % 5 == 2, 3221225472 + n % 512).otherwise(n))
    byte = lambda shift: F.shiftright("n", shift).bitwiseAND(255)
    ip = F.concat_ws(".", *[byte(s).cast("string") for s in (24, 16, 8, 0)])
    return (t.events.select("event_id", spread.cast("bigint").alias("n")).select("event_id", ip.alias("ip"))
            .filter(U.is_private_ip(F.col("ip"))))


@query("page_links", f"with {LINKS} select page_id, pos, link from internal")
def page_links(t):
    return K.page_links(t.pages).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query("resolve_link", rf"""
with p as (select page_id, url, generate_subscripts(x, 1) as form, unnest(x) as href, base from (select page_id, url,
    ['/a/b#c', 'rel/x', 'https://h.org/q#z', '?q=1', '#top'] as x, case page_id % 3 when 0 then '' when 1 then '/root/' else 'http://cdn.net/z' end as base from pages)),
b as (select *, rtrim(case when base = '' then {ROOT.format('url')} when starts_with(base, '/') then {ROOT.format('url')} || base else base end, '/') as bb from p)
select page_id, form, regexp_replace(case when starts_with(href, '/') then {ROOT.format('url')} || href
   when starts_with(href, 'http') then href else bb || '/' || href end, '#.*$', '') as link from b""")
def resolve_link(t):
    base = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, "/root/").otherwise("http://cdn.net/z")
    hrefs = F.array(*[F.lit(x) for x in ("/a/b#c", "rel/x", "https://h.org/q#z", "?q=1", "#top")])
    rows = t.pages.select("page_id", "url", base.alias("base"), F.posexplode(hrefs).alias("form", "href"))
    return rows.select("page_id", (F.col("form") + 1).cast("bigint").alias("form"),
                       U.resolve_link(F.col("url"), F.col("base"), F.col("href")).alias("link"))


@query("internal_links", f"with {MIXED_LINKS} select page_id, pos, link from internal")
def internal_links(t):
    return K.page_links(mixed(t)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query("external_links", rf"""with {MIXED_LINKS} select page_id, pos, link from links where starts_with(href, 'http')
  and regexp_extract({AUTH.format('link')}, '([^.]+\.[^.:]+)(:[0-9]+)?$', 1) <> regexp_extract({AUTH.format('url')}, '([^.]+\.[^.:]+)(:[0-9]+)?$', 1)""")
def external_links(t):
    return K.external_links(mixed(t)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query("skip_script_links", f"with {MIXED_LINKS} select page_id, pos, link from links where not starts_with(lower(href), 'javascript:')")
def skip_script_links(t):
    return K.skip_script_links(mixed(t)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query("same_site_links", f"""with {LINKS}, every as (select page_id, {ROOT.format('url')} as link, -1 as pos from pages
   union all select page_id, link, pos from links where contains(link, {ROOT.format('url')})),
  u as (select page_id, link, min(pos) as pos from every group by all)
  select page_id, link, row_number() over (partition by page_id order by pos) as rank from u
  qualify rank <= 5""")
def same_site_links(t):
    return K.same_site_links(t.pages, 5).select("page_id", "link", F.col("rank").cast("bigint").alias("rank"))


@query("path_filter", f"with {LINKS} select page_id, pos, link from internal where contains(url, '/en/')")
def path_filter(t):
    return K.page_links(t.pages.filter(F.col("url").contains("/en/"))).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query("html_only", "select page_id, length(html) as size from pages where regexp_matches(html, '(?i)^\\s*(<!doctype|<html)')")
def html_only(t):
    from webloom.sources.files import content_type
    return t.pages.withColumn("content_type", content_type(F.col("html"))).filter(
        F.col("content_type").startswith("text/html")).select("page_id", F.length("html").cast("bigint").alias("size"))


@query("link_graph", f"""with {MIXED_LINKS}, o as (select url, count(*) as out_degree from internal group by url),
  i as (select link as url, count(*) as in_degree from internal group by link), p as (select distinct url, true as fetched from pages)
  select coalesce(p.url, i.url) as url, coalesce(fetched, false) as fetched, coalesce(in_degree, 0) as in_degree, coalesce(out_degree, 0) as out_degree
  from p left join o on p.url = o.url full join i on p.url = i.url""")
def link_graph(t):
    return K.link_graph(mixed(t))


# Fetches answer 404 or 500 now and then; links are compared in canonical form.
CANON = r"""regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z]+://[^/?#]*')), ':(80)?$', '') || case when starts_with(regexp_extract({0}, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1), '/')
  then '' else '/' end || regexp_extract({0}, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1)"""


@query("broken_links", f"""with {MIXED_LINKS}, a as (select {CANON.format('url')} as link,
    max(case when page_id % 7 = 0 then 404 when page_id % 11 = 0 then 500 else 200 end) as status from pages group by all),
  l as (select {CANON.format('link')} as link, count(*) as in_degree from internal group by all)
  select link, in_degree, status from l left join a using (link) where status is null or status >= 400""")
def broken_links(t):
    status = F.when(F.col("page_id") % 7 == 0, 404).when(F.col("page_id") % 11 == 0, 500).otherwise(200)
    return K.broken_links(mixed(t), t.pages.select("url", status.alias("status")))


@query("new_urls", f"with {LINKS} select distinct link as url from internal where link not in (select url from pages where page_id % 2 = 0)")
def new_urls(t):
    found = K.page_links(t.pages).select(F.col("link").alias("url"))
    return K.new_urls(found, t.pages.filter("page_id % 2 = 0"))


# Pages of one host see each other through a shared sitemap, so the graph has more than one hop.
EDGES = rf"""e as (select url, link from internal union select link, url from internal
  union select a.url, b.url from (select url, {AUTH.format('url')} as h, row_number() over (partition by {AUTH.format('url')} order by url) as n from pages) a
  join (select url, {AUTH.format('url')} as h, row_number() over (partition by {AUTH.format('url')} order by url) as n from pages) b on a.h = b.h and b.n = a.n + 1)"""


def site_edges(t):
    from webloom.operators.ordered import ordinal
    internal = K.page_links(t.pages).select("url", "link")
    numbered = ordinal(t.pages.select("url", U.authority(F.col("url")).alias("host")), ["url"], "n", by=["host"])
    following = numbered.select("host", (F.col("n") - 1).alias("n"), F.col("url").alias("link"))
    onward = numbered.join(following, ["host", "n"]).select("url", "link")
    return internal.unionByName(internal.select(F.col("link").alias("url"), F.col("url").alias("link"))).unionByName(onward)


@query("crawl_depth", f"""with recursive {LINKS}, {EDGES}, s as (select url from pages where page_id % 10 = 0),
  r as (select url, 0 as depth from s union select e.link, r.depth + 1 from r join e on r.url = e.url where r.depth < 4)
  select url, min(depth) as depth from r group by url""")
def crawl_depth(t):
    return K.crawl_depth(t.pages.filter("page_id % 10 = 0"), site_edges(t), 4)


@query("union_all_sources", f"with {LINKS} select link as url from internal union all select url from pages")
def union_all_sources(t):
    return K.page_links(t.pages).select(F.col("link").alias("url")).unionByName(t.pages.select("url"))


@query("symmetric_difference", """with a as (select c_custkey + 100 as k from customer), b as (select o_custkey as k from orders)
  select k, 'left' as side from a where k not in (select k from b) union all select k, 'right' from b where k not in (select k from a)""")
def symmetric_difference(t):
    return K.symmetric_difference(t.customer.select((F.col("c_custkey") + 100).alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k")


@query("membership", """select l_orderkey, l_linenumber, l_returnflag in ('A', 'R') as listed,
  list_contains([1, 3, 5], l_linenumber) as odd from lineitem""")
def membership(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").isin("A", "R").alias("listed"),
                             F.array_contains(F.array(F.lit(1), F.lit(3), F.lit(5)), F.col("l_linenumber")).alias("odd"))


@query("site_dimension_join", rf"""with p as (select page_id, regexp_extract({AUTH.format('url')}, '([^.]+\.[^.:]+)(:[0-9]+)?$', 1) as domain,
   regexp_replace({AUTH.format('url')}, ':[0-9]*$', '') as host from pages),
  d as (select domain, count(*) as pages, count(distinct host) as hosts from p group by domain)
  select page_id, domain, pages, hosts from p join d using (domain)""")
def site_dimension_join(t):
    pages = t.pages.select("page_id", "url", U.registered_domain(F.col("url")).alias("domain"))
    return lookup(pages, K.site_dimension(t.pages), "domain", spread_on="page_id").select("page_id", "domain", "pages", "hosts")


@query("redirected_template_url_join", """select c_custkey, t as template, case t when 0 then 'http://a.example.com/' || c_nationkey || '?q=' || url_encode(c_name)
   else 'http://b.example.com/' || lower(c_mktsegment) || '/' || c_custkey end as url from customer, (select unnest([0, 1]) as t)""")
def template_join(t):
    params = {"nation": F.col("c_nationkey").cast("string"), "name": F.col("c_name"), "seg": F.lower("c_mktsegment"),
              "key": F.col("c_custkey").cast("string")}
    templates = ("http://a.example.com/{{nation}}?q={{name}}", "http://b.example.com/{{seg}}/{{key}}")
    filled = F.array(*[T.fill_template(x, params) for x in templates])
    return t.customer.select("c_custkey", F.posexplode(filled).alias("template", "url"))


@query("upsert_dimension", """with d as (select distinct upper(p_type) as name from part where p_size <= 2 or p_type like 'E%'),
   n as (select p_type || ' ' || p_brand as name from part union all select p_type from part)
   select name from d union all select min(name) from n where lower(name) not in (select lower(name) from d) group by lower(name)""")
def upsert_dimension(t):
    known = t.part.filter("p_size <= 2 or p_type like 'E%'").select(F.upper("p_type").alias("name")).distinct()
    incoming = t.part.select(F.concat_ws(" ", "p_type", "p_brand").alias("name")).unionByName(t.part.select(F.col("p_type").alias("name")))
    return K.upsert_dimension(known, incoming, "name")


@query("sort_by_url", "select row_number() over (order by url) as position, url from pages")
def sort_by_url(t):
    from webloom.operators.ordered import ordinal
    return ordinal(t.pages.select("url"), ["url"], "position").select("position", "url")
