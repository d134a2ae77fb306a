"""Streaming jobs drained over the tables, checked against their batch results."""

from pyspark.sql import functions as F

from webloom.operators import fetchlog as L
from webloom.operators import links as K
from webloom.operators import terms as W
from webloom.operators.parallel import apply_parallel
from webloom.plans.fetch_plans import LOG
from webloom.plans.registry import query
from webloom.plans.search_plans import DICT, dictionary
from webloom.plans.url_plans import LINKS
from webloom.streaming import jobs as S


#: Rows come up to DISORDER minutes late, and the jobs wait DELAY for them. A watermark counts whole milliseconds.
DISORDER, DELAY = 40, "1 hour"
PASSED = "{} <= (select max(epoch_us(ts)) // 1000 - 3600000 from events) * 1000"


def stamped(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_frontier", f"with {LINKS} select distinct link as url from internal")
def stream_frontier(t):
    urls = K.page_links(t.pages).select("page_id", F.col("link").alias("url"))
    return S.drain(S.frontier(S.as_stream(urls, "page_id"))).select("url")


@query("stream_frontier_bounded", """with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as before from events)
  select 'http://site.example.com/' || user_id as url from e where before is null""")
def stream_frontier_bounded(t):
    """With a bound longer than the stream every URL comes out once, whatever batch it first comes in."""
    visits = stamped(t).select("ts", "event_id", F.concat(F.lit("http://site.example.com/"), "user_id").alias("url"))
    parts = S.jittered(visits, "ts", "event_id", DISORDER)
    return S.steps(parts, lambda s: S.bounded_frontier(s.select("ts", "url"), "400 days")).select("url")


@query("stream_statistics", f"""with {LOG}, snap as (select site, event_id, ended, count(*) over w as requests,
  count(*) filter (status between 200 and 399) over w as successes,
  cast(sum(size) filter (status <> 0) over w // nullif(count(*) filter (status <> 0) over w, 0) as bigint) as avg_size,
  cast(sum(ended - started) filter (status <> 0) over w // nullif(count(*) filter (status <> 0) over w, 0) as bigint) as avg_time,
  round(count(*) over w * 1e6::double / nullif(max(ended) filter (status <> 0) over w - min(started) filter (status <> 0) over w, 0), 6) as per_second
  from log window w as (partition by site order by ended, event_id rows unbounded preceding))
  select * from snap where {PASSED.format('ended')}""")
def stream_statistics(t):
    """A snapshot per fetch, from four batches that overlap in time; the last hour waits for the watermark."""
    parts = S.jittered(L.fetch_log(t.events).withColumn("at", F.timestamp_micros("ended")), "at", "event_id", DISORDER)
    return S.steps(parts, lambda s: S.statistics(s, DELAY)).withColumn("per_second", F.round("per_second", 6))


@query("stream_rate", "select epoch_us(date_trunc('hour', ts)) as start, count(*) as requests from events group by all")
def stream_rate(t):
    parts = S.jittered(stamped(t).select("ts", "event_id"), "ts", "event_id", DISORDER)
    counts = S.newest(S.steps(parts, lambda s: S.rate(s.select("ts"), "1 hour", DELAY), "update"), ["start"])
    return counts.select(F.unix_micros("start").alias("start"), "requests")


@query("stream_idle_sessions", f"""with e as (select user_id % 10 as site, epoch_us(ts) as u, lag(epoch_us(ts)) over (partition by user_id % 10 order by ts, event_id) as p from events),
  g as (select site, u, sum(case when p is null or u - p >= 1800000000 then 1 else 0 end) over (partition by site order by u rows unbounded preceding) as s from e)
  select site, min(u) as start, max(u) + 1800000000 as "end", count(*) as requests from g group by site, s having {PASSED.format('max(u) + 1800000000')}""")
def stream_idle_sessions(t):
    events = stamped(t).select("ts", "event_id", (F.col("user_id") % 10).alias("site"))
    parts = S.jittered(events, "ts", "event_id", DISORDER)
    found = S.steps(parts, lambda s: S.idle_sessions(s.drop("event_id"), "30 minutes", DELAY, ["site"]))
    return found.select("site", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "requests")


@query("stream_ttl_cache", f"""with recursive e as (select user_id as key, event_id as id, epoch_us(ts) as u, value, row_number() over (partition by user_id order by ts, event_id) as n from events),
  r as (select key, id, u, false as served, value as result, u as made, n from e where n = 1
    union all select e.key, e.id, e.u, e.u - r.made <= 3600000000, case when e.u - r.made <= 3600000000 then r.result else e.value end,
      case when e.u - r.made <= 3600000000 then r.made else e.u end, e.n from r join e on e.key = r.key and e.n = r.n + 1)
  select key, id, served, result from r where {PASSED.format('u')}""")
def stream_ttl_cache(t):
    requests = stamped(t).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", "value")
    parts = S.jittered(requests, "ts", "id", DISORDER)
    return S.steps(parts, lambda s: S.ttl_cache(s, 3600, DELAY)).select("key", "id", "served", "result")


@query("stream_page_results", """select event_id, case when event_id % 7 <> 0 then cast(json_extract(props, '$.k') as int) end as k, event_id % 7 = 0 as failed from events""")
def stream_page_results(t):
    body = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{oops"), "props")).otherwise(F.col("props"))
    pages = t.events.select("event_id", body.alias("body"))
    read = lambda batch: batch.select("event_id", F.try_variant_get(F.try_parse_json("body"), "$.k", "int").alias("k"))
    results, errors = S.page_results(S.as_stream(pages, "event_id"), read, "k is not null")
    return results.withColumn("failed", F.lit(False)).unionByName(errors.withColumn("failed", F.lit(True)))


@query("stream_measures", """select event_type as measure, count(*) as n, round(sum(value), 6) as total, min(value) as low, max(value) as high,
  arg_max(value, event_id) as last, max(event_id) as iteration from events group by event_type""")
def stream_measures(t):
    """The newest version of the totals that the running job publishes after every batch."""
    values = t.events.select(F.col("event_type").alias("measure"), F.col("event_id").alias("iteration"), "value")
    place = S.folder(t.spark, "measures")
    S.steps([values.filter(F.col("iteration") % 3 == k) for k in range(3)], S.measure_totals, "update", sink=S.published(place, "measure"))
    return S.current(t.spark, place).withColumn("total", F.round("total", 6))


@query("stream_enrich", f"with {DICT} select distinct page_id, category from pages join dict on contains(lower(url), keyword)")
def stream_enrich(t):
    known = dictionary(t)
    return S.enrich(S.as_stream(t.pages.select("page_id", "url"), "page_id"), lambda b: W.keyword_categories(b, known, "page_id", "url"))


@query("apply_parallel", "select o_orderkey, round(o_totalprice * 1.1::double, 4) as gross from orders")
def apply_parallel_query(t):
    return apply_parallel(t.orders.select("o_orderkey", "o_totalprice"), lambda p: p.assign(gross=p.o_totalprice * 1.1)[["o_orderkey", "gross"]],
                          "o_orderkey bigint, gross double").withColumn("gross", F.round("gross", 4))
