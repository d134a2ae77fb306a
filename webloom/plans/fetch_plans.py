"""Fetch-log statistics over the events table."""

from pyspark.sql import functions as F

from webloom.operators import fetchlog as L
from webloom.operators.ordered import ordinal, running, runs, split_on_marker
from webloom.plans.registry import query

LOG = """log as (select user_id % 10 as site, event_id, epoch_us(ts) - cast(floor(value * 1000) as bigint) as started, epoch_us(ts) as ended,
  case when event_type = 'error' and cast(json_extract(props, '$.k') as int) < 10 then 0
       when event_type = 'error' and cast(json_extract(props, '$.k') as int) < 30 then 404
       when event_type = 'error' and cast(json_extract(props, '$.k') as int) < 50 then 403 when event_type = 'error' then 500
       when event_type = 'signup' then 301 else 200 end as status,
  cast(floor(value * 100) as bigint) as size, event_type as content_type from events)"""
SUMMARY = """count(*) as requests, count(*) filter (status between 200 and 399) as successes,
  count(*) filter (status not between 200 and 399) as failures, cast(sum(size) as bigint) as total_size,
  cast(sum(size) filter (status <> 0) // count(*) filter (status <> 0) as bigint) as avg_size,
  cast(sum(ended - started) filter (status <> 0) // count(*) filter (status <> 0) as bigint) as avg_time,
  min(started) filter (status <> 0) as first_start, max(ended) filter (status <> 0) as last_end"""


@query("fetch_summary", f"with {LOG} select {SUMMARY} from log")
def fetch_summary(t):
    return L.fetch_summary(L.fetch_log(t.events))


@query("site_fetch_summary", f"with {LOG} select site, {SUMMARY} from log group by site")
def site_fetch_summary(t):
    return L.fetch_summary(L.fetch_log(t.events), ("site",))


@query("success_filter", f"with {LOG} select event_id, status from log where status between 200 and 399")
def success_filter(t):
    return L.fetch_log(t.events).filter(L.is_success(F.col("status"))).select("event_id", "status")


@query("requests_by_status", f"with {LOG} select status, count(*) as n from log group by status")
def requests_by_status(t):
    return L.fetch_log(t.events).groupBy("status").agg(F.count("*").alias("n"))


@query("requests_by_content_type", f"with {LOG} select content_type, count(*) as n from log group by content_type")
def requests_by_content_type(t):
    return L.fetch_log(t.events).groupBy("content_type").agg(F.count("*").alias("n"))


@query("requests_per_second", f"""with {LOG} select site, round(count(*) * 1e6::double / (max(ended) filter (status <> 0)
  - min(started) filter (status <> 0)), 9) as per_second from log group by site""")
def requests_per_second(t):
    return L.requests_per_second(L.fetch_log(t.events), ("site",)).withColumn("per_second", F.round("per_second", 9))


@query("running_snapshots", f"""with {LOG} select site, event_id, ended, count(*) over w as requests,
  count(*) filter (status between 200 and 399) over w as successes,
  cast(sum(size) filter (status <> 0) over w // nullif(count(*) filter (status <> 0) over w, 0) as bigint) as avg_size,
  cast(sum(ended - started) filter (status <> 0) over w // nullif(count(*) filter (status <> 0) over w, 0) as bigint) as avg_time,
  round(count(*) over w * 1e6::double / nullif(max(ended) filter (status <> 0) over w - min(started) filter (status <> 0) over w, 0), 6) as per_second
  from log window w as (partition by site order by ended, event_id rows unbounded preceding)""")
def running_snapshots(t):
    return L.running_snapshots(L.fetch_log(t.events)).withColumn("per_second", F.round("per_second", 6))


@query("running_status_map", f"""with {LOG}, met as (select site, event_id, ended, status, list(status) over (partition by site order by ended, event_id
    rows unbounded preceding) as l from log)
  select site, event_id, ended, status, array_to_string(list_transform(list_sort(list_distinct(l)),
    lambda s: s || ':' || len(list_filter(l, lambda x: x = s))), ' ') as requests_by_status from met""")
def running_status_map(t):
    entry = lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("requests_by_status")), entry), " ")
    return L.running_status_map(L.fetch_log(t.events)).withColumn("requests_by_status", told)


@query("elapsed_since_first", f"with {LOG} select event_id, ended - (select min(ended) from log) as elapsed from log")
def elapsed_since_first(t):
    log = L.fetch_log(t.events)
    first = log.agg(F.min("ended")).scalar()
    return log.select("event_id", (F.col("ended") - first).alias("elapsed"))


@query("last_snapshot", f"""with {LOG} select count(*) as requests, arg_max(event_id, (ended, event_id)) as event_id,
  arg_max(status, (ended, event_id)) as status, max(ended) as ended from log""")
def last_snapshot(t):
    last = F.max_by(F.struct("event_id", "status", "ended"), F.struct("ended", "event_id"))
    return L.fetch_log(t.events).agg(F.count("*").alias("requests"), last.alias("s")).select(
        "requests", "s.event_id", "s.status", "s.ended")


MESSAGE = "content_type || ' ' || status"


@query("latest_messages", f"""with {LOG}, tail as (select *, row_number() over (partition by site order by ended desc, event_id desc) as back from log)
  select s.site, p.pos, coalesce(content_type || ' ' || status, '') as message
  from (select distinct site from log) s, (select unnest(range(1, 1101)) as pos) p left join tail on tail.back = 1101 - p.pos and tail.site = s.site""")
def latest_messages(t):
    """The last lines of every site; more are asked for than some sites have, so their front is padded."""
    log = L.fetch_log(t.events).withColumn("message", F.concat_ws(" ", "content_type", "status"))
    return L.latest_messages(log, 1100, ["ended", "event_id"], "message", by=["site"])


@query("split_on_marker", f"""with {LOG} select site, event_id, cast(coalesce(sum(case when content_type = 'signup' then 1 else 0 end) over
  (partition by site order by ended, event_id rows unbounded preceding), 0) as bigint) as part from log""")
def split_sequence(t):
    log = L.fetch_log(t.events).select("site", "event_id", "ended", "content_type")
    return split_on_marker(log, ["ended", "event_id"], F.col("content_type") == "signup", ["site"]).select("site", "event_id", "part")


@query("runs", f"""with {LOG}, g as (select *, row_number() over (partition by site order by ended, event_id)
    - row_number() over (partition by site, status = 200 order by ended, event_id) as island from log)
  select site, arg_min(event_id, (ended, event_id)) as first_id, arg_max(event_id, (ended, event_id)) as last_id, count(*) as size
  from g where status = 200 group by site, island""")
def consecutive_runs(t):
    found = runs(L.fetch_log(t.events), ["ended", "event_id"], F.col("status") == 200, ["site"])
    return found.select("site", F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"), "size")


@query("nth_record", f"""with {LOG}, r as (select site, event_id, row_number() over (partition by site order by ended, event_id) as n,
   row_number() over (partition by site order by ended desc, event_id desc) as back from log)
  select site, max(event_id) filter (n = 3) as third, max(event_id) filter (back = 2) as second_last from r group by site""")
def nth_record(t):
    log = L.fetch_log(t.events).select("site", "ended", "event_id")
    numbered = running(log, ["ended", "event_id"], {"n": ("sum", F.lit(1).cast("bigint"))}, ["site"])
    counts = log.groupBy("site").agg(F.count("*").alias("total"))
    return numbered.join(counts, "site").groupBy("site").agg(
        F.max(F.when(F.col("n") == 3, F.col("event_id"))).alias("third"),
        F.max(F.when(F.col("n") == F.col("total") - 1, F.col("event_id"))).alias("second_last"))


@query("paginate", """with o as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as n from orders)
  select cast((n - 50) // 100 as bigint) as page, o_orderkey, o_totalprice from o where n >= 50 and n < 50 + 100 * 20""")
def paginate(t):
    """Twenty pages of a hundred rows after the first fifty, in key order."""
    offset, size, pages = 50, 100, 20
    window = t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(offset).limit(size * pages)
    return ordinal(window, ["o_orderkey"], "n").select(
        F.expr(f"(n - 1) div {size}").alias("page"), "o_orderkey", "o_totalprice")


@query("period_bounds", """with e as (select event_id, ts from events)
  select event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') as minute_start,
   strftime(date_trunc('hour', ts) + interval 1 hour - interval 1 microsecond, '%Y-%m-%d %H:%M:%S.%f') as hour_end,
   strftime(date_trunc('week', ts + interval 1 day) - interval 1 day, '%Y-%m-%d') as week_start_sunday,
   strftime(date_trunc('week', ts) + interval 7 day - interval 1 microsecond, '%Y-%m-%d %H:%M:%S.%f') as week_end_monday,
   strftime(date_trunc('month', ts) + interval 1 month - interval 1 microsecond, '%Y-%m-%d %H:%M:%S.%f') as month_end,
   strftime(date_trunc('quarter', ts), '%Y-%m-%d') as quarter_start, strftime(date_trunc('year', ts), '%Y-%m-%d') as year_start from e""")
def period_bounds(t):
    from webloom.functions import dates as D
    ts = F.col("ts").cast("timestamp")
    full = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.events.select(
        "event_id", F.date_format(D.period_start(ts, "minute"), "yyyy-MM-dd HH:mm:ss").alias("minute_start"),
        full(D.period_end(ts, "hour")).alias("hour_end"), day(D.period_start(ts, "week", "sunday")).alias("week_start_sunday"),
        full(D.period_end(ts, "week", "monday")).alias("week_end_monday"), full(D.period_end(ts, "month")).alias("month_end"),
        day(D.period_start(ts, "quarter")).alias("quarter_start"), day(D.period_start(ts, "year")).alias("year_start"))
