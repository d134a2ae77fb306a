"""Statistics over a log of fetched pages.

Log columns: site, event_id, url-independent facts (status, size, content_type) and
start/end clock readings in microseconds. Status 0 marks a fetch that never got an
answer: it counts as a failure and stays out of time bounds and averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.ordered import running

def fetch_log(events: DataFrame) -> DataFrame:
    """The events table read as a fetch log."""
    k = F.get_json_object("props", "$.k").cast("int")
    ended = F.unix_micros(F.col("ts").cast("timestamp"))
    status = (
        F.when((F.col("event_type") == "error") & (k < 10), 0)
        .when((F.col("event_type") == "error") & (k < 30), 404)
        .when((F.col("event_type") == "error") & (k < 50), 403)
        .when(F.col("event_type") == "error", 500)
        .when(F.col("event_type") == "signup", 301)
        .otherwise(200))
    return events.select(
        (F.col("user_id") % 10).alias("site"), "event_id",
        (ended - F.floor(F.col("value") * 1000)).alias("started"), ended.alias("ended"),
        status.alias("status"), F.floor(F.col("value") * 100).alias("size"),
        F.col("event_type").alias("content_type"))


def is_success(status: Column) -> Column:
    return status.between(200, 399)


def answered(value: Column) -> Column:
    return F.when(F.col("status") != 0, value)


def rate(count: Column, started: Column, ended: Column) -> Column:
    """Per second; NULL when no time has passed."""
    return F.try_divide(count * 1e6, (ended - started).cast("double"))


def summary_columns() -> list[Column]:
    start, end = F.min(answered(F.col("started"))), F.max(answered(F.col("ended")))
    spent = answered(F.col("ended") - F.col("started"))
    served = F.count(answered(F.col("size")))
    return [
        F.count("*").alias("requests"),
        F.count_if(is_success(F.col("status"))).alias("successes"),
        F.count_if(~is_success(F.col("status"))).alias("failures"),
        F.sum("size").alias("total_size"),
        F.expr("try_divide(sum(if(status <> 0, size, null)) - pmod(sum(if(status <> 0, size, null)), "
               "count(if(status <> 0, size, null))), count(if(status <> 0, size, null)))").cast("bigint").alias("avg_size"),
        F.floor(F.sum(spent) / served).alias("avg_time"),
        start.alias("first_start"), end.alias("last_end"),
    ]


def fetch_summary(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals, averages and time bounds of the log, overall or per key."""
    return log.groupBy(*by).agg(*summary_columns())


def requests_per_second(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return log.groupBy(*by).agg(
        rate(F.count("*"), F.min(answered(F.col("started"))), F.max(answered(F.col("ended")))).alias("per_second"))


def running_snapshots(log: DataFrame) -> DataFrame:
    """State of each site's statistics right after every fetch."""
    one = lambda cond: F.when(cond, 1).otherwise(0).cast("bigint")
    state = running(log, ["ended", "event_id"], {
        "requests": ("sum", F.lit(1).cast("bigint")),
        "successes": ("sum", one(is_success(F.col("status")))),
        "served": ("sum", one(F.col("status") != 0)),
        "bytes": ("sum", F.coalesce(answered(F.col("size")), F.lit(0))),
        "spent": ("sum", F.coalesce(answered(F.col("ended") - F.col("started")), F.lit(0))),
        "first_start": ("min", answered(F.col("started"))),
        "last_end": ("max", answered(F.col("ended"))),
    }, by=["site"])
    whole = lambda total: F.floor(F.try_divide(F.col(total), F.col("served")))
    return state.select(
        "site", "event_id", "ended", "requests", "successes", whole("bytes").alias("avg_size"), whole("spent").alias("avg_time"),
        rate(F.col("requests"), F.col("first_start"), F.col("last_end")).alias("per_second"))


def running_status_map(log: DataFrame) -> DataFrame:
    """Requests so far by status, as a map, at every fetch of a site.

    The statuses are those that the log holds, found in one pass; a site's map has the
    statuses it has met by then. A null status is counted under -1.
    """
    log = log.select("site", "event_id", "ended", "status", F.coalesce("status", F.lit(-1)).alias("_met"))
    statuses = sorted(r["_met"] for r in log.select("_met").distinct().collect())
    counted = running(log, ["ended", "event_id"], {
        f"_n_{k}": ("sum", (F.col("_met") == status).cast("bigint")) for k, status in enumerate(statuses)}, by=["site"])
    entries = F.array(*[F.struct(F.lit(status).alias("status"), F.col(f"_n_{k}").alias("n")) for k, status in enumerate(statuses)])
    met = F.map_from_entries(F.filter(entries, lambda e: e["n"] > 0)) if statuses else F.expr("cast(map() as map<int, bigint>)")
    return counted.select("site", "event_id", "ended", "status", met.alias("requests_by_status"))


def latest_messages(messages: DataFrame, n: int, order: list[str], text: str, by: list[str] | None = None) -> DataFrame:
    """(by, pos, message): last ``n`` messages of each key in order, padded with blanks in front when there are fewer.

    Every task passes on its last ``n`` of a key alone, so a busy key costs no more than others. Without
    ``by`` the whole table is one key, also when it is empty.
    """
    if n < 0:
        raise ValueError("the count cannot be negative")
    by, spark = by or [], messages.sparkSession
    rows = messages.select(*by, *order, text)
    back = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*[F.desc(c) for c in order])
    last = rows.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n).select(
        *by, (F.lit(n + 1) - F.col("_back")).cast("bigint").alias("pos"), F.col(text).alias("_message"))
    places = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))) if n else F.explode(F.array().cast("array<bigint>"))
    keys = messages.select(*by).distinct() if by else spark.range(1).select()
    wanted = keys.select(*by, places.alias("pos"))
    return wanted.join(last, [*by, "pos"], "left").select(*by, "pos", F.coalesce("_message", F.lit("")).alias("message"))
