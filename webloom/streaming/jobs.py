"""Structured Streaming versions of the crawl and classification jobs.

Each function maps a streaming DataFrame to a streaming DataFrame; ``drain`` runs one to
the end of the available input and returns the written table. State is keyed and lives in
the state store; results go to files, never through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from webloom.operators.fetchlog import is_success
from webloom.operators.spread import spread
from webloom.session import shared_dir
from webloom.streaming.ordered import in_order


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_stream(df: DataFrame, key: str, batches: int = 4) -> DataFrame:
    """A table replayed as a stream of files in about ``batches`` micro-batches.

    The table is written by as many tasks as it has partitions. Files of one write have no
    promised order, so jobs that drop late rows use ``steps`` instead.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, "stream")
    spread(df, key).write.parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Beyond every time in microseconds.
NEVER = 2**62

#: State partitions of a job. They are fixed when it first runs, so they must not follow the cluster of the day.
STATE_PARTITIONS = 16


def run_to_end(stream: DataFrame, out: str, state: str, mode: str = "append", partitions: int = STATE_PARTITIONS,
               sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what has arrived since the last run on the same ``state`` folder, then stop.

    State is kept in RocksDB, on the executors' disks rather than their heaps. The settings are
    those of a session of its own; the caller's stay as they are.
    """
    spark = stream.sparkSession
    settings = {PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
                "spark.sql.shuffle.partitions": str(partitions)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    if sink is not None:
        writer = stream.writeStream.foreachBatch(sink)
    elif mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        writer = stream.writeStream.foreachBatch(
            lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}"))
    try:
        running = writer.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    finally:  # a started query has its own copy
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    running.awaitTermination()


def drain(stream: DataFrame, mode: str = "append", partitions: int = STATE_PARTITIONS) -> DataFrame:
    """Process what is there and return the result table; ``update`` results carry ``batch``."""
    spark = stream.sparkSession
    out, state = folder(spark, "sink"), folder(spark, "state")
    run_to_end(stream, out, state, mode, partitions)
    return spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", IntegerType())).parquet(out)


def jittered(df: DataFrame, time: str, tie: str, minutes: int, batches: int = 4) -> list[DataFrame]:
    """A table in ``batches`` parts as it might arrive: by ``time``, rows up to ``minutes`` too late."""
    at = F.unix_micros(time)
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        return [df]
    arrival = at + F.pmod(F.xxhash64(tie), F.lit(max(1, minutes * 60_000_000)))
    part = F.least(F.floor((arrival - low) * batches / (high - low + 1)), F.lit(batches - 1))
    return [df.filter(part == k) for k in range(batches)]


def steps(parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], mode: str = "append", partitions: int = STATE_PARTITIONS,
          sink: Callable[[DataFrame, int], None] | None = None, between: Callable[[int], None] | None = None) -> DataFrame | None:
    """Feed a job one part after the other, each in a run that picks up the state of the run before.

    Returns the result table (none if a ``sink`` takes the batches); ``between`` is called after each run.
    """
    spark, schema = parts[0].sparkSession, parts[0].schema
    source, out, state = (folder(spark, name) for name in ("stream", "sink", "state"))
    for number, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        result = job(spark.readStream.schema(schema).parquet(source))
        run_to_end(result, out, state, mode, partitions, sink)
        if between is not None:
            between(number)
    if sink is not None:
        return None
    return spark.read.schema(result.schema if mode == "append" else result.schema.add("batch", IntegerType())).parquet(out)


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last update of every key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch", "part")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")


def frontier(urls: DataFrame) -> DataFrame:
    """Every URL once, whatever was seen before. The state grows with the distinct URLs."""
    return urls.dropDuplicates(["url"])


def bounded_frontier(urls: DataFrame, delay: str) -> DataFrame:
    """Every URL once per ``delay`` of event time; state older than that is dropped, so a URL
    that comes back later is emitted again."""
    return urls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])


def statistics(log: DataFrame, delay: str) -> DataFrame:
    """State of each site's statistics right after every fetch, like the batch ``running_snapshots``.

    Fetches are taken in the order of ``ended`` (``ts`` as a timestamp), equal ones by event_id; a fetch comes out once
    the watermark has passed it.
    """
    def step(total: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, list]:
        n, good, served, size, spent, first, last = total
        status, started, ended = rows["status"], rows["started"], rows["ended"]
        answered = status != 0
        n = n + np.arange(1, len(status) + 1)
        good = good + np.cumsum((status >= 200) & (status <= 399))
        before, served = served, served + np.cumsum(answered)
        size = size + np.cumsum(np.where(answered, rows["size"], 0))
        spent = spent + np.cumsum(np.where(answered, ended - started, 0))
        low, high = np.where(answered, started, NEVER), np.where(answered, ended, -NEVER)
        if before:
            low[0], high[0] = min(low[0], first), max(high[0], last)
        low, high = np.minimum.accumulate(low), np.maximum.accumulate(high)
        none, some = served == 0, np.maximum(served, 1)
        whole = lambda v: np.where(none, None, v // some)
        timed = ~none & (high > low)
        per_second = np.where(timed, n * 1e6 / np.where(timed, high - low, 1), np.nan)
        first, last = (low[-1], high[-1]) if served[-1] else (first, last)
        end = tuple(int(v) for v in (n[-1], good[-1], served[-1], size[-1], spent[-1], first, last))
        return end, [rows["event_id"], ended, n, good, whole(size), whole(spent), per_second]

    rows = log.select("site", F.timestamp_micros("ended").alias("ts"), "event_id", "started", "ended", "status", "size")
    return in_order(rows, ["site"], "ts", "event_id", delay, step, (0,) * 7,
                    "n long, good long, served long, size long, spent long, first long, last long",
                    "event_id long, ended long, requests long, successes long, avg_size long, avg_time long, per_second double")


def rate(events: DataFrame, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Requests per tumbling window. Rows later than ``delay`` are dropped."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", window)).agg(F.count("*").alias("requests"))
    return counted.select(F.col("window.start").alias("start"), "requests")


def idle_sessions(events: DataFrame, gap: str, delay: str, by: list[str]) -> DataFrame:
    """Stretches without a pause of ``gap``; a session is emitted once the watermark passed it."""
    sessions = events.withWatermark("ts", delay).groupBy(*by, F.session_window("ts", gap)).agg(F.count("*").alias("requests"))
    return sessions.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "requests")


def ttl_cache(requests: DataFrame, ttl_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(key, id, ts, served, result): a stored result answers while it is at most ``ttl`` old,
    else the request's own value is stored. Input: key, id, ts, value.

    Requests are answered in event time, equal times by id, once the watermark has passed them. A key's
    result leaves the state when the watermark has passed its time to live.
    """
    ttl = ttl_seconds * 1_000_000

    def step(stored: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, list]:
        at, result = stored
        now, value = rows["ts"], rows["value"].astype(float)
        served, results = np.zeros(len(now), bool), np.empty(len(now))
        place = 0
        while place < len(now):
            if at >= 0 and now[place] - at <= ttl:
                until = int(np.searchsorted(now, at + ttl, "right"))
                served[place:until] = True
            else:
                at, result, until = int(now[place]), float(value[place]), place + 1
            results[place:until] = result
            place = until
        return (at, result), [rows["id"], now.astype("datetime64[us]"), served, results]

    return in_order(requests.select("key", "ts", "id", "value"), ["key"], "ts", "id", delay, step, (-1, 0.0), "at long, result double",
                    "id long, ts timestamp, served boolean, result double", lives=lambda stored: stored[0] + ttl)


def measure_totals(values: DataFrame) -> DataFrame:
    """Running totals of (measure, iteration, value): count, sum, bounds and the value of the last iteration."""
    return values.groupBy("measure").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.max_by("value", "iteration").alias("last"), F.max("iteration").alias("iteration"))


def published(place: str, key: str) -> Callable[[DataFrame, int], None]:
    """A sink that merges every batch's updated rows into a table with a version per batch.

    Readers take the newest finished version at any time; a batch that is repeated writes its own version
    again, from the version before it, so nothing counts twice.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        older = newest_version(spark, place, below=number)
        if older is not None:
            old = spark.read.parquet(f"{place}/version={older}")
            batch = old.join(batch.select(key), key, "left_anti").unionByName(batch)
        batch.write.mode("overwrite").parquet(f"{place}/version={number}")

    return merge


def newest_version(spark: SparkSession, place: str, below: int | None = None) -> int | None:
    """Number of the newest finished version of a published table."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    found = [(s.getPath(), s.getPath().getName()) for s in files.listStatus(path)]
    done = [int(name.split("=")[1]) for at, name in found if name.startswith("version=") and files.exists(at.suffix("/_SUCCESS"))]
    return max((n for n in done if below is None or n < below), default=None)


def current(spark: SparkSession, place: str) -> DataFrame | None:
    """What a published table holds now; none before its first version."""
    version = newest_version(spark, place)
    return None if version is None else spark.read.parquet(f"{place}/version={version}")


def page_results(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], good: str) -> tuple[DataFrame, DataFrame]:
    """Results and errors of a page stream as two tables: a failed page is counted, not fatal.

    ``extract`` turns a batch into rows; those for which ``good`` does not hold are errors.
    """
    spark = stream.sparkSession
    results, errors, state = folder(spark, "results"), folder(spark, "errors"), folder(spark, "state")

    def write(batch: DataFrame, number: int) -> None:
        # One folder per batch number: a repeated batch replaces its own rows.
        rows = extract(batch).persist()
        rows.filter(good).write.mode("overwrite").parquet(f"{results}/part={number}")
        rows.filter(f"not coalesce({good}, false)").write.mode("overwrite").parquet(f"{errors}/part={number}")
        rows.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(results).drop("part"), spark.read.parquet(errors).drop("part")


def enrich(stream: DataFrame, per_batch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every micro-batch joined with static tables by a batch job."""
    spark = stream.sparkSession
    out, state = folder(spark, "enriched"), folder(spark, "state")
    write = lambda batch, number: per_batch(batch).write.mode("overwrite").parquet(f"{out}/part={number}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("part")
