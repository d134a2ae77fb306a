"""Streaming jobs over several out-of-order batches against row-by-row versions."""

import datetime
import random

from pyspark.sql import functions as F

from webloom.streaming import jobs as S

START = datetime.datetime(2024, 1, 1)


def moment(minute):
    return START + datetime.timedelta(minutes=minute)


def requests(spark, rows):
    return spark.createDataFrame([(k, moment(m), i, float(v)) for k, m, i, v in rows], "key long, ts timestamp, id long, value double")


def cached(rows, ttl):
    held, out = {}, []
    for key, minute, i, value in sorted(rows, key=lambda r: (r[1], r[2])):
        at, result = held.get(key, (None, None))
        served = at is not None and minute - at <= ttl
        if not served:
            held[key] = (minute, result := float(value))
        out.append((key, i, served, result))
    return sorted(out)


def test_cache_answers_in_time_order_over_batches(spark):
    draw = random.Random(4)
    rows = [(0 if draw.random() < 0.5 else draw.randrange(1, 5), draw.randrange(600), i, draw.randrange(99)) for i in range(240)]
    rows += [(1, 5, 900, 1), (1, 5, 901, 2)]  # equal times: the smaller id first
    rows += [(99, 2000, 999, 1)]  # moves the watermark past all others
    parts = S.jittered(requests(spark, rows[:-1]), "ts", "id", 50)
    assert all(p.count() > 0 for p in parts)
    got = S.steps([*parts, requests(spark, rows[-1:])], lambda s: S.ttl_cache(s, 3600, "1 hour")).select("key", "id", "served", "result")
    assert sorted(map(tuple, got.collect())) == cached(rows[:-1], 60)


def test_rows_behind_the_watermark_are_dropped(spark):
    first = [(1, 0, 1, 10), (1, 300, 2, 20)]
    late = [(1, 30, 3, 30), (1, 310, 4, 40)]  # minute 30 is more than an hour behind 300
    got = S.steps([requests(spark, first), requests(spark, late), requests(spark, [(2, 900, 5, 0)])], lambda s: S.ttl_cache(s, 3600, "1 hour"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 4]


def test_rate_drops_late_rows(spark):
    rows = lambda minutes: spark.createDataFrame([(moment(m),) for m in minutes], "ts timestamp")
    counts = S.newest(S.steps([rows([0, 1, 200]), rows([2, 150, 201])], lambda s: S.rate(s, "1 hour", "1 hour"), "update"), ["start"])
    assert sorted(r["requests"] for r in counts.collect()) == [1, 2, 2]


def test_snapshots_equal_a_running_log(spark):
    draw = random.Random(5)
    base = int(START.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1_000_000
    rows = [(0 if draw.random() < 0.6 else 1, i, base + draw.randrange(500) * 60_000_000, draw.choice([0, 200, 301, 404]), draw.randrange(1000)) for i in range(150)]
    log = spark.createDataFrame([(s, i, e - 1000 * z, e, st, z) for s, i, e, st, z in rows], "site long, event_id long, started long, ended long, status int, size long")
    parts = S.jittered(log.withColumn("at", F.timestamp_micros("ended")), "at", "event_id", 45)
    last = spark.createDataFrame([(9, 999, base, base + 10**11, 200, 1)], log.schema).withColumn("at", F.timestamp_micros("ended"))
    got = {r["event_id"]: r for r in S.steps([*parts, last], lambda s: S.statistics(s, "1 hour")).collect()}
    assert set(got) == set(range(150))
    totals = {}
    for site, i, ended, status, size in sorted(rows, key=lambda r: (r[2], r[1])):
        seen = totals.setdefault(site, [])
        seen.append((ended - 1000 * size, ended, status, size))
        good = [x for x in seen if x[2] != 0]
        r = got[i]
        assert (r["requests"], r["successes"]) == (len(seen), sum(200 <= x[2] <= 399 for x in seen))
        assert r["avg_size"] == (sum(x[3] for x in good) // len(good) if good else None)
        span = max(x[1] for x in good) - min(x[0] for x in good) if good else 0
        assert (r["per_second"] is None) == (span == 0) and (span == 0 or abs(r["per_second"] - len(seen) * 1e6 / span) < 1e-6)


def test_measures_are_readable_between_batches(spark):
    values = spark.createDataFrame([("loss", i, float(100 - i)) for i in range(40)] + [("acc", i, float(i)) for i in range(0, 40, 2)], "measure string, iteration long, value double")
    place, seen = S.folder(spark, "measures"), []
    look = lambda number: seen.append({r["measure"]: (r["n"], r["low"], r["high"], r["last"]) for r in S.current(spark, place).collect()})
    parts = [values.filter((F.col("iteration") >= a) & (F.col("iteration") < b)) for a, b in ((0, 10), (10, 25), (25, 40))]
    assert S.current(spark, place) is None
    S.steps(parts, S.measure_totals, "update", sink=S.published(place, "measure"), between=look)
    assert seen == [{"loss": (b, float(101 - b), 100.0, float(101 - b)), "acc": (-(-b // 2), 0.0, float((b - 1) // 2 * 2), float((b - 1) // 2 * 2))} for b in (10, 25, 40)]
    # A version that was not finished is not read, and a repeated batch counts once.
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/version=77"))
    assert S.newest_version(spark, place) < 77


def test_state_partitions_do_not_touch_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    urls = spark.createDataFrame([(f"u{k % 7}",) for k in range(50)], "url string")
    got = S.steps([urls, urls], S.frontier)
    assert got.count() == 7 and spark.conf.get("spark.sql.shuffle.partitions") == before
