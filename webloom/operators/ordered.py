"""Running totals and row numbers over a global order, without a one-task window.

A window without (or with a skewed) partition key pulls its group into one task.
Here the order is first cut into value ranges. The cut points come from a bounded
sample of the sort keys, so every range holds a similar number of rows whatever the
distribution is. Each range is then its own window partition, and a tiny table of
range totals supplies what came before it. The range of a row depends on its key
values alone, so recomputing a lost partition gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES_PER_RANGE = 16
MAX_RANGES = 4096


def range_count(df: DataFrame) -> int:
    """Power of two near four ranges per shuffle partition."""
    wanted = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = 16
    while count < min(wanted, MAX_RANGES):
        count *= 2
    return count


def _literal(value, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, str):
        value = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{value}' AS {kind})"


def range_of(df: DataFrame, order: list[str], by: list[str] | None = None) -> Column:
    """Number of the value range a row falls into, ascending in ``order`` (unique within ``by``)."""
    count = range_count(df)
    key = F.struct(*order)
    # Rows with the smallest hashes: a fixed-size, repeatable sample of the order. The hash covers ``by``
    # too, else all rows of an order value that many keys share would be drawn together.
    sample = (
        df.select(*order, F.xxhash64(*order, *(by or [])).alias("_draw"))
        .orderBy("_draw", *order)
        .limit(count * SAMPLES_PER_RANGE)
        .collect()
    )
    keys = sorted({tuple(row)[:len(order)] for row in sample}, key=lambda k: tuple((v is not None, v) for v in k))
    step = max(1, len(keys) // count)
    points = keys[step::step][: count - 1]
    if not points:
        return F.lit(0)
    kinds = [df.schema[name].dataType.simpleString() for name in order]
    fields = lambda p: ", ".join(f"'{n}', {_literal(v, k)}" for n, v, k in zip(order, p, kinds))
    bounds = F.expr("array(" + ", ".join(f"named_struct({fields(p)})" for p in points) + ")")
    steps, width = [], count
    while width > 1:
        width //= 2
        steps.append(width)
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when(F.get(bounds, at + s - 1) <= key, at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))  # never NULL, which spares joins a null check


def running(df: DataFrame, order: list[str], measures: dict[str, tuple[str, Column]], by: list[str] | None = None) -> DataFrame:
    """Add running aggregates (``sum``, ``min`` or ``max``) up to and including each row.

    ``order`` names columns that together are unique within ``by``, ascending.
    """
    by = by or []
    kinds = {"sum": F.sum, "min": F.min, "max": F.max}
    tagged = df.withColumn("_range", range_of(df, order, by))
    for name, (_, value) in measures.items():
        tagged = tagged.withColumn(f"_v_{name}", value)
    totals = tagged.groupBy(*by, "_range").agg(*[kinds[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in measures.items()])
    # One row per range and key: what all earlier ranges add up to.
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_range").alias("_before_range"),
        *[kinds[k](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (k, _) in measures.items()])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[kinds[k](f"_v_{n}").over(inside).alias(f"_l_{n}") for n, (k, _) in measures.items()])
    # Null-safe, though neither side is null: from a plain equality the optimizer derives a filter on the totals
    # that names the order columns, which the totals do not have.
    match = F.col("_range").eqNullSafe(F.col("_before_range"))
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = local.join(before, match)
    merge = {
        "sum": lambda a, b: F.when(b.isNull(), a).when(a.isNull(), b).otherwise(a + b),
        "min": lambda a, b: F.least(a, b),
        "max": lambda a, b: F.greatest(a, b),
    }
    return joined.select(
        *df.columns, *[merge[k](F.col(f"_l_{n}"), F.col(f"_b_{n}")).alias(n) for n, (k, _) in measures.items()])


def ordinal(df: DataFrame, order: list[str], name: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """Number the rows from 1 in ``order`` (unique within ``by``)."""
    return running(df, order, {name: ("sum", F.lit(1).cast("bigint"))}, by)


def split_on_marker(df: DataFrame, order: list[str], marker: Column, by: list[str] | None = None, name: str = "part") -> DataFrame:
    """Group number of an ordered sequence in which every marker row starts a new group."""
    return running(df, order, {name: ("sum", marker.cast("bigint"))}, by)


def runs(df: DataFrame, order: list[str], wanted: Column, by: list[str] | None = None) -> DataFrame:
    """Maximal stretches of consecutive rows that satisfy ``wanted``: first, last and size."""
    tagged = df.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    breaks = running(tagged, order, {"_breaks": ("sum", (~F.col("_wanted")).cast("bigint"))}, by)
    place = F.struct(*order)
    return (
        breaks.filter("_wanted").groupBy(*(by or []), "_breaks")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("size"))
        .drop("_breaks"))
