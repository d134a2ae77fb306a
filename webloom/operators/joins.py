"""Joins against lookup tables whose size is checked, and which survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure the table, reading at most ``rows`` + 1 of its rows."""
    found = table.limit(rows + 1).agg(
        F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct(*table.columns)))).alias("bytes")).first()
    return found["rows"] <= rows and (found["bytes"] or 0) <= size


def lookup(facts: DataFrame, table: DataFrame, key: str | list[str], how: str = "inner", spread_on: str | None = None,
           salts: int | None = None, small: bool | None = None) -> DataFrame:
    """Join facts with a table that has one row per key.

    A table measured to be small is broadcast. A larger one is joined by key; with
    ``spread_on`` the facts of a hot key are dealt to ``salts`` tasks and the table's
    rows are copied once per salt, so no single task receives the whole group. By default
    there are as many salts as the largest key has shares of a shuffle partition.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if fits_broadcast(table) if small is None else small:
        return facts.join(F.broadcast(table), keys, how)
    if spread_on is None:
        return facts.join(table, keys, how)
    if salts is None:
        largest, rows = facts.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = max(1, -(-(largest or 0) * partitions // max(rows or 0, 1)))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_on), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
