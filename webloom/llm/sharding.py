"""Two-pass external shuffle into equal shards.

Pass one deals every record to a bucket by a seeded hash of its place in the input and
writes it to shared storage. The hash ignores the contents, so copies, repeated rows and
hot keys spread like any other rows, and a bucket holds ``bucket_bytes`` on average.
Pass two brings one bucket at a time into memory, applies a Fisher-Yates shuffle (Spark's
seeded ``shuffle``) and numbers the records through: bucket offsets are prefix sums of the
bucket counts, and equal stretches of the global order are the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import stored

#: Buckets per block of the two-level prefix sum.
BLOCK = 4096


def _offsets(counts: DataFrame) -> DataFrame:
    """Rows before each bucket; one task sees the buckets of a block, or one row per block."""
    blocked = counts.withColumn("block", F.expr(f"bucket div {BLOCK}"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("block").orderBy("bucket"))
    across = before(Window.orderBy("block"))
    blocks = blocked.groupBy("block").agg(F.sum("n").alias("n")).select(
        "block", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    return blocked.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block").select(
        "bucket", (F.col("base") + F.col("inner")).alias("offset"))


def _size(df: DataFrame) -> Column:
    """Bytes of a record as far as its strings and binaries go, plus 16."""
    long = [F.coalesce(F.octet_length(F.col(f"record.`{f.name}`")), F.lit(0)) for f in df.schema.fields
            if f.dataType.typeName() in ("string", "binary")]
    return sum(long, F.lit(16)).cast("long")


def shuffled(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Every row of ``docs`` with its ``shard`` (0 to ``shards`` - 1, row counts at most one apart) and ``slot``.

    Slots are gapless from 0 in each shard. The order depends on the seed and on how the
    input is split; once pass one is written, retries repeat it exactly. Nulls and empty
    texts are records like others, repeated rows keep every copy, an empty table gives no
    rows, and input columns called ``shard`` or ``slot`` are replaced.
    """
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    dealt = stored(
        docs.select(F.struct("*").alias("record"), F.monotonically_increasing_id().alias("row"))
        .select("record", "row", F.xxhash64(F.lit(seed), "row").alias("draw"), _size(docs).alias("size")), "scatter")
    rows, size = dealt.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    dealt = dealt.withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    by_draw = lambda a, b: (
        F.when(a["draw"] < b["draw"], -1).when(a["draw"] > b["draw"], 1)
        .when(a["row"] < b["row"], -1).when(a["row"] > b["row"], 1).otherwise(0))
    gathered = dealt.groupBy("bucket").agg(F.collect_list(F.struct("draw", "row", "record")).alias("records"))
    offsets = _offsets(dealt.groupBy("bucket").agg(F.count("*").alias("n")))
    # The generator of shuffle() runs on from bucket to bucket: a fixed order makes retries equal.
    placed = gathered.join(offsets, "bucket").sortWithinPartitions("bucket").select(
        "offset", F.posexplode(F.shuffle(F.array_sort("records", by_draw), seed)).alias("place", "found"))
    place = F.col("offset") + F.col("place")
    small, rest = divmod(rows, shards)
    edge = rest * (small + 1)  # the first shards hold one row more
    tail = max(small, 1)
    kept = [F.col(f"found.record.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed.withColumn("place", place).select(
        *kept,
        F.when(F.col("place") < edge, F.expr(f"place div {small + 1}"))
        .otherwise(F.lit(rest) + F.expr(f"(place - {edge}L) div {tail}")).cast("int").alias("shard"),
        F.when(F.col("place") < edge, F.col("place") % (small + 1)).otherwise((F.col("place") - edge) % tail).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17, bucket_bytes: int = 16 << 20) -> None:
    """Write the shuffled records, one folder per shard; rows carry their ``slot``."""
    shuffled(docs, shards, seed, bucket_bytes).write.partitionBy("shard").parquet(path)
