"""Enough partitions for work that is heavy per row."""

from pyspark.sql import DataFrame

SPLIT = 128 * 1024 * 1024
#: Bytes of files that one task takes. Words with their ids need many times the room of the stored texts.
PIECE = 4 * 1024 * 1024


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _large(df: DataFrame) -> bool:
    """Whether the files hold a full split per core."""
    return _size(df) >= df.sparkSession.sparkContext.defaultParallelism * SPLIT


def pieces(df: DataFrame) -> int:
    """Partitions that hold about ``PIECE`` bytes of files each, one per core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-_size(df) // PIECE))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by ``key`` when the files hold less than one full split per core.

    Small files may be one row group each, which one task reads alone. Larger inputs have
    more splits than cores and pass unchanged, without a shuffle. ``key`` is the row's own
    id, so no partition can be hot, and later groupings by it reuse the partitioning. There
    are more pieces where there is more input, so a task's share does not grow.
    """
    return df if _large(df) else df.repartition(pieces(df), key)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by ``key`` what ``spread`` passes unchanged, for groupings that would else
    shuffle many rows made of each row of ``df``."""
    return df.repartition(pieces(df), key) if _large(df) else df
