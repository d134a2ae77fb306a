"""WARC archives read in byte ranges, versions 1.0 and 1.1, any bytes in a body.

Spark's text reader cuts the files at the version mark, range by range and through any file
system, and hands on raw bytes. A body may hold that mark itself. So the pieces' byte offsets
are added up (per range, then over the ranges), a record whose Content-Length reaches exactly
to the end of a later piece owns all pieces up to there, and those are put together again. The mark
overlaps itself nowhere, so no range can cut it in two ways. Bodies move between tasks only for
records that were cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.operators.joins import lookup
from webloom.session import ship

MARK = "WARC/1."
BLANK = "\r\n\r\n"


def _head(piece: Column) -> Column:
    """Version line and headers of a piece."""
    return F.substring_index(piece, BLANK, 1)


def _headers(piece: Column) -> Column:
    """Lower-cased names to values; folded lines are joined, of repeated names the last value stays."""
    lines = F.split(F.regexp_replace(_head(piece), r"\r\n[ \t]+", " "), "\r\n")
    fields = F.filter(lines, lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(fields, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]))


def _size(piece: Column) -> Column:
    """Content-Length; null where a record has none."""
    return F.regexp_extract(_head(piece), r"(?i)\r\ncontent-length[ \t]*:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", 1).try_cast("bigint")


def _record(piece: Column) -> list[Column]:
    body = F.octet_length(_head(piece)) + 5  # from 1, past the blank line
    size, held = _size(piece), F.greatest(F.octet_length(piece) - body + 1, F.lit(0))
    ended = F.when(piece.endswith(BLANK) & (held < size), F.greatest(held - len(BLANK), F.lit(0))).otherwise(held)
    return [
        _headers(piece).alias("headers"),
        F.when(size.isNotNull(), F.substr(piece.cast("binary"), body, F.least(size, ended).cast("int"))).alias("body"),
        F.coalesce(held >= size, F.lit(False)).alias("complete")]


def _offsets(pieces: DataFrame) -> DataFrame:
    """``file, mid, start, stop, closed, reach`` in bytes of the file: a piece, whether a blank line ends it, and where its record says that it ends."""
    sizes = pieces.select(
        "file", "block", "mid", F.octet_length("value").cast("bigint").alias("n"), F.col("value").endswith(BLANK).alias("closed"),
        (F.octet_length(_head(F.col("value"))) + 2 * len(BLANK) + _size(F.col("value"))).alias("own"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("file", "block").agg(F.sum(F.col("n") + len(MARK)).alias("bytes"))
    base = F.coalesce(F.sum("bytes").over(before(Window.partitionBy("file").orderBy("block"))), F.lit(0))
    inside = F.coalesce(F.sum(F.col("n") + len(MARK)).over(before(Window.partitionBy("file", "block").orderBy("mid"))), F.lit(0))
    placed = sizes.withColumn("inside", inside).join(blocks.select("file", "block", base.alias("base")), ["file", "block"])
    start = F.col("base") + F.col("inside")
    return placed.select("file", "mid", start.alias("start"), (start + F.col("n")).alias("stop"), "closed", (start + F.col("own")).alias("reach"))


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a file in order to ``mid, owner, start`` of those that belong to a record of several pieces.

    What stands before a file's first mark has the owner -1. A mark that follows no blank line starts no record.
    """
    file = owner = None
    until, first, closed = -1, 0, True
    for batch in batches:
        out = []
        for now, mid, start, ends, reach in zip(*(c.to_pylist() for c in batch.columns)):
            if now != file:
                file, owner, until, first, closed = now, -1, -1, 0, True
                out.append((mid, -1, start))
                continue
            if owner != -1 and (start < until or not closed):
                if first is not None:
                    out.append((owner, owner, first))
                    first = None
                out.append((mid, owner, start))
            else:
                owner, first, until = mid, start, reach or -1
            closed = ends
        mids, owners, starts = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(mids, pa.int64()), pa.array(owners, pa.int64()), pa.array(starts, pa.int64())], names=["mid", "owner", "start"])


def scan_warc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``headers`` (lower-cased names), ``body`` (its Content-Length bytes as they are) and ``complete``, a row per record.

    A body that is shorter than its header says, at the end of a file or before the next record, comes out as far as it goes
    with ``complete`` false; so does a record without a length, with a null body. Compressed files are read
    by one task each.
    """
    ship(spark)
    raw = spark.read.option("lineSep", MARK).text(path)
    # Number and range follow from the file listing alone, so every evaluation finds the same.
    pieces = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("mid"))
    offsets = _offsets(pieces)
    # Only a reach that meets the end of a later piece is believed: a wrong length must not swallow its neighbours.
    stops = offsets.select("file", F.explode(F.array(F.col("stop"), F.col("stop") + len(BLANK))).alias("reach")).distinct()
    cut = offsets.filter(F.col("reach") - len(BLANK) > F.col("stop")).select("file", "mid", "reach")
    believed = cut.join(stops, ["file", "reach"]).select("mid", "reach")
    marked = offsets.drop("reach").join(believed, "mid", "left").select("file", "mid", "start", "closed", "reach")
    owned = marked.repartition("file").sortWithinPartitions("file", "start", "mid").mapInArrow(_owned, "mid bigint, owner bigint, start bigint")
    joined = lookup(pieces.select("mid", "value"), owned, "mid", "left")
    alone = joined.filter("owner is null").select("value")
    parts = joined.filter("owner >= 0").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("start", F.col("value").alias("v")))).alias("parts"))
    together = parts.select(F.array_join(F.transform("parts", lambda p: p["v"]), MARK).alias("value"))
    return alone.unionByName(together).select(*_record(F.col("value")))
