"""Substring deduplication by content-defined anchors.

A gear rolling hash over the UTF-8 bytes (32 bytes of context) rates every gram of 32 bytes; the
smallest hash within any ``min_bytes`` bytes makes an anchor (winnowing). It depends on these bytes
alone, so rows that share a passage of that length share an anchor in it, wherever it stands. Anchors
whose gram another row has too are compared with their surroundings: equal surroundings by one
64-bit digest, unlike ones that share half a passage byte by byte, or, where many share it, by the
digests of all passages of ``min_bytes`` bytes around the gram. No pairs of rows are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from webloom.llm.common import stored
from webloom.operators.joins import lookup

GEAR = np.random.default_rng(2024).integers(0, 2**32, 256, dtype=np.uint32)
#: One position in so many ends a chunk; chunks have at least and at most so many bytes.
SPACING, LEAST, MOST = 24, 8, 1024
#: So many contexts with one half are compared pair by pair; more of them by the digests of their passages.
PAIRED = 64


def gear_hash(data: np.ndarray) -> np.ndarray:
    """``h = (h << 1) + GEAR[byte]`` at every position, in five doubling steps."""
    found = GEAR[data]
    width = 1
    while width < 32:
        found[width:] += found[:-width] << np.uint32(width)
        width *= 2
    return found


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end, always between characters; the last one ends with it."""
    if not data:
        return []
    raw = np.frombuffer(data, np.uint8)
    inside = (raw & 0xC0) == 0x80  # not the first byte of a character
    spots = np.flatnonzero((gear_hash(raw)[:-1] < np.uint32(2**32 // SPACING)) & ~inside[1:]) + 1
    ends, last = [], 0
    for spot in [*spots.tolist(), len(data)]:
        while spot - last > MOST:
            last += MOST
            while inside[last]:
                last -= 1
            ends.append(last)
        if spot - last >= LEAST:
            ends.append(spot)
            last = spot
    if last < len(data):
        ends.append(len(data))
    return ends


def numbered(docs: DataFrame) -> DataFrame:
    """The rows as ``record`` with a ``row`` number that tells rows of one doc_id apart."""
    return docs.select(F.struct("*").alias("record"), F.monotonically_increasing_id().alias("row"))


def passages(data: np.ndarray, edges: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, both ascending, of the shortest stretches of whole characters with ``min_bytes`` or more.

    ``data`` holds texts one after the other, with a text from each of ``edges`` to the next; no stretch reaches over one.
    """
    fresh = (data & 0xC0) != 0x80
    if fresh.all():
        starts = np.arange(max(0, len(data) - min_bytes + 1))
        ends = starts + min_bytes
    else:
        spots = np.append(np.flatnonzero(fresh), len(data))
        before = np.concatenate([[0], np.cumsum(fresh)])  # characters that begin before a place
        begin = spots[spots + min_bytes <= len(data)]
        end = spots[before[begin + min_bytes]]
        past = spots[spots >= min_bytes]
        back = spots[before[past - min_bytes + 1] - 1]
        new = spots[before[back + min_bytes]] != past
        keys = np.concatenate([begin * (len(data) + 1) + end, back[new] * (len(data) + 1) + past[new]])
        keys.sort(kind="stable")
        starts, ends = np.divmod(keys, len(data) + 1)
    whole = ends <= edges[np.searchsorted(edges, starts, "right").clip(max=len(edges) - 1)]
    return starts[whole], ends[whole]


def anchors(data: np.ndarray, min_bytes: int) -> np.ndarray:
    """Place of the gram with the smallest hash in the ``min_bytes`` bytes from each position on, ascending: equal bytes, equal places."""
    if len(data) < min_bytes:
        return np.zeros(0, np.int64)
    gram = gram_bytes(min_bytes)
    hashed = gear_hash(data)[gram - 1:] & np.uint32(2**gram - 1)
    hashed *= np.uint32(0x9E3779B1)
    hashed ^= hashed >> np.uint32(15)
    # The last of equal hashes is the smallest.
    least = hashed.astype(np.uint64) << np.uint64(32) | np.arange(len(hashed), 0, -1).astype(np.uint64)
    width, wanted = 1, min_bytes - gram + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return len(hashed) - (least & np.uint64(2**32 - 1)).astype(np.int64)


def gram_bytes(min_bytes: int) -> int:
    return min(32, min_bytes)


def _side_by_side(texts: list[bytes], min_bytes: int) -> Iterator[list[int]]:
    """Numbers of the texts that can hold a passage, up to 256 kB or one text at a time, ASCII apart from the others."""
    for plain in (True, False):
        taken, held = [], 0
        for n, text in enumerate(texts):
            if len(text) >= min_bytes and text.isascii() == plain:
                if taken and held + len(text) > 2**18:
                    yield taken
                    taken, held = [], 0
                taken.append(n)
                held += len(text)
        if taken:
            yield taken


def _anchored(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``doc_id, row, text_hash, at, more, low, high, gram, context`` per context of a text, with its first place and all ``more``.

    Each passage belongs to the anchor of its first ``min_bytes`` bytes; ``low`` and ``high`` bound
    those of an anchor, relative to its place. Equal contexts have the same passages.
    """
    flat = rows.select("record.doc_id", "row", F.xxhash64("record.text").alias("text_hash"), "record.text")
    gram = gram_bytes(min_bytes)
    reach = min_bytes - gram + 6

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = [(t or "").encode() for t in part.column(3).to_pylist()]
                for some in _side_by_side(texts, min_bytes):
                    joined = b"".join([texts[n] for n in some])
                    edges = np.concatenate([[0], np.cumsum([len(texts[n]) for n in some])])
                    data = np.frombuffer(joined, np.uint8)
                    starts, ends = passages(data, edges, min_bytes)
                    owner = anchors(data, min_bytes)[starts]
                    a = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
                    b = np.append(a[1:], len(owner)) - 1
                    spots = owner[a]
                    text = np.searchsorted(edges, spots, "right") - 1
                    left, right = np.maximum(edges[text], spots - reach), np.minimum(edges[text + 1], spots + gram + reach)
                    grams = [xxh3_64_intdigest(joined[p:p + gram]) for p in spots.tolist()]
                    # What is cut off at the beginning of the text tells such contexts apart.
                    contexts = [xxh3_64_intdigest(joined[x:y], z) for x, y, z in zip(left.tolist(), right.tolist(), (spots - left).tolist())]
                    grams, contexts = (np.array(x, np.uint64).view(np.int64) for x in (grams, contexts))
                    at = (spots - edges[text]).astype(np.int32)
                    # A text that goes on repeating itself has few contexts with very many places.
                    order = np.lexsort((contexts, text))
                    fresh = np.append(True, (np.diff(contexts[order]) != 0) | (np.diff(text[order]) != 0))
                    lead, again = order[fresh], at[order[~fresh]]
                    counts = np.diff(np.append(np.flatnonzero(fresh), len(order))) - 1
                    more = pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(again), mask=pa.array(counts == 0))
                    index = pa.array(np.array(some)[text[lead]])
                    numbers = lambda x: pa.array(x[lead].astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c).take(index) for c in range(3)], numbers(at), more, numbers(starts[a] - spots),
                         numbers(ends[b] - spots), pa.array(grams[lead]), pa.array(contexts[lead])],
                        names=["doc_id", "row", "text_hash", "at", "more", "low", "high", "gram", "context"])

    long, number = (lambda c: T.StructField(c, T.LongType())), (lambda c: T.StructField(c, T.IntegerType()))
    schema = T.StructType([flat.schema["doc_id"], long("row"), long("text_hash"), number("at"),
                           T.StructField("more", T.ArrayType(T.IntegerType())), number("low"), number("high"), long("gram"), long("context")])
    return flat.mapInArrow(find, schema)


def _owned(near: list[bytes], lows: list[int], min_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the passages of anchors, relative to them; their bytes are given from the lowest start to the highest end."""
    for begin in range(0, len(near), 256):
        some, low = near[begin:begin + 256], lows[begin:begin + 256]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in some])])
        data = np.frombuffer(b"".join(some), np.uint8)
        starts, ends = passages(data, edges, min_bytes)
        places = edges[:-1] - low
        number = np.searchsorted(edges, starts, "right") - 1
        own = anchors(data, min_bytes)[starts] == places[number]
        starts, ends, number = starts[own], ends[own], number[own]
        bounds = np.searchsorted(number, np.arange(len(some) + 1))
        for p, a, b in zip(places, bounds[:-1], bounds[1:]):
            yield starts[a:b] - p, ends[a:b] - p


def _windows(texts: DataFrame, min_bytes: int) -> DataFrame:
    """``gram, context, first, last, low, high, halves, bytes`` for the wanted spots of the texts.

    ``bytes`` are those around the gram. ``halves`` are digests of the gram with half of the other
    bytes of a passage on either side; a passage around the gram holds one of them at least.
    """
    gram = gram_bytes(min_bytes)
    reach = min_bytes - gram + 6
    more = (min_bytes - gram) // 2
    names = ["gram", "context", "first", "last", "low", "high", "halves", "bytes"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int64()), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, spots in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                for s in spots.as_py():
                    p, halves = s["at"], []
                    if p >= more:
                        halves.append(xxh3_64_intdigest(data[p - more:p + gram], 1) - 2**63)
                    if p + gram + more <= len(data):
                        halves.append(xxh3_64_intdigest(data[p:p + gram + more], 2) - 2**63)
                    near = b"\0" * (reach - p) + data[max(0, p - reach):p + gram + reach]
                    found.append((s["gram"], s["context"], s["first"], s["last"], s["low"], s["high"], halves, near.ljust(gram + 2 * reach, b"\0")))
                    if len(found) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
                        found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    return texts.mapInArrow(cut, "gram long, context long, first long, last long, low int, high int, halves array<long>, bytes binary")


def _around(windows: DataFrame, min_bytes: int) -> DataFrame:
    """``gram, context, low, high, digest, first, last`` for every passage of the windows."""
    reach = min_bytes - gram_bytes(min_bytes) + 6

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows, found = batch.slice(begin, 256).to_pylist(), []
                near = [r["bytes"][reach + r["low"]:reach + r["high"]] for r in rows]
                for r, data, (starts, ends) in zip(rows, near, _owned(near, [r["low"] for r in rows], min_bytes)):
                    for x, y in zip(starts.tolist(), ends.tolist()):
                        digest = xxh3_64_intdigest(data[x - r["low"]:y - r["low"]]) - 2**63
                        found.append((r["gram"], r["context"], x, y, digest, r["first"], r["last"]))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["gram", "context", "low", "high", "digest", "first", "last"])

    return windows.mapInArrow(cut, "gram long, context long, low int, high int, digest long, first long, last long")


def _matched(groups: DataFrame, min_bytes: int) -> DataFrame:
    """``gram, context, low, high, seen_low, seen_high`` of what the ``members`` of a group have from each other, byte by byte."""
    gram = gram_bytes(min_bytes)
    reach = min_bytes - gram + 6
    far = 2**31 - 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                lists = batch.column(0).slice(begin, 256)
                sizes = np.diff(lists.offsets.to_numpy())
                members = lists.flatten()
                value = lambda c: members.field(members.type.get_field_index(c))
                texts = value("bytes").to_pylist()
                near = np.frombuffer(b"".join(texts), np.uint8).reshape(-1, gram + 2 * reach)
                first, last, low, high = (value(c).to_numpy() for c in ("first", "last", "low", "high"))
                uneven = (near >= 128).any(1)
                odd = np.flatnonzero(uneven).tolist()
                owned = dict(zip(odd, _owned([texts[n][reach + low[n]:reach + high[n]] for n in odd], low[uneven].tolist(), min_bytes)))
                tops = np.repeat(np.cumsum(sizes) - sizes, sizes)
                others = np.repeat(sizes, sizes)
                share = np.cumsum(others) // 2**15
                for k in np.unique(share):
                    some = np.flatnonzero(share == k)
                    i = np.repeat(some, others[some])
                    j = np.repeat(tops[some] - np.cumsum(others[some]) + others[some], others[some]) + np.arange(len(i))
                    same = near[i] == near[j]
                    back, on = same[:, reach - 1::-1], same[:, reach + gram:]
                    lo = np.maximum(np.maximum(low[i], low[j]), -np.where(back.all(1), reach, back.argmin(1)))
                    hi = np.minimum(np.minimum(high[i], high[j]), gram + np.where(on.all(1), reach, on.argmin(1)))
                    for n in np.flatnonzero(uneven[i] & (hi - lo >= min_bytes)).tolist():
                        x, y = owned[int(i[n])]
                        a, b = np.searchsorted(x, lo[n]), np.searchsorted(y, hi[n], "right") - 1
                        lo[n], hi[n] = (x[a], y[b]) if a <= b else (0, 0)
                    met = (hi - lo >= min_bytes) & (i != j) & (np.minimum(first[i], first[j]) != np.maximum(last[i], last[j]))
                    early = met & (first[j] < first[i])
                    runs = np.cumsum(others[some]) - others[some]
                    bounds = [f.reduceat(np.where(flag, x, none), runs) for flag in (met, early)
                              for f, x, none in ((np.minimum, lo, far), (np.maximum, hi, -far))]
                    held = bounds[0] < far
                    index = pa.array(some[held])
                    yield pa.RecordBatch.from_arrays(
                        [value("gram").take(index), value("context").take(index),
                         *[pa.array(x[held], pa.int32(), mask=np.abs(x[held]) == far) for x in bounds]],
                        names=["gram", "context", "low", "high", "seen_low", "seen_high"])

    return groups.select("members").mapInArrow(compare, "gram long, context long, low int, high int, seen_low int, seen_high int")


def _marks(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``doc_id, row, start, past`` of repeated text around an anchor, and ``seen_start, seen_past`` of what an earlier row has."""
    if min_bytes < 1:
        raise ValueError("min_bytes must be positive")
    # One shuffle by gram and one sort: unshared grams go, the others learn who has their context.
    placed = _anchored(rows, min_bytes).repartition("gram").sortWithinPartitions("gram", "context", "row", "at")
    alone, context = Window.partitionBy("gram"), Window.partitionBy("gram", "context").orderBy("row", "at")
    whole = context.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = placed.select(
        "*", F.min("row").over(alone).alias("lo"), F.max("row").over(alone).alias("hi"),
        (F.min("context").over(alone) != F.max("context").over(alone)).alias("unlike")).filter("lo <> hi")
    # A gram with one context is repeated as far as the context goes; others are compared.
    only = lambda c: F.when(F.col("unlike"), F.col(c)).alias(c)
    found = stored(shared.select(
        "doc_id", "row", only("text_hash"), "at", "more", "low", "high", only("gram"), only("context"), F.first("row").over(whole).alias("first"),
        F.last("row").over(whole).alias("last"), (F.col("unlike") & (F.row_number().over(context) == 1)).alias("leads")), "shared")
    keyed = rows.select("record.text", F.xxhash64("record.text").alias("text_hash"), F.coalesce(F.col("record.doc_id").cast("string"), F.lit("")).alias("id_key"))

    unlike = found.filter("leads")
    spots = unlike.groupBy("text_hash", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key")).agg(
        F.collect_list(F.struct("at", "low", "high", "gram", "context", "first", "last")).alias("spots"))
    texts = keyed.join(stored(spots, "spots"), ["text_hash", "id_key"]).select("text", "spots")
    windows = stored(_windows(texts, min_bytes), "windows")
    alike = windows.select(F.explode("halves").alias("half"), "first", "last").groupBy("half").agg(
        F.min("first").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 1").select("half", "n")
    alike = stored(alike, "alike")
    halved = windows.withColumn("half", F.explode("halves")).drop("halves")
    members = F.struct("gram", "context", "first", "last", "low", "high", "bytes")
    matched = _matched(halved.join(alike.filter(F.col("n") <= PAIRED), "half").groupBy("half").agg(F.collect_list(members).alias("members")), min_bytes)
    many = alike.filter(F.col("n") > PAIRED)
    if not many.isEmpty():
        crowd = lookup(halved.select("half", "gram", "context"), many.select("half"), "half").select("gram", "context").distinct()
        around = stored(_around(windows.join(crowd, ["gram", "context"], "left_semi").drop("halves"), min_bytes), "passages")
        met = around.groupBy("digest").agg(F.min("first").alias("begin"), F.max("last").alias("end")).filter("begin <> end").select("digest", "begin")
        early = lambda c: F.when(F.col("begin") < F.col("first"), F.col(c))
        matched = matched.unionByName(around.join(met, "digest").groupBy("gram", "context").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min(early("low")).alias("seen_low"), F.max(early("high")).alias("seen_high")))
    known = matched.groupBy("gram", "context").agg(
        F.min("low").alias("met_low"), F.max("high").alias("met_high"), F.min("seen_low").alias("seen_low"), F.max("seen_high").alias("seen_high"))
    own = F.col("first") < F.col("last")
    compared = found.filter("gram is not null").join(known, ["gram", "context"], "left").filter(own | F.col("met_low").isNotNull()).withColumns({
        "low": F.when(own, F.col("low")).otherwise(F.col("met_low")), "high": F.when(own, F.col("high")).otherwise(F.col("met_high"))})
    blank = F.lit(None).cast("int")
    marked = compared.unionByName(found.filter("gram is null").withColumns({"seen_low": blank, "seen_high": blank}), allowMissingColumns=True)
    later = F.col("row") > F.col("first")
    first = F.array("at")
    places = F.explode(F.when(F.col("more").isNull(), first).otherwise(F.concat(first, "more")))
    return marked.withColumn("at", places).select(
        "doc_id", "row", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high")).alias("past"),
        (F.col("at") + F.when(later, F.col("low")).otherwise(F.col("seen_low"))).alias("seen_start"),
        (F.col("at") + F.when(later, F.col("high")).otherwise(F.col("seen_high"))).alias("seen_past"))


def _joined(marks: DataFrame, start: str, past: str) -> DataFrame:
    """Marks numbered by ``run``: those that overlap or touch are one."""
    along = Window.partitionBy("row").orderBy(start, past)
    before = F.max(past).over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(start) > before, F.lit(True)).cast("int")
    return marks.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))


def repeated_spans(docs: DataFrame, min_bytes: int = 90) -> DataFrame:
    """``doc_id, span_start, span_bytes, n_chunks, n_seen_before`` for spans that occur in several rows.

    Every stretch of whole characters with ``min_bytes`` or more that another row has too is found
    in full; stretches that overlap or touch are one span. Places count bytes of the UTF-8 text.
    Every row that holds a passage reports it. ``n_chunks`` counts the anchors of a span,
    ``n_seen_before`` those whose surroundings an earlier row already has. Null and empty texts
    have no spans; repeats inside one row alone are none; repeated rows and rows with a null
    doc_id count as rows of their own.
    """
    marks = _joined(_marks(numbered(docs.select("doc_id", "text")), min_bytes), "start", "past")
    seen = F.coalesce((F.col("seen_start") == F.col("start")) & (F.col("seen_past") == F.col("past")), F.lit(False))
    spans = marks.groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("span_start"), (F.max("past") - F.min("start")).cast("long").alias("span_bytes"),
        F.count("*").alias("n_chunks"), F.count(F.when(seen, 1)).alias("n_seen_before"))
    return spans.drop("row", "run")


def without_repeats(docs: DataFrame, min_bytes: int = 90) -> DataFrame:
    """``docs`` whose ``text`` has lost the spans that an earlier row already holds; other columns stay."""
    rows = stored(numbered(docs), "records")
    seen = _joined(_marks(rows, min_bytes).filter("seen_start is not null"), "seen_start", "seen_past").groupBy("row", "run").agg(
        F.min("seen_start").alias("span_start"), (F.max("seen_past") - F.min("seen_start")).cast("long").alias("span_bytes"))
    marks = seen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_bytes"))).alias("spans"))
    data = F.encode(F.col("record.text"), "utf-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["span_start"] + s["span_bytes"]))
    ends = F.concat(F.transform("spans", lambda s: s["span_start"].cast("long")), F.array(F.octet_length("record.text").cast("long")))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.decode(F.substring(
        data, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "utf-8"))
    text = F.when(F.col("spans").isNull(), F.col("record.text")).otherwise(F.concat_ws("", parts))
    return rows.join(marks, "row", "left").select(
        *[text.alias(c) if c == "text" else F.col(f"record.`{c}`").alias(c) for c in docs.columns])
