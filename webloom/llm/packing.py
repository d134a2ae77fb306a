"""Best-fit packing of token sequences by linear grouping.

What is planned is the histogram of piece lengths, at most ``capacity`` numbers however many
documents there are. Large lengths are ranked downwards and cut into groups of equal
cardinality; every length of a group is rounded up to the group's largest. For these few sizes a
fractional covering by configurations (multisets of sizes that fit one sequence) is found by
column generation with a knapsack per round; its whole parts are taken and the remainder is
filled greedily. Then the actual lengths take the places of their group in ranked order, and
the small lengths go, longest first, into the tightest gaps left, or into new sequences.

Everything is counted in stretches: "``n`` pieces of length ``l`` from rank ``r`` go to sequences
``s``, ``s + 1`` ... at offset ``o``". Pieces find their stretch by length and rank in one join.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import stored

CAPACITY, END_ID = 2048, 0


# --- tokens -------------------------------------------------------------------------------------

class Words(dict):
    """Ids of a blank-led word as little-endian bytes, learnt when asked, kept up to a bound."""

    most = 400_000

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(self) < self.most:
            self[word] = ids
        return ids


def rank_encoder(ranks: str, pattern: str):
    """Encoder of a rank file (base64 token, rank) for text without added tokens."""
    import base64

    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary


def text_bytes(text: str, encode, known: Words) -> bytes:
    """Ids of a text without added tokens, as little-endian unsigned 32-bit numbers.

    The byte-level pattern never joins characters across a blank that stands between two other
    characters, so such texts are encoded word by word; other texts are encoded as a whole.
    """
    words = text.split(" ")
    if all(w and not w[0].isspace() and not w[-1].isspace() for w in words):
        return np.array(encode(words[0]), "<u4").tobytes() + b"".join([known[" " + w] for w in words[1:]])
    return np.array(encode(text), "<u4").tobytes()


def token_bytes(text: str | None, encode, known: Words, added: dict[str, int]) -> bytes:
    """Ids of a whole text, then the end id. Added tokens are cut out first, the longer one where two begin."""
    text = text or ""
    parts = [text]
    if any(token in text for token in added):
        parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    ids = b"".join([added[p].to_bytes(4, "little") if p in added else text_bytes(p, encode, known) for p in parts if p])
    return ids + END_ID.to_bytes(4, "little")


def pieces(docs: DataFrame, ranks: str, pattern: str, added: dict[str, int] | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document row: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    ``ranks`` is the text of the vocabulary's rank file, ``pattern`` its splitting pattern and ``added``
    the ids of strings that are tokens of their own wherever they stand. A
    document longer than ``capacity`` is cut so that all but the first piece are full. A null or
    empty text is the end id alone, so every row has a piece; a null doc_id stays null.
    """
    shared, own = docs.sparkSession.sparkContext.broadcast(ranks), dict(added or {})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(shared.value, pattern)
        known = Words(encode)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, out = [], []
                for n, text in enumerate(part.column(1).to_pylist()):
                    ids = token_bytes(text, encode, known, own)
                    total = len(ids) // 4
                    first = total % capacity or capacity
                    starts = [0, *range(first, total, capacity)]
                    for piece, (a, b) in enumerate(zip(starts, [*starts[1:], total])):
                        rows.append(n)
                        body = ids[4 * a:4 * b]
                        out.append((piece, a, b - a, zlib.crc32(body), np.frombuffer(body, "<u4").astype(np.int32) if with_ids else None))
                columns = list(zip(*out)) if out else [(), (), (), (), ()]
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()),
                          *[pa.array(c, pa.int64()) for c in columns[1:4]]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(columns[4], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    long = lambda name: T.StructField(name, T.LongType())
    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), long("start"), long("length"), long("ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.select("doc_id", "text").mapInArrow(cut, T.StructType(fields))


# --- plan over the histogram --------------------------------------------------------------------

def group_large(histogram: dict[int, int], least: int, groups: int) -> list[list[tuple[int, int]]]:
    """Large lengths in descending order, cut into groups of equal cardinality: (length, count) runs."""
    runs = [(l, histogram[l]) for l in sorted(histogram, reverse=True) if l >= least]
    total = sum(c for _, c in runs)
    size = max(1, -(-total // groups))
    found, room = [], 0
    for length, count in runs:
        while count:
            if not room:
                found.append([])
                room = size
            taken = min(count, room)
            found[-1].append((length, taken))
            count -= taken
            room -= taken
    return found


def _best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within the capacity."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = sizes <= room
        offer = np.where(fits, worth[room - np.where(fits, sizes, 0)] + values, -1.0)
        best = int(offer.argmax())
        if offer[best] > worth[room - 1] + 1e-12:
            worth[room], last[room] = offer[best], best
        else:
            worth[room], last[room] = worth[room - 1], -2
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0 and last[room] != -1:
        if last[room] == -2:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= int(sizes[last[room]])
    return float(worth[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of covering ``demand`` with configurations, by column generation."""
    s, d = np.array(sizes), np.array(demand, float)
    n = len(sizes)
    columns = np.diag(np.floor(capacity / s))  # one size per sequence to begin with
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ d
    for round_ in range(rounds):
        if round_ % 50 == 49:
            inverse = np.linalg.inv(columns)
            amount = inverse @ d
        prices = inverse.sum(axis=0)
        worth, column = _best_configuration(s, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-10, np.maximum(amount, 0) / step, np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        columns[:, leave] = column
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
        amount = amount - step * ratio[leave]
        amount[leave] = ratio[leave]
    return [(columns[:, j].astype(int), float(amount[j])) for j in range(n) if amount[j] > 1e-9]


def _whole(plan: list[tuple[np.ndarray, float]], sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Whole numbers of sequences: (group of each place, count). What rounding leaves is packed largest first."""
    left = np.array(demand)
    found: list[tuple[list[int], int]] = []
    for column, amount in sorted(plan, key=lambda c: -c[1]):
        used = column > 0
        count = int(min(np.floor(amount + 1e-6), (left[used] // column[used]).min())) if used.any() else 0
        if count > 0:
            left = left - count * column
            found.append(([g for g in np.flatnonzero(column) for _ in range(column[g])], count))
    while left.any():
        room, places = capacity, []
        for g in range(len(sizes)):  # descending sizes
            while left[g] - places.count(g) > 0 and sizes[g] <= room:
                places.append(g)
                room -= sizes[g]
        counts = np.bincount(places, minlength=len(sizes))
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        left = left - times * counts
        found.append((places, times))
    return found


def sequences(stretches: list[tuple[int, int, int, int, int]]) -> int:
    return max((first + count for _, _, count, first, _ in stretches), default=0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 40) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences among those that call a third or a half of the capacity large."""
    return min((plan_with(histogram, capacity, groups, capacity // k + 1) for k in (3, 2)), key=sequences)


def plan_with(histogram: dict[int, int], capacity: int, groups: int, least: int) -> list[tuple[int, int, int, int, int]]:
    """Stretches (length, rank, count, sequence, offset) that place ``histogram[length]`` pieces of each length.

    ``least`` is the smallest large length. The number of stretches depends on the capacity and
    the groups, not on the number of pieces.
    """
    histogram = {l: c for l, c in histogram.items() if c > 0}
    if any(not 1 <= l <= capacity for l in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    stretches: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    ranks: dict[int, int] = defaultdict(int)

    def place(length: int, count: int, first: int, offset: int) -> None:
        stretches.append((length, ranks[length], count, first, offset))
        ranks[length] += count

    if capacity in histogram:  # full pieces are sequences as they are
        place(capacity, histogram[capacity], 0, 0)
        sequence = histogram.pop(capacity)
    grouped = group_large(histogram, least, groups)
    sizes = [runs[0][0] for runs in grouped]
    demand = [sum(c for _, c in runs) for runs in grouped]
    gaps: list[tuple[int, int, int]] = []  # (room, first sequence, count)
    if sizes:
        queues = [list(reversed(runs)) for runs in grouped]  # longest at the end
        for places, count in _whole(configurations(sizes, demand, capacity), sizes, demand, capacity):
            done = 0
            while done < count:
                # As many sequences alike as the current runs of actual lengths allow.
                need = defaultdict(int)
                for g in places:
                    need[g] += 1
                same = min([count - done, *[max(1, queues[g][-1][1] // k) for g, k in need.items()]])
                offset = 0
                for g in places:
                    length = _take(queues[g], same)
                    place(length, same, sequence, offset)
                    offset += length
                if offset < capacity:
                    gaps.append((capacity - offset, sequence, same))
                sequence += same
                done += same
    sequence = _fill(histogram, least, capacity, gaps, sequence, place)
    return stretches


def _take(queue: list[tuple[int, int]], count: int) -> int:
    """Length of ``count`` pieces taken from the run at the end, which holds as many."""
    length, there = queue.pop()
    if there > count:
        queue.append((length, there - count))
    return length


def _fill(histogram: dict[int, int], least: int, capacity: int, gaps: list[tuple[int, int, int]], sequence: int, place) -> int:
    """Best fit of the small lengths, longest first: the tightest gap that holds the piece."""
    gaps.sort()
    for length in sorted((l for l in histogram if l < least), reverse=True):
        count = histogram[length]
        while count:
            at = bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):
                fresh = -(-count // (capacity // length))
                insort(gaps, (capacity, sequence, fresh))
                sequence += fresh
                continue
            room, first, there = gaps.pop(at)
            taken = min(count, there)
            place(length, taken, first, capacity - room)
            count -= taken
            if room > length:
                insort(gaps, (room - length, first, taken))
            if there > taken:
                insort(gaps, (room, first + taken, there - taken))
    return sequence


# --- placing the pieces -------------------------------------------------------------------------

def packed(cut: DataFrame, capacity: int = CAPACITY, groups: int = 40) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32 ...) with ``sequence_id`` and ``offset``.

    Pieces of one length are ranked without ever meeting in one task: they are dealt by a hash
    of their fields, ranked inside each deal, and start where the deals before them end.
    Repeated rows are ranked one after the other; an empty table gives none.
    """
    spark = cut.sparkSession
    deals = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = [c for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    dealt = stored(cut.select("*", F.monotonically_increasing_id().alias("_row")).select(
        "*", F.pmod(F.xxhash64(*row, "_row"), F.lit(deals)).cast("int").alias("_deal")), "pieces")
    counts = dealt.groupBy("length", "_deal").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    stretches = spark.createDataFrame(
        plan(histogram, capacity, groups), "length long, _rank long, _n long, _sequence long, _offset long")
    inside = F.row_number().over(Window.partitionBy("length", "_deal").orderBy("_row")) - 1
    ranked = dealt.withColumn("_in", inside).join(bases, ["length", "_deal"]).withColumn("_at", F.col("_base") + F.col("_in"))
    # A few thousand stretches at any size of the input: their number follows the capacity alone.
    s = F.broadcast(stretches.withColumnRenamed("length", "_length"))
    found = ranked.join(s, (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_n")))
    return found.select(
        *cut.columns, (F.col("_sequence") + F.col("_at") - F.col("_rank")).alias("sequence_id"), F.col("_offset").alias("offset"))


def write_sequences(cut: DataFrame, path: str, capacity: int = CAPACITY) -> None:
    """Write packed sequences: sequence_id and its ids in order. ``cut`` must carry ``ids``."""
    placed = packed(cut, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    placed.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids")).write.parquet(path)
