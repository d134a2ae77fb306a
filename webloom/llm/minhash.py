"""Near duplicates by b-bit MinHash.

One pass over the texts gives each document its number of shingles, a 64-bit digest of its
shingle set (documents with equal digests form one class and are never expanded into pairs),
band keys made of full minima, and a packed signature of the low bits of all minima.
Classes that share a band key are candidates. First every candidate is held against one
leader per key, chosen by a hash that differs between bands. What that links is contracted.
Only keys that still span several components are compared inside, in blocks of bounded size,
and return only links that connect components. In both steps bit counts of the packed signatures
estimate the similarity, corrected for chance collisions of low bits; pairs clearly below the
threshold are left out, all others are confirmed on the full shingle sets.

The number of bands makes a link at exactly the threshold share a key with probability
``1 - miss``; the estimate errs below its slack of 4.5 standard deviations in 3 of a million
such cases. Sets are identified by 64-bit digests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from webloom.llm.common import stored
from webloom.llm.components import components
from webloom.operators.joins import lookup

PERMUTATIONS, LOW_BITS, ROWS = 512, 4, 6
LANES = PERMUTATIONS // 64
BLOCK = 512
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    tokens = (text or "").encode().lower().split()
    hashed = np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))
    if not len(hashed):
        return hashed
    size = min(size, len(hashed))
    count = len(hashed) - size + 1
    found = np.full(count, size, np.uint64)
    for j in range(size):
        found = (found ^ hashed[j:j + count]) * ODD
        found ^= found >> np.uint64(29)
    return np.unique(found)


def band_count(percent: int, miss: float) -> int:
    """Bands of ``ROWS`` minima that two sets of that similarity both miss with probability ``miss``."""
    wanted = math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** ROWS)))
    if wanted * ROWS > PERMUTATIONS:
        raise ValueError("the similarity is too low for this signature")
    return wanted


class Sketcher:
    """Band keys and packed low bits of a shingle set."""

    def __init__(self, bands: int, seed: int):
        draws = np.random.default_rng(seed)
        self.bands = bands
        self.factors = draws.integers(0, 2**63, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = draws.integers(0, 2**63, (PERMUTATIONS, 1), dtype=np.uint64)

    def minima(self, found: np.ndarray) -> np.ndarray:
        least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), 512):
            np.minimum(least, (found[at:at + 512] * self.factors + self.shifts).min(axis=1), out=least)
        return least

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = self.minima(found)
        keys = np.arange(self.bands, dtype=np.uint64)
        for row in least[:self.bands * ROWS].reshape(self.bands, ROWS).T:
            keys = (keys ^ row) * ODD
            keys ^= keys >> np.uint64(31)
        mixed = (least ^ (least >> np.uint64(30))) * MIX
        mixed ^= mixed >> np.uint64(31)
        planes = [np.packbits((mixed >> np.uint64(b)).astype(np.uint8) & 1).view(np.int64) for b in range(LOW_BITS)]
        return keys.view(np.int64), np.concatenate(planes)


def _sketches(docs: DataFrame, size: int, bands: int, seed: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands, seed)
        for batch in batches:
            counts, classes, keys, planes = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, size)
                counts.append(len(found))
                if len(found):
                    key, plane = sketcher(found)
                    classes.append(xxh3_64_intdigest(found.tobytes()) - 2**63)
                    keys.append(key)
                    planes.append(plane)
                else:
                    classes.append(None)
                    keys.append(None)
                    planes.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(classes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "class", "keys", "planes"])

    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("class", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("planes", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sketch, schema)


def least_matches(percent: int) -> int:
    """Equal low-bit groups that a linked pair has, but for 4.5 standard deviations of bad luck."""
    chance = 0.5**LOW_BITS
    rate = percent / 100 * (1 - chance) + chance
    return math.floor(PERMUTATIONS * rate - 4.5 * math.sqrt(PERMUTATIONS * rate * (1 - rate)))


def estimate(matches: float) -> float:
    """Similarity that a number of equal low-bit groups speaks for, corrected for chance collisions."""
    chance = 0.5**LOW_BITS
    return (matches / PERMUTATIONS - chance) / (1 - chance)


def _matches(a: Column, b: Column) -> Column:
    """Equal low-bit groups of two packed signatures, by bit counts."""
    total = F.lit(PERMUTATIONS)
    for lane in range(LANES):
        differ = F.lit(0).cast("long")
        for plane in range(LOW_BITS):
            at = F.lit(plane * LANES + lane)
            differ = differ.bitwiseOR(F.get(a, at).bitwiseXOR(F.get(b, at)))
        total = total - F.bit_count(differ)
    return total


def _block_links(percent: int):
    """Links between different components inside blocks of a band key, as a mapInArrow function.

    The rows of a block pair arrive together; only they are held. Pairs that the bit counts leave
    open are confirmed on the full sets, and no more links are returned than it takes to connect
    the components that meet.
    """
    least = least_matches(percent)

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        value = lambda name: group.column(name).to_numpy()
        block, left, right = value("block"), value("left")[0], value("right")[0]
        ids, comps, sizes, key = value("class"), value("comp"), value("n_shingles"), value("key")[0]
        table = lambda name: group.column(name).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        keys, planes = table("keys"), table("planes").view(np.uint64).reshape(len(ids), LOW_BITS, LANES)
        shingles = group.column("shingles").combine_chunks().flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(sizes)
        parent: dict[int, int] = {}

        def root(comp: int) -> int:
            while comp in parent:
                comp = parent[comp]
            return comp

        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        links: list[tuple[int, int]] = []
        for at in range(0, len(a), 64):
            rows = a[at:at + 64]
            differ = np.bitwise_or.reduce(planes[rows][:, None] ^ planes[b][None], axis=2)
            equal = PERMUTATIONS - np.bitwise_count(differ).sum(axis=2, dtype=np.int64)
            big, small = np.maximum(sizes[rows][:, None], sizes[b]), np.minimum(sizes[rows][:, None], sizes[b])
            wanted = (equal >= least) & (comps[rows][:, None] != comps[b]) & (100 * small >= percent * big)
            if left == right:
                wanted &= ids[rows][:, None] < ids[b]
            i, j = np.nonzero(wanted)
            if not len(i):
                continue
            # Each pair belongs to the first band that it shares.
            first = np.argmax(keys[rows[i]] == keys[b[j]], axis=1)
            own = keys[rows[i], first] == key
            for x, y in zip(rows[i[own]].tolist(), b[j[own]].tolist()):
                p, q = root(int(comps[x])), root(int(comps[y]))
                if p != q:
                    common = len(np.intersect1d(
                        shingles[ends[x] - sizes[x]:ends[x]], shingles[ends[y] - sizes[y]:ends[y]], assume_unique=True))
                    if 100 * common >= percent * (sizes[x] + sizes[y] - common):
                        parent[p] = q
                        links.append((int(ids[x]), int(ids[y])))
        if not links:
            return None
        x, y = zip(*links)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            marks = [held.column(c).to_numpy() for c in ("key", "left", "right")]
            ends = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1
            start = 0
            for end in ends.tolist():
                if end - start > 1 and (found := compare(held.slice(start, end - start))) is not None:
                    yield found
                start = end
            held = held.slice(start)
        if held is not None and held.num_rows > 1 and (found := compare(held)) is not None:
            yield found

    return run


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``class`` and its full ``shingles``, read from one document of each wanted class."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                sets = [shingle_set(text, size) for text in batch.column(0).slice(at, 64).to_pylist()]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "shingles"])

    keyed = docs.select("text", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"))
    texts = lookup(keyed, wanted.select("text_hash", "id_key").distinct(), ["text_hash", "id_key"]).select("text")
    return texts.mapInArrow(build, "class long, shingles array<long>").dropDuplicates(["class"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("shingles").alias(f"s_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return joined.withColumn("common", common).filter(
        100 * F.col("common") >= percent * (F.size("s_a") + F.size("s_b") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, seed: int = 29, miss: float = 1e-6) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ``n_shingles``, ``component_id`` and ``kept``.

    Two texts are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of ``size``-word
    shingles (lower-cased in A-Z; shorter texts are one shingle). ``component_id`` is the smallest
    doc_id that links reach, ``kept`` is true where it is the row's own. Null and blank texts
    have no shingles and are linked with nothing. A null doc_id counts as a document but never
    names a component that has another id. Repeated rows keep their number; other columns go.
    """
    placed = _placed(docs, size, percent, seed, miss)
    names = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("name"))
    named = placed.join(names, "root", "left").withColumn("component_id", F.coalesce("name", "doc_id"))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _placed(docs: DataFrame, size: int, percent: int, seed: int = 29, miss: float = 1e-6) -> DataFrame:
    """``doc_id, text_hash, n_shingles`` and the ``root`` class of its component per row; null without shingles."""
    bands = band_count(percent, miss)
    sketches = stored(_sketches(docs, size, bands, seed), "sketches")
    keyed = sketches.filter("class is not null").select("class", F.explode("keys").alias("key"))
    lead = F.struct(F.xxhash64("class", "key").alias("h"), F.col("class"))
    shared = keyed.groupBy("key").agg(F.min(lead)["class"].alias("leader"), F.max(lead)["class"].alias("other")).filter(
        "leader <> other").select("key", "leader")
    members = stored(keyed.join(shared, "key").groupBy("key", "class").agg(F.first("leader").alias("leader")), "members")

    wanted = members.select("class").distinct()
    chosen = sketches.join(wanted, "class").groupBy("class").agg(
        F.min(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_key"), "text_hash")).alias("doc"),
        F.first("n_shingles").alias("n_shingles"), F.first("planes").alias("planes"), F.first("keys").alias("keys"))
    chosen = stored(chosen.select("class", "doc.*", "n_shingles", "planes", "keys"), "classes")

    pairs = members.filter("class <> leader").select(
        F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")).distinct()
    side = lambda c: chosen.select(F.col("class").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("planes").alias(f"p_{c}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & (_matches(F.col("p_a"), F.col("p_b")) >= least_matches(percent))).select("a", "b")
    likely = stored(likely, "likely")
    ends = lambda p: p.select(F.col("a").alias("class")).unionByName(p.select(F.col("b").alias("class"))).distinct()
    sets = lambda p: _sets(docs, chosen.join(ends(p), "class"), size)
    first = stored(_confirmed(likely, sets(likely), percent), "links")
    roots = stored(components(first), "roots")

    # Keys that still span several components: compare inside them, block by block.
    rooted = members.join(roots, members["class"] == roots["node"], "left").select(
        "key", "class", F.coalesce("root", "class").alias("comp"))
    open_keys = rooted.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter(
        "lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = rooted.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = dealt.select("key", "class", "comp", "block", F.explode(others).alias("other")).select(
        "key", "class", "comp", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    cells = stored(cells, "cells")
    meeting = cells.select("class").distinct()
    full = chosen.join(_sets(docs, chosen.join(meeting, "class"), size), "class").select("class", "n_shingles", "keys", "planes", "shingles")
    second = stored(
        cells.join(full, "class").select("key", "left", "right", "block", "class", "comp", "n_shingles", "keys", "planes", "shingles")
        .repartition(F.col("key"), F.col("left"), F.col("right")).sortWithinPartitions("key", "left", "right")
        .mapInArrow(_block_links(percent), "a long, b long"), "late")
    roots = components(first.unionByName(second))

    placed = sketches.select("doc_id", "text_hash", "n_shingles", "class").join(roots, F.col("class") == F.col("node"), "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("root", "class").alias("root"))
    return stored(placed, "placed")


def kept_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest doc_id, then the smallest hash of the text.

    A row is told apart by doc_id and text, so unlike texts stay also where they share a doc_id or have
    none; a null doc_id stays only where its group has no other. Texts without shingles are linked with
    nothing and all stay. Of repeated rows (equal doc_id and text) any one stays.
    """
    rows = _placed(docs, size, percent).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rows = stored(rows, "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "n"))
    named = rows.filter("root is not null").groupBy("root").agg(first.alias("k")).select("k.doc_id", "k.text_hash", "k.n")
    kept = stored(named.unionByName(rows.filter("root is null").select("doc_id", "text_hash", "n")), "kept")
    keyed = docs.select(F.struct("*").alias("record")).select("record", "record.doc_id", F.xxhash64("record.text").alias("text_hash"))

    def of(keys: DataFrame) -> DataFrame:
        d, k = keyed.alias("d"), keys.alias("k")
        return d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_hash") == F.col("k.text_hash")), "left_semi")

    once = of(kept.filter("n = 1")).unionByName(of(kept.filter("n > 1")).dropDuplicates(["doc_id", "text_hash"]))
    return once.select("record.*")
