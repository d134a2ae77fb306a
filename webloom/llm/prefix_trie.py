"""Prefix trie of conversations, built as a z-fast trie.

Every turn becomes a 128-bit hash and every prefix of a conversation the running xor of its turns'
hashes, each mixed with its depth; equal conversations are one string. Strings are inserted in
rounds. A round looks every waiting string up by fat binary search: compacted nodes are found by the
hash of their two-fattest depth (the handle), so a search takes a logarithm of the turns in lookups,
each a join by hash. It ends at the string's exit node; one string per exit point and next turn, drawn
by hash, is inserted with all its remaining turns as one edge, and the others go on from there. The
number of strings below a point halves from round to round on average. At the end the edges are
expanded to one row per node, and sums go from the last round's edges up to the first's.

A conversation is one record here: 20 bytes for each of its turns lie in one row, its texts never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import stored, words

TURNS = "array<struct<p:bigint,q:bigint,w:int>>"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(value: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of a published splittable generator)."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn hashes of a conversation to prefix hashes; words stay as they are."""
    for batch in batches:
        turns = batch.column(1)
        sizes = np.diff(turns.offsets.to_numpy()).astype(np.int64)
        flat = turns.flatten()
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        depth = np.arange(len(flat), dtype=np.int64) - np.repeat(begins[:-1], sizes) + 1
        columns = []
        for name in ("p", "q"):
            own = flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            run = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_mixed(own + depth.astype(np.uint64) * GOLDEN))])
            columns.append(pa.array((run[1:] ^ np.repeat(run[begins[:-1]], sizes)).view(np.int64)))
        path = pa.StructArray.from_arrays([*columns, flat.field("w")], names=["p", "q", "w"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), path)],
            names=["conv_id", "len", "path"])


def conversations(table: DataFrame) -> DataFrame:
    """``conv_id, own``: the hashed turns of every conversation in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.xxhash64(role, text).alias("p"),
        F.xxhash64(F.lit("second"), text, role).alias("q"), F.size(words(text)).alias("w"))
    return table.filter("conv_id is not null").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["p"].alias("p"), t["q"].alias("q"), t["w"].alias("w"))).alias("own"))


def rebuilt(table: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their group.

    The first h turns come from conversation ``c - c % group``, the others are c's own after its first
    h; h is the crc32 of c as decimal text modulo ``heads``.
    """
    own = conversations(table)
    lent = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("own", 1, heads).alias("lent"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % group).join(lent, "first", "left")
    none = F.array().cast(TURNS)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("lent", none), F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))).alias("own"))


def fattest(a: str, b: str) -> Column:
    """The number in (a, b] that the largest power of two divides."""
    return F.expr(f"{b} & shiftleft(-1, length(bin({a} ^ {b})) - 1)")


def _at(path: str, place) -> Column:
    """The prefix hash at a depth, null outside the conversation."""
    return F.get(F.col(path), place - 1)


def _pieces(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """Compacted nodes ``r, a, e``: every inserted string's edge cut where others leave it or end."""
    by_string = cuts.groupBy("r").agg(F.collect_set("m").alias("cuts"))
    cut = segments.join(by_string, segments["sid"] == by_string["r"], "left").withColumn(
        "ends", F.array_sort(F.array_distinct(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("len")))))
    cut = cut.withColumn("ends", F.filter("ends", lambda e: e > F.col("m")))
    return cut.select(F.col("sid").alias("r"), "path", F.explode(F.arrays_zip(
        F.concat(F.array("m"), F.slice("ends", F.lit(1), F.size("ends") - 1)).alias("a"), F.col("ends").alias("e"))).alias("piece")).select(
            "r", "path", "piece.a", "piece.e")


def _locate(waiting: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """Matched depth ``m`` and the string ``at`` whose edge holds that depth, for every waiting string."""
    handles = stored(pieces.withColumn("f", fattest("a", "e")).select(
        F.struct("f", _at("path", F.col("f")).alias("x")).alias("key"), F.col("r").alias("h_r"), F.col("a").alias("h_a"), F.col("e").alias("h_e"),
        _at("path", F.col("e")).alias("h_end")), "handles")
    state = waiting.withColumn("b", F.col("len"))
    for _ in range(max(1, longest.bit_length() + 1)):
        state = state.withColumn("f", F.when(F.col("a") < F.col("b"), fattest("a", "b"))).withColumn(
            "key", F.when(F.col("f").isNotNull(), F.struct("f", _at("path", F.col("f")).alias("x"))))
        state = state.join(handles, "key", "left")
        whole = (F.col("h_e") <= F.col("len")) & (_at("path", F.col("h_e")) == F.col("h_end"))
        hit = F.col("h_e").isNotNull()
        through = hit & F.coalesce(whole, F.lit(False))
        state = state.select(
            "sid", "len", "path", "n",
            F.when(through, F.col("h_e")).when(hit, F.col("h_a")).otherwise(F.col("a")).alias("a"),
            F.when(through, F.col("h_r")).otherwise(F.col("at")).alias("at"),
            F.when(through, F.col("b")).when(hit, F.col("h_a")).otherwise(F.coalesce(F.col("f") - 1, F.col("b"))).alias("b"))
    heads = pieces.select(
        F.struct((F.col("a") + 1).alias("f"), _at("path", F.col("a") + 1).alias("x")).alias("key"), F.col("r").alias("h_r"),
        F.slice("path", F.col("a") + 1, F.col("e") - F.col("a")).alias("edge"))
    state = state.withColumn("key", F.when(F.col("a") < F.col("len"), F.struct((F.col("a") + 1).alias("f"), _at("path", F.col("a") + 1).alias("x"))))
    # Prefix hashes agree up to the point where two strings part, and nowhere beyond it.
    shared = F.size(F.filter(F.arrays_zip(F.col("edge").alias("x"), F.slice("path", F.col("a") + 1, F.size("edge")).alias("y")), lambda z: z["x"] == z["y"]))
    return state.join(heads, "key", "left").select(
        "sid", "len", "path", "n", F.when(F.col("h_r").isNotNull(), F.col("a") + shared).otherwise(F.col("a")).alias("m"),
        F.coalesce("h_r", "at").alias("at"))


def compacted(strings: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Insert all strings (``sid, len, path, n``): the segments of every round, and the strings that ended inside others.

    A segment is a string's edge as it was inserted: turns after depth ``m``, hanging on string ``up``.
    """
    longest = strings.agg(F.max("len")).first()[0] or 0
    waiting = strings.withColumn("a", F.lit(0)).withColumn("at", F.lit(None).cast("long"))
    rounds: list[DataFrame] = []
    ended: list[DataFrame] = []
    cuts: list[DataFrame] = []
    while True:
        if rounds:
            pieces = _pieces(reduce(DataFrame.unionByName, rounds), reduce(DataFrame.unionByName, cuts))
            found = _locate(waiting, pieces, longest)
        else:
            found = waiting.withColumnRenamed("a", "m")
        found = stored(found, "located")
        going = found.filter("m < len")
        chosen = going.groupBy(F.struct("m", _at("path", F.col("m") + 1).alias("x")).alias("next")).agg(
            F.min(F.struct(F.xxhash64("sid", F.lit(len(rounds))).alias("draw"), "sid")).alias("first")).select(F.col("first.sid").alias("sid"))
        new = stored(going.join(chosen, "sid", "left_semi").select(
            "sid", "len", "path", "n", "m", F.col("at").alias("up"), F.lit(len(rounds)).alias("round")), "segments")
        here = found.filter("m = len")
        ended.append(here)
        inserted, left = new.count(), going.count()
        if inserted:
            rounds.append(new)
        if inserted == left:
            break
        cuts.append(here.unionByName(going).filter("at is not null").select(F.col("at").alias("r"), "m").distinct())
        waiting = going.join(chosen, "sid", "left_anti").select("sid", "len", "path", "n", F.col("m").alias("a"), "at")
    return rounds, reduce(DataFrame.unionByName, ended).select("sid", "n", "m", "at")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each run of equal keys; a run is hashed as it streams by and never held."""
    key, run = None, None
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        d, p, q, found = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int32()), pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(found, pa.string())], names=["d", "p", "q", "ends_sha256"])

    for batch in batches:
        for *now, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if run is not None:
                    out.append((*key, run.hexdigest()))
                key, run = now, hashlib.sha256(str(conv_id).encode())
            else:
                run.update(b",%d" % conv_id)
        if len(out) >= 10_000:
            yield batch_of(out)
            out = []
    if run is not None:
        out.append((*key, run.hexdigest()))
    yield batch_of(out)


def ends(convs: DataFrame) -> DataFrame:
    """``d, p, q, ends_sha256``: hash of the ascending ids of the conversations that end at a node.

    SHA-256 must read its text in order, so the ids of one node pass through one task, as a stream.
    """
    last = _at("path", F.col("len"))
    keyed = convs.select(F.col("len").alias("d"), F.coalesce(last["p"], F.lit(0)).alias("p"), F.coalesce(last["q"], F.lit(0)).alias("q"), "conv_id")
    return keyed.repartition("d", "p", "q").sortWithinPartitions("d", "p", "q", "conv_id").mapInArrow(
        _hashes, "d int, p bigint, q bigint, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """All nodes of the prefix trie of ``convs`` (``conv_id, own``: hashed turns), the root included.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    convs = stored(convs.mapInArrow(_prefixes, f"conv_id bigint, len int, path {TURNS}"), "paths")
    strings = stored(convs.filter("len > 0").groupBy("len", _at("path", F.col("len")).alias("last")).agg(
        F.min("conv_id").alias("sid"), F.count("*").alias("n"), F.first("path").alias("path")).select("sid", "len", "path", "n"), "strings")
    rounds, ended = compacted(strings)
    zero = F.lit(0).cast("long")
    inside = ended.filter("at is not null").select(
        F.col("at").alias("r"), F.col("m").alias("d"), "n", F.col("sid").alias("low"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"))
    given = [inside]
    up = Window.partitionBy("r").orderBy(F.desc("d"))
    below = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes: list[DataFrame] = []
    for segments in reversed(rounds):
        edge = segments.select(F.col("sid").alias("r"), "up", "m", "len", F.col("n").alias("own"), F.posexplode(
            F.slice("path", F.col("m") + 1, F.col("len") - F.col("m"))).alias("place", "x")).withColumn("d", F.col("m") + F.col("place") + 1)
        added = reduce(DataFrame.unionByName, given).groupBy("r", "d").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), *[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")])
        here = edge.join(added, ["r", "d"], "left")
        own = F.col("d") == F.col("len")
        here = here.withColumn("kids", F.coalesce("kids", zero))
        here = here.withColumn("n", F.sum(F.coalesce("n", zero) + F.when(own, F.col("own")).otherwise(zero)).over(below)).withColumn(
            "low", F.min(F.least("low", F.when(own, F.col("r")))).over(below)).withColumn(
            "leaves", F.sum(F.coalesce("leaves", zero) + F.when(own & (F.col("kids") == 0), 1).otherwise(0)).over(below))
        here = here.withColumn("saved", F.sum(F.coalesce("saved", zero) + (F.col("n") - 1) * F.col("x.w")).over(below)).withColumn("above", F.lead("low").over(up))
        here = stored(here.select("r", "d", "up", "m", "x", "n", "low", (F.col("kids") + (~own).cast("long")).alias("children"), "kids", "leaves", "saved", "above"), "nodes")
        nodes.append(here)
        given.append(here.filter("d = m + 1 and up is not null").select(
            F.col("up").alias("r"), F.col("m").alias("d"), "n", "low", F.lit(1).cast("long").alias("kids"), "leaves", "saved"))
    every = reduce(DataFrame.unionByName, nodes) if nodes else None
    total, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    children, leaves, saved = every.filter("d = m + 1 and up is null").agg(
        F.count("*"), F.sum("leaves"), F.sum("saved")).first() if nodes else (0, 1, 0)
    number = lambda value: F.lit(value).cast("long")
    rows = convs.sparkSession.range(1 if total else 0).select(
        F.lit(0).alias("d"), F.lit(None).cast("struct<p:bigint,q:bigint,w:int>").alias("x"), number(total).alias("n"), number(least).alias("low"),
        number(children).alias("children"), number(leaves).alias("leaves"), number(saved).alias("saved"), number(None).alias("above"))
    if nodes:
        top = every.filter("d = m + 1")
        parents = every.filter("kids > 0").select(F.col("r").alias("up"), F.col("d").alias("m"), F.col("low").alias("above"))
        hung = top.filter("up is not null").drop("above").join(parents, ["up", "m"], "left")
        first = top.filter("up is null").withColumn("above", number(least))
        rows = reduce(DataFrame.unionByName, [rows, *(df.select(rows.columns) for df in (every.filter("d > m + 1"), hung, first))])
    rows = rows.select("*", F.coalesce("x.p", zero).alias("p"), F.coalesce("x.q", zero).alias("q"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    long = lambda name, to: F.col(name).cast("long").alias(to)
    return rows.join(ends(convs), ["d", "p", "q"], "left").select(
        long("low", "conv_id"), long("d", "depth"), long("above", "parent_conv_id"), long("n", "n_convs"), long("children", "n_children"),
        long("leaves", "n_leaves"), long("saved", "saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def prefix_trie(table: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Trie of the rebuilt conversations of ``conv_id, turn, role, text``; other columns are ignored.

    Turns are ordered by ``turn``, null first, equal ones by a hash of role and text; null role or text
    counts as empty, repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation and are left out; an empty table has no nodes, not even a root.
    """
    return trie(rebuilt(table, group, heads))
