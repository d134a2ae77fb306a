"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word between them,
hashed to 2**24 numbers. Every coordinate has its own learning rate, and the L1 term keeps all
weights at zero that a few documents alone speak for, so the model is a short list of numbers and
weights that is broadcast. The sample of labelled rows (bounded) is dealt to shards by hash; a shard is
learnt by one task, row by row, and the shards' weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

BITS = 24
#: Salts of the three kinds of features.
WORD, PAIR, SKIP = (np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
BIAS = -1
#: Words a worker remembers, and characters of a text that are split at a time.
REMEMBERED, BLOCK = 300_000, 1 << 20


class Words:
    """64-bit hashes of a text's words, each distinct word hashed once."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    @staticmethod
    def digest(word: bytes) -> int:
        return xxh64_intdigest(word.decode().lower().strip(".,;:!?\"'()[]{}«»„“”…-–*#$%&|<>~_"))

    def hashes(self, text: str) -> np.ndarray:
        """Hash of every word in order; a long text is split block by block."""
        found, at = [], 0
        while at < len(text):
            to = at + BLOCK
            if to < len(text):  # cut at a blank, so no word is torn
                to = next((k for k in range(to, len(text)) if text[k] in " \t\n\x0b\x0c\r"), len(text))
            split = text[at:to].encode().split()
            at = to
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for w in set(split).difference(self.known):
                self.known[w] = self.digest(w)
            found.append(np.fromiter(map(self.known.__getitem__, split), np.uint64, len(split)))
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _scrambled(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (value ^ (value >> np.uint64(32))) >> np.uint64(64 - BITS)


def numbers(words: np.ndarray) -> np.ndarray:
    """Feature numbers of all words, neighbours and skip-grams of a text, repeated ones included."""
    left, right = words * PAIR, words * SKIP
    parts = [_scrambled(words * WORD), _scrambled(left[:-1] + words[1:] * WORD), _scrambled(right[:-2] + words[2:] * PAIR)]
    return np.concatenate(parts).astype(np.int32)


def features(words: np.ndarray) -> np.ndarray:
    """Distinct feature numbers of a text, ascending; a long one is taken ``BLOCK`` words at a time."""
    return np.unique(np.concatenate([np.unique(numbers(words[k:k + BLOCK + 2])) for k in range(0, max(len(words), 1), BLOCK)]))


@dataclass
class Model:
    """Feature numbers with a weight (ascending), their weights, and the bias."""

    names: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        """Probability for a text with the given distinct features that have a weight."""
        total = self.bias + float(self.weights[np.searchsorted(self.names, found)].sum())
        with np.errstate(over="ignore"):
            return float(1 / (1 + np.exp(-total)))


def frequent(rows: list[np.ndarray], least: int) -> list[np.ndarray]:
    """The rows without features that fewer than ``least`` of them hold."""
    counts = np.zeros(1 << BITS, np.uint8)
    for row in rows:
        counts[row] = np.minimum(counts[row], 254) + 1
    return [row[counts[row] >= least] for row in rows]


def ftrl(rows: list[np.ndarray], labels: list[int], alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1,
         passes: int = 6) -> Model:
    """Follow the regularised leader, row by row, ``passes`` times over; rows hold distinct feature numbers."""
    names, flat = np.unique(np.concatenate([np.zeros(0, np.int32), *rows]), return_inverse=True)
    parts = np.split(flat, np.cumsum([len(r) for r in rows])[:-1]) if rows else []
    z, n = np.zeros(len(names)), np.zeros(len(names))
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    def bias():  # the bias is not drawn to zero
        return -bias_z / ((beta + np.sqrt(bias_n)) / alpha)

    for _ in range(passes):
        for at, label in zip(parts, labels):
            old_z, old_n = z[at], n[at]
            w, b = weight(old_z, old_n), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            z[at] = old_z + g - (np.sqrt(old_n + g * g) - np.sqrt(old_n)) / alpha * w
            n[at] = old_n + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    w = weight(z, n)
    used = np.flatnonzero(w)
    return Model(names[used], w[used], float(bias()))


def _learn(least: int):
    """Task of one shard after the other: rows ``shard, toxic, text`` to ``shard, feature, weight``."""

    def finish(shard: int, rows: list[np.ndarray], labels: list[int]) -> pa.RecordBatch:
        model = ftrl(frequent(rows, least if len(rows) > 50 * least else 2), labels)
        names = np.append(model.names, BIAS).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(names), shard, np.int32)), pa.array(names), pa.array(np.append(model.weights, model.bias))], names=["shard", "feature", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, rows, labels = Words(), None, [], []
        for batch in batches:
            for now, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != shard and rows:
                    yield finish(shard, rows, labels)
                    rows, labels = [], []
                shard = now
                rows.append(features(words.hashes(text)))
                labels.append(label)
        if rows:
            yield finish(shard, rows, labels)

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, shard_rows: int = 20_000, least: int = 4) -> Model:
    """Fit on at most ``most`` labelled documents, half of them of either label, drawn by a hash of the doc_id.

    The bias is corrected for the different shares drawn. ``shard_rows`` documents are learnt by one
    task, whose features must occur in ``least`` of them. Of a doc_id with several labels the highest counts, of one
    with several texts a single one drawn by hash; rows without doc_id or label teach nothing. Without any
    labelled document every score is 0.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.zeros(0, np.int32), np.zeros(0), -np.inf)
    draw = known.withColumn("draw", F.xxhash64("doc_id", F.lit(71)))
    drawn = [draw.filter(F.col("toxic") == k).orderBy("draw", "doc_id").limit(most // 2) for k in (0, 1)]
    # At most ``most`` rows of two numbers, so they can be broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    text = F.coalesce("text", F.lit(""))
    one = chosen.groupBy("doc_id").agg(F.min(F.struct("draw", F.xxhash64(text).alias("h"), "toxic", text.alias("text"))).alias("r"))
    taken = {k: min(n, most // 2) for k, n in sizes.items()}
    shards = max(1, -(-sum(taken.values()) // shard_rows))
    order = F.xxhash64("doc_id", F.lit(72))
    dealt = one.select(F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("order"), "doc_id", "r.toxic", "r.text")
    learnt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "order", "doc_id").select("shard", "toxic", "text").mapInArrow(
        _learn(least), "shard int, feature int, weight double")
    # The mean over the shards; a weight that one of them left at zero counts as zero there.
    found = learnt.groupBy("feature").agg((F.sum("weight") / shards).alias("weight")).orderBy("feature").toPandas()
    names, weights = found["feature"].to_numpy(np.int32), found["weight"].to_numpy(float)
    bias = float(weights[names == BIAS].sum())
    if len(sizes) == 2:
        bias -= float(np.log(taken[1] / sizes[1]) - np.log(taken[0] / sizes[0]))
    return Model(names[names != BIAS], weights[names != BIAS], bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``, from whole texts alone.

    Null texts count as empty and get the score of the bias. Null and repeated doc_ids keep their rows, an
    empty table gives none, other columns are ignored. A long text is read in blocks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value, Words()
        weighted = np.zeros(1 << BITS, bool)
        weighted[model.names] = True

        def rated(text: str | None) -> float:
            own = words.hashes(text or "")
            parts = (numbers(own[k:k + BLOCK + 2]) for k in range(0, len(own), BLOCK))
            hits = [part[weighted[part]] for part in parts]
            return model.score(np.unique(np.concatenate([np.zeros(0, np.int32), *hits])))

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([rated(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
