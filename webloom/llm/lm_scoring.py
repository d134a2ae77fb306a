"""Document likelihood under a subword lattice, next to a word-unigram base score.

The subword inventory is an existing public one; its scores give the first weights of its
pieces, and expectation maximisation over the words of the training documents turns them into
probabilities. A word's probability sums over all its segmentations by a forward recursion in log
space, a document's is the product over its words and the end. White space always separates
pieces, so the document lattice is the chain of its word lattices.

All words form a table with their training count and their lattice probability, which is
computed once per word. Words with at least ``share`` of all training tokens, at most
``1 / share`` of them, are broadcast; the other words of a document are joined to the table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from webloom.llm.common import stored

NONE = -math.inf
SMOOTHING = 0.1
#: Words that a counting task holds before it sends them on.
REMEMBERED = 300_000


def load_pieces(model_file: str) -> tuple[list[str], list[float]]:
    """Pieces of a public subword model and their scores; byte pieces read ``<0xNN>``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    wanted = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i)]
    return [model.id_to_piece(i) for i in wanted], [model.get_score(i) for i in wanted]


def first_weights(scores: list[float]) -> np.ndarray:
    """Probabilities from the order of the existing scores: the n-th best weighs 1 / (n + 10)."""
    rank = np.empty(len(scores))
    rank[np.argsort(-np.array(scores), kind="stable")] = np.arange(len(scores))
    weight = 1 / (rank + 10)
    return weight / weight.sum()


def _log_add(a: float, b: float) -> float:
    if a == NONE:
        return b
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


class Lattice:
    """All segmentations of words into pieces; characters without a piece are spelt in byte pieces."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.bytes = [-1] * 256
        self.index: dict[str, int] = {}  # pieces by number, and -1 for what only begins a piece
        for i, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x"):
                self.bytes[int(p[3:5], 16)] = i
            else:
                for k in range(1, len(p)):
                    self.index.setdefault(p[:k], -1)
                self.index[p] = i
        self.log_p = log_p.tolist()
        self.p = np.exp(log_p).tolist()
        self.floor = min(self.log_p, default=-20.0)

    def spelt(self, char: str) -> tuple[list[int], float]:
        ids = [self.bytes[b] for b in char.encode()]
        return ids, sum(self.log_p[i] if i >= 0 else self.floor for i in ids)

    def arcs(self, s: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) in order of their starts; piece -1 spells a single character."""
        get, size, found = self.index.get, len(s), []
        for i in range(size):
            spell = True
            for j in range(i + 1, size + 1):
                k = get(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    found.append((i, j, k))
                    if j == i + 1:
                        spell = False
            if spell:
                found.append((i, i + 1, -1))
        return found

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the sum over all segmentations, by a forward recursion in log space.

        Pieces are found and added up in one go: a place's sum is complete when its own pieces begin.
        """
        s = "▁" + word
        get, log_p, size, exp, log1p = self.index.get, self.log_p, len(s), math.exp, math.log1p
        alpha = [NONE] * (size + 1)
        alpha[0] = 0.0
        for i in range(size):
            here, spell = alpha[i], True
            for j in range(i + 1, size + 1):
                k = get(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    if j == i + 1:
                        spell = False
                    new, old = here + log_p[k], alpha[j]
                    if old == NONE:
                        alpha[j] = new
                    else:
                        alpha[j] = old + log1p(exp(new - old)) if old >= new else new + log1p(exp(old - new))
            if spell:
                alpha[i + 1] = _log_add(alpha[i + 1], here + self.spelt(s[i])[1])
        return alpha[-1]

    def expect(self, word: str, weight: float, counts: list[float]) -> None:
        """Add the expected uses of every piece in a word that occurs ``weight`` times.

        Plain probabilities serve as long as they are far from underflow, logarithms otherwise.
        """
        s = "▁" + word
        get, p, size, arcs = self.index.get, self.p, len(s), []
        alpha, beta = [0.0] * (size + 1), [0.0] * (size + 1)
        alpha[0] = beta[-1] = 1.0
        for i in range(size):
            here, spell = alpha[i], True
            for j in range(i + 1, size + 1):
                k = get(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    w = p[k]
                    alpha[j] += here * w
                    arcs.append((i, j, k, w))
                    if j == i + 1:
                        spell = False
            if spell:
                w = math.exp(self.spelt(s[i])[1])
                alpha[i + 1] += here * w
                arcs.append((i, i + 1, -1, w))
        whole = alpha[-1]
        if whole < 1e-250:
            return self._expect_long(s, [arc[:3] for arc in arcs], weight, counts)
        share = weight / whole
        for i, j, k, w in reversed(arcs):
            through = w * beta[j]
            beta[i] += through
            uses = alpha[i] * through * share
            if k >= 0:
                counts[k] += uses
            else:
                self._spell(s[i], uses, counts)

    def _expect_long(self, s: str, arcs: list[tuple[int, int, int]], weight: float, counts: list[float]) -> None:
        alpha, beta = [NONE] * (len(s) + 1), [NONE] * (len(s) + 1)
        alpha[0] = beta[-1] = 0.0
        weights = [self.log_p[k] if k >= 0 else self.spelt(s[i])[1] for i, _, k in arcs]
        for (i, j, _), w in zip(arcs, weights):
            alpha[j] = _log_add(alpha[j], alpha[i] + w)
        for (i, j, k), w in zip(reversed(arcs), reversed(weights)):
            through = w + beta[j]
            beta[i] = _log_add(beta[i], through)
            uses = weight * math.exp(alpha[i] + through - alpha[-1])
            if k >= 0:
                counts[k] += uses
            else:
                self._spell(s[i], uses, counts)

    def _spell(self, char: str, uses: float, counts: list[float]) -> None:
        for k in self.spelt(char)[0]:
            if k >= 0:
                counts[k] += uses


@dataclass
class Model:
    """Subword probabilities and the word counts of the training documents.

    Words that only other documents hold have a count of 0; they are there to be rated.
    """

    pieces: list[str]
    log_p: np.ndarray
    log_end: float
    counts: DataFrame  # word, key, n
    tokens: int
    types: int
    documents: int


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, as UTF-8."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, training: Column) -> DataFrame:
    """``word, key, n`` over whole texts of all rows; ``n`` counts in the ``training`` rows alone. Each task sums before it sends."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        others: set = set()

        def flush() -> pa.RecordBatch:
            others.difference_update(held)
            words = [*held, *others]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in words], pa.string()),
                 pa.array(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)),
                 pa.array([*held.values(), *[0] * len(others)], pa.int64())], names=["word", "key", "n"])
            held.clear()
            others.clear()
            return batch

        for batch in batches:
            for text, learnt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (held if learnt else others).update(words_of(text))
                if len(held) + len(others) > REMEMBERED:
                    yield flush()
        if held or others:
            yield flush()

    found = docs.select("text", F.coalesce(training, F.lit(False)).alias("learnt")).mapInArrow(count, "word string, key long, n long")
    return found.groupBy("word", "key").agg(F.sum("n").alias("n"))


def _expected(counts: DataFrame, pieces: list[str], log_p: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in all counted words; one number per piece reaches the driver."""
    shared = counts.sparkSession.sparkContext.broadcast((pieces, log_p))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, log_p = shared.value
        lattice = Lattice(pieces, log_p)
        total = [0.0] * len(pieces)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.expect(word, n, total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(np.array(total)[used])], names=["piece", "uses"])

    rows = counts.select("word", "n").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
    found = np.zeros(len(pieces))
    for r in rows:
        found[r["piece"]] = r["uses"]
    return found


def train(docs: DataFrame, pieces: list[str], scores: list[float], rounds: int = 2, training: Column | None = None) -> Model:
    """Learn piece probabilities and word counts from the texts of all ``training`` rows (by default every row).

    The words of the other rows are noted in the same pass, so that ``score`` need not read them again.
    """
    training = F.lit(True) if training is None else training
    counts = stored(word_counts(docs, training), "words")
    learnt = counts.filter("n > 0")
    words, types = learnt.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    documents = docs.filter(training).count()
    weights, end = first_weights(scores), 0.5
    for _ in range(rounds):
        uses = _expected(learnt, pieces, np.log(weights)) + SMOOTHING
        total = uses.sum() + documents + SMOOTHING
        weights, end = uses / total, (documents + SMOOTHING) / total
    return Model(pieces, np.log(weights), math.log(end), counts, words + documents, types + (documents > 0), documents)


def _rated(docs: DataFrame, model: Model, counted: bool) -> DataFrame:
    """``key, n, log_p`` of every word in ``docs`` or the training texts: training count and lattice probability.

    The lattice of a word is computed once, however often and wherever the word occurs.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.log_p))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            found = [lattice.log_probability(w) for w in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["key", "n", "log_p"])

    every = model.counts
    if not counted:
        every = every.unionByName(word_counts(docs, F.lit(False))).groupBy("word", "key").agg(F.sum("n").alias("n"))
    return stored(every.select("key", "n", "word").mapInArrow(rate, "key long, n long, log_p double"), "rated")


def score(docs: DataFrame, model: Model, share: float = 5e-7, counted: bool = False) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` for every row of ``docs``.

    Tokens are the words and one end. ``base_score`` is the word-unigram log10 probability with
    one added to every count, ``score`` the log10 probability of the lattice model. Null and empty
    texts are the end alone. Rows with a null or repeated doc_id are scored one by one, an empty table gives none;
    a text of any length is one row of counts. ``counted`` says that ``docs`` are the rows given to ``train``, whose words are known.
    """
    context = docs.sparkSession.sparkContext
    rated = _rated(docs, model, counted)
    bound = max(1, math.ceil(model.tokens * share))
    frequent = rated.filter(F.col("n") >= bound).toArrow()  # at most 1 / share rows
    keys, n, log_p = (frequent.column(c).to_numpy() for c in ("key", "n", "log_p"))
    order = np.argsort(keys)
    shared = context.broadcast((keys[order], n[order], log_p[order]))
    documents, log_end, divisor = model.documents, model.log_end, model.tokens + model.types + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, log_p = shared.value
        gains = np.log10((n + 1) / divisor)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(2).to_pylist():
                    words = words_of(text)
                    hashed, times = np.unique(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64), return_counts=True)
                    there, place = np.zeros(len(hashed), bool), np.zeros(len(hashed), np.int64)
                    if len(keys):
                        place = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
                        there = keys[place] == hashed
                    known, sure = place[there], times[there]
                    rows.append((len(words) + 1, int(sure.sum()) + (documents > 0), math.log10((documents + 1) / divisor) + float(sure @ gains[known]),
                                 log_end + float(sure @ log_p[known]), hashed[~there], times[~there]))
                a, b, c, d, e, f = zip(*rows) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64()),
                     pa.array(d, pa.float64()), pa.array(e, pa.list_(pa.int64())), pa.array(f, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n_tokens", "sure_known", "sure", "sure_log", "keys", "times"])

    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("row", "n_tokens", "sure_known")]
                          + [T.StructField(n, T.DoubleType()) for n in ("sure", "sure_log")]
                          + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("keys", "times")])
    summed = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(sums, schema), "scored")
    rare = summed.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("row", F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    seen = rare.join(rated.filter(F.col("n") < bound), "key").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(divisor))).alias("more"),
        F.sum(F.col("times") * F.col("log_p")).alias("more_log"))
    return summed.select("doc_id", "row", "n_tokens", "sure_known", "sure", "sure_log").join(seen, "row", "left").select(
        "doc_id", "n_tokens", (F.col("sure_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("sure") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        ((F.col("sure_log") + F.coalesce("more_log", F.lit(0.0))) / math.log(10)).alias("score"))


def remainder(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts
