"""Language of documents and of their words by a linear-chain conditional random field.

A word's evidence comes from hashed affix, character n-gram and lexicon (whole word) features,
neighbouring words are tied by learned transitions, and forward-backward gives every word its
distribution over the languages. Training sequences are spliced from short stretches of documents
of different languages, so that transitions learn to switch inside a text. The model is fitted
on a bounded sample: about ``per_language`` documents of every language and ``window`` words of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import words

BUCKETS = 1 << 15
#: Entries of a worker's memory of words, and cells (documents x words) of one forward-backward run.
REMEMBERED, CELLS = 500_000, 400_000
#: UTF-8 bytes of text whose words a worker holds at a time, but for a single larger text.
HELD = 8 << 20
UNKNOWN = "und"
#: The sample is drawn from so many values of a hash of the doc_id.
DRAWS = 1 << 50


STRIPPED = ".,;:!?\"'()[]{}«»„“”-–*#$%&|<>"
#: Odd multipliers of the feature hashes.
STEP, KIND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _number(kind: int, code: np.ndarray) -> np.ndarray:
    """Bucket of a feature of one kind; bucket 0 is left to words without a letter."""
    code = (code + np.uint64(kind * int(KIND) % 2**64)) * STEP
    code = (code ^ (code >> np.uint64(31))) * KIND
    return ((code >> np.uint64(33)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and number of every feature of the words, and which words have a letter.

    A word has its whole form, its first and last one to three characters, and the pairs and triples of its
    characters between marks for its beginning and end; one without a letter has bucket 0 alone.
    """
    cores = [w.lower().strip(STRIPPED) for w in words]
    lettered = np.fromiter((c.isalpha() or any(map(str.isalpha, c)) for c in cores), bool, len(cores))
    who = np.flatnonzero(lettered)
    codes = np.frombuffer("".join(f"^{cores[k]}$" for k in who).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(cores[k]) + 2 for k in who), np.int64, len(who))
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(who) else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(who)), sizes)
    place = np.arange(len(codes)) - begins[word] if len(who) else np.zeros(0, np.int64)
    left = sizes[word] - place if len(who) else np.zeros(0, np.int64)  # characters from here to the end
    pair = codes[:-1] * STEP + codes[1:]
    triple = pair[:-1] * STEP + codes[2:]
    owners, numbers = [np.flatnonzero(~lettered)], [np.zeros(int((~lettered).sum()), np.int32)]

    def add(owner: np.ndarray, kind: int, code: np.ndarray) -> None:
        owners.append(who[owner])
        numbers.append(_number(kind, code))

    if len(who):
        mixed = _number(0, codes + place.astype(np.uint64) * KIND).astype(np.uint64) + codes * STEP
        add(np.arange(len(who)), 1, np.add.reduceat(mixed * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), begins))
        for k in range(1, 4):  # a short word's affixes are the word itself
            size = np.minimum(k, sizes - 2)
            head, tail = np.zeros(len(who), np.uint64), np.zeros(len(who), np.uint64)
            for n in range(k):
                there = n < size
                head = np.where(there, head * STEP + codes[np.minimum(begins + 1 + n, len(codes) - 1)], head)
                tail = np.where(there, tail * STEP + codes[begins + sizes - 1 - size + np.minimum(n, size - 1)], tail)
            add(np.arange(len(who)), 1 + k, head)
            add(np.arange(len(who)), 4 + k, tail)
        two, three = np.flatnonzero(left > 1), np.flatnonzero(left > 2)
        add(word[two], 8, pair[two])
        add(word[three], 9, triple[three])
    return np.concatenate(owners), np.concatenate(numbers), lettered


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # feature x language
    transitions: np.ndarray  # from x to, logarithms
    start: np.ndarray

    def evidence(self, owner: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        """Summed weights per word and language."""
        return np.stack([np.bincount(owner, self.weights[number, k], n) for k in range(len(self.languages))], axis=1).astype(np.float32)


def posteriors(evidence: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Word distributions alone, (place, language, row), for the same layout of ``evidence``; what prediction needs of ``forward_backward``."""
    places, _, rows = evidence.shape
    e = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    a = np.exp(transitions).astype(e.dtype)
    into, out = np.ascontiguousarray(a.T), np.ascontiguousarray(a)
    forward = np.empty_like(e)
    now = np.exp(start).astype(e.dtype)[:, None] * e[0]
    for t in range(places):
        if t:
            np.matmul(into, forward[t - 1], out=now)
            now *= e[t]
        np.divide(now, now.sum(axis=0), out=forward[t])
    back = np.ones_like(now)
    short = int(lengths.min())
    for t in range(places - 1, -1, -1):
        if t < places - 1:
            step = e[t + 1] * back
            step /= step.sum(axis=0)
            np.matmul(out, step, out=back)
            if t + 1 >= short:  # nothing follows the last word of a shorter row
                back[:, lengths <= t + 1] = 1
        forward[t] *= back
        forward[t] /= forward[t].sum(axis=0)
    return forward


def forward_backward(evidence: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word distributions (place, row, language), expected transitions and log partition sums.

    ``evidence`` is (place, row, language); rows are padded at their end. Forward and backward
    values are scaled to sum to one at every place.
    """
    places, rows, size = evidence.shape
    top = evidence.max(axis=2, keepdims=True)
    e = np.exp(evidence - top)
    a = np.exp(transitions)
    forward = np.empty_like(e)
    scale = np.empty((places, rows, 1))
    now = np.exp(start) * e[0]
    for t in range(places):
        if t:
            now = (forward[t - 1] @ a) * e[t]
        scale[t] = now.sum(axis=1, keepdims=True)
        forward[t] = now / scale[t]
    gamma = np.empty_like(e)
    pairs = np.zeros((size, size))
    back = np.ones((rows, size))
    inside = np.arange(places)[:, None] < lengths[None]
    for t in range(places - 1, -1, -1):
        gamma[t] = forward[t] * back
        if t:
            step = e[t] * back / scale[t]
            live = inside[t][:, None]
            pairs += a * ((forward[t - 1] * live).T @ (step * live))
            back = np.where(live, step @ a.T, 1.0)
    logs = ((np.log(scale) + top)[:, :, 0] * inside).sum(axis=0)
    return gamma, pairs, logs


def fit(samples: list[tuple[str, list[str]]], rounds: int = 40, length: int = 64, seed: int = 5) -> Model:
    """Maximum likelihood with a Gaussian prior, by Adam over all spliced sequences."""
    draws = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in samples})
    number = {lang: i for i, lang in enumerate(languages)}
    parts = []
    for lang, found in samples:
        at = 0
        while at < len(found):
            size = int(draws.integers(5, 40))
            parts.append([(w, number[lang]) for w in found[at:at + size]])
            at += size
    draws.shuffle(parts)
    stream = [x for p in parts for x in p]
    rows = max(1, -(-len(stream) // length))
    size = len(languages)
    known: dict[str, int] = {}
    at = np.zeros((length, rows), np.int64)
    label = np.zeros((length, rows), np.int64)
    lengths = np.zeros(rows, np.int64)
    for k, (w, y) in enumerate(stream):
        at[k % length, k // length] = known.setdefault(w, len(known))
        label[k % length, k // length] = y
        lengths[k // length] += 1
    inside = np.arange(length)[:, None] < lengths[None]
    owner, flat, _ = features(list(known))
    model = Model(languages, np.zeros((BUCKETS, size)), np.zeros((size, size)), np.zeros(size))
    gold = np.eye(size)[label] * inside[:, :, None]
    gold_pairs = np.einsum("tri,trj->ij", gold[:-1], gold[1:])
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.transitions, model.start)]
    for round_ in range(1, rounds + 1):
        rated = model.evidence(owner, flat, len(known)).astype(np.float64)
        gamma, pairs, _ = forward_backward(rated[at], lengths, model.transitions, model.start)
        error = (gold - gamma * inside[:, :, None])
        by_word = np.stack([np.bincount(at.ravel(), error[:, :, k].ravel(), len(known)) for k in range(size)], axis=1)
        slope = np.stack([np.bincount(flat, by_word[owner, k], BUCKETS) for k in range(size)], axis=1)
        steps = [slope - 0.05 * model.weights, gold_pairs - pairs - 0.05 * model.transitions, error[0].sum(axis=0) - 0.05 * model.start]
        for value, step, (mean, square) in zip((model.weights, model.transitions, model.start), steps, moments):
            mean += 0.1 * (step - mean)
            square += 0.01 * (step * step - square)
            value += 0.2 * (mean / (1 - 0.9**round_)) / (np.sqrt(square / (1 - 0.99**round_)) + 1e-8)
    model.weights = model.weights.astype(np.float32)
    return model


def sample(docs: DataFrame, per_language: int = 300, window: int = 120) -> list[tuple[str, list[str]]]:
    """About ``per_language`` labelled documents of each language, chosen by a hash of id and text, and a stretch of words of each."""
    labelled = docs.filter("lang is not null and text is not null")
    share = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return []
    # The text counts too, else rows with one id, or none, would be drawn all together.
    mark = F.xxhash64("doc_id", "text", F.lit(77))
    draw = F.pmod(mark, F.lit(DRAWS))
    wanted = F.create_map(*[x for lang, n in share.items() for x in (F.lit(lang), F.lit(min(DRAWS, per_language * DRAWS // n)))])
    chosen = labelled.filter(draw < F.element_at(wanted, F.col("lang"))).select("lang", F.xxhash64(mark).alias("h"), words(F.col("text")).alias("w"))
    begin = F.pmod("h", F.greatest(F.size("w") - window, F.lit(1))).cast("int") + 1
    rows = chosen.select("lang", "h", F.slice("w", begin, window).alias("w")).orderBy("h").limit(2 * per_language * len(share)).collect()
    return [(r["lang"], list(r["w"])) for r in sorted(rows, key=lambda r: (r["h"], r["lang"], r["w"])) if r["w"]]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``HELD`` bytes of text each."""
    start, held = 0, 0
    for row, size in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        held += size or 0
        if held >= HELD or row == batch.num_rows - 1:
            yield batch.slice(start, row + 1 - start)
            start, held = row + 1, 0


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row of ``docs``, from whole texts alone.

    Every word gets a distribution over the languages. ``score`` is the mean probability of the
    best language over the words that have a letter (equal ones: the first by name);
    ``spans`` are runs of words (first, past the last, language) with one most probable language. A
    text that is null or has no letter is ``und`` with score 0 and no spans. Rows with a null or
    repeated doc_id are tagged one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size = len(model.languages)
        known: dict[bytes, int] = {}
        rated, lettered = np.zeros((1, size), np.float32), np.zeros(1, bool)  # entry 0 pads

        def remember(texts: list[list[bytes]]) -> None:
            nonlocal rated, lettered
            if len(known) > REMEMBERED:
                known.clear()
                rated, lettered = rated[:1], lettered[:1]
            fresh = list({w for t in texts for w in t}.difference(known))
            if fresh:
                owner, number, letters = features([w.decode() for w in fresh])
                known.update(zip(fresh, range(len(rated), len(rated) + len(fresh))))
                rated = np.concatenate([rated, model.evidence(owner, number, len(fresh))])
                lettered = np.concatenate([lettered, letters])

        for batch in (part for whole in batches for part in parts(whole)):
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            remember(texts)
            found = [(UNKNOWN, 0.0, [])] * len(texts)
            order = sorted((len(t), n) for n, t in enumerate(texts) if t)
            at = 0
            while at < len(order):
                to = at + 1  # as many texts as fit the cells, all about equally long
                while to < len(order) and order[to][0] * (to + 1 - at) <= CELLS and order[to][0] <= 1.25 * order[at][0] + 16:
                    to += 1
                rows = [n for _, n in order[at:to]]
                lengths = np.array([size_ for size_, _ in order[at:to]])
                ids = np.zeros((lengths.max(), len(rows)), np.int64)
                for k, n in enumerate(rows):
                    ids[:lengths[k], k] = np.fromiter(map(known.__getitem__, texts[n]), np.int64, len(texts[n]))
                gamma = posteriors(np.ascontiguousarray(rated[ids].transpose(0, 2, 1)), lengths, model.transitions, model.start)
                weight = lettered[ids]
                total = np.einsum("tkr,tr->rk", gamma, weight, dtype=np.float64)
                counts = weight.sum(axis=0)
                labels = gamma.argmax(axis=1)
                for k, n in enumerate(rows):
                    if counts[k]:
                        own = labels[:lengths[k], k]
                        ends = [*(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                        spans = [{"first": a, "past": b, "lang": model.languages[own[a]]} for a, b in zip([0, *ends[:-1]], ends)]
                        best = int(total[k].argmax())
                        found[n] = (model.languages[best], min(1.0, float(total[k, best] / counts[k])), spans)
                at = to
            langs, scores, spans = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("lang", pa.string())])))],
                names=["doc_id", "lang_pred", "score", "spans"])

    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("past", T.IntegerType()), T.StructField("lang", T.StringType())])
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("spans", T.ArrayType(span))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def train(docs: DataFrame, per_language: int = 300, window: int = 120) -> Model:
    """Fit on a sample of labelled documents; without any, a model that knows no language but ``und``."""
    found = sample(docs, per_language, window)
    return fit(found) if found else Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)), np.zeros(1))
