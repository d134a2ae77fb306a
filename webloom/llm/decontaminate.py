"""Benchmark decontamination by greedy string tiling.

Test items are taken in blocks of bounded size, one block after the other. The tokens of a block
become a table of seeds (runs of ``min_match`` tokens) that is broadcast; whole documents look
their own runs up in it, and the block is let go before the next one is read.
Only items of which the shared seeds could cover enough tokens are tiled: running Karp-Rabin
matching finds the longest common run of unmarked tokens, marks it in both, and repeats with
shorter runs down to ``min_match``. Tiles never overlap and may stand in any order, so a passage
whose parts were moved is still covered. An item is leaked if its tiles cover ``coverage`` of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import stored

TOKEN = re.compile(r"\w+")
PRIME, BASES = (1 << 31) - 1, (1_000_003, 48_271)
INVERSES = tuple(pow(base, -1, PRIME) for base in BASES)
POWERS: dict[int, np.ndarray] = {}
#: Bytes of test text in one broadcast block.
BLOCK_BYTES = 8 << 20


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Rolled:
    """Karp-Rabin hashes of the runs of an array of token numbers, of any size, equal for equal runs of any array.

    The sums ``x[0] + x[1] B + x[2] B^2 + ...`` are rolled over the array once, for two bases; a
    run's hash is the difference of the sums at its ends, brought down to power zero.
    """

    def __init__(self, numbers: np.ndarray):
        self.count = len(numbers)
        self.sums = [np.append(0, np.cumsum((numbers + 1) * _powers(base, self.count) % PRIME)) for base in BASES]
        self.down = [_powers(base, self.count) for base in INVERSES]

    def runs(self, size: int) -> np.ndarray:
        """Hash of every run of ``size`` tokens."""
        n = self.count - size + 1
        if n < 1:
            return np.zeros(0, np.int64)
        one, two = ((s[size:] - s[:n]) % PRIME * d[:n] % PRIME for s, d in zip(self.sums, self.down))
        return one << 31 | two


def _powers(base: int, count: int) -> np.ndarray:
    """The first powers of a base; a task keeps the longest array that it has needed."""
    found = POWERS.get(base, np.ones(1, np.int64))
    while len(found) < count:
        found = np.concatenate([found, found * pow(base, len(found), PRIME) % PRIME])
    POWERS[base] = found
    return found[:count]


def _open_from(marked: np.ndarray) -> np.ndarray:
    """Unmarked tokens from each place on, up to the next marked one or the end."""
    stops = np.append(np.flatnonzero(marked), len(marked))
    here = np.arange(len(marked))
    return stops[np.searchsorted(stops, here)] - here


def tiles(document: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two token-id arrays: (start in document, start in item, length), longest first.

    Runs of equal length are marked in order of their place in the item, then in the document.
    Each length takes a few passes over the arrays, also where they repeat one token throughout.
    """
    item_hashes = Rolled(item)
    # Tokens outside shared seeds are in no tile: of a stretch of them one stays, marked from the start.
    seeds = np.flatnonzero(np.isin(Rolled(document).runs(min_match), item_hashes.runs(min_match)))
    change = np.zeros(len(document) + 1, np.int64)
    np.add.at(change, seeds, 1)
    np.add.at(change, seeds + min_match, -1)
    inside = np.cumsum(change[:-1]) > 0
    places = np.flatnonzero(inside | np.append(False, inside[:-1]))
    document, marked_doc, marked_item = document[places], ~inside[places], np.zeros(len(item), bool)
    hashes = Rolled(document)
    found: list[tuple[int, int, int]] = []
    length = len(item) + 1
    while True:
        open_doc, open_item = _open_from(marked_doc), _open_from(marked_item)

        def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Open runs of the item that the document has open too, and the document's runs."""
            at, spots = np.flatnonzero(open_item >= size), np.flatnonzero(open_doc >= size)
            have = hashes.runs(size)[spots]
            wanted = item_hashes.runs(size)[at]
            return at[np.isin(wanted, have)], spots, have

        # The longest open common run: shorter parts of a common run are common as well.
        low, high = min_match - 1, min(length - 1, open_doc.max(initial=0), open_item.max(initial=0))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        length = low
        if length < min_match:
            return found
        at, spots, have = common(length)
        order = np.argsort(have, kind="stable")
        have, spots = have[order], spots[order]
        wanted = item_hashes.runs(length)[at]
        first, last = (np.searchsorted(have, wanted, side).tolist() for side in ("left", "right"))
        following: dict[int, int] = {}
        # No tile is shorter than this length, so one that meets a run covers an end of it.
        for i, begin, end in zip(at.tolist(), first, last):
            if marked_item[i] or marked_item[i + length - 1]:
                continue
            k = following.get(begin, begin)
            while k < end and (marked_doc[spots[k]] or marked_doc[spots[k] + length - 1]):
                k += 1
            following[begin] = k
            if k < end and np.array_equal(document[spots[k]:spots[k] + length], item[i:i + length]):
                marked_doc[spots[k]:spots[k] + length] = True
                marked_item[i:i + length] = True
                found.append((int(places[spots[k]]), i, length))


class Block:
    """Seeds of a block of items: token numbers, sorted seed hashes and where they stand."""

    def __init__(self, items: list[tuple[object, list[str]]], min_match: int):
        self.words: dict[str, int] = {}
        self.ids, self.min_match = [i for i, _ in items], min_match
        self.starts = np.cumsum([0, *(len(w) for _, w in items)])
        self.numbers = np.array([self.words.setdefault(w, len(self.words) + 1) for _, words in items for w in words], np.int64)
        hashes = Rolled(self.numbers).runs(min_match)
        spots = np.arange(len(hashes))
        whole = self._item_of(spots) == self._item_of(spots + min_match - 1)
        order = np.argsort(hashes[whole], kind="stable")
        self.hashes, self.spots = hashes[whole][order], spots[whole][order]

    def _item_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def leaks(self, text: str | None, coverage: float) -> Iterator[tuple[object, int, int, int]]:
        """Leaked items of a text: item id, tiles, covered tokens, tokens of the item."""
        number = self.words.get
        document = np.array([number(w, 0) for w in tokens(text)], np.int64)  # 0: in no item
        hashes = Rolled(document).runs(self.min_match)
        if not len(hashes) or not len(self.hashes):
            return
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hashes = np.unique(hashes[self.hashes[near] == hashes])
        if not len(hashes):
            return
        first, last = (np.searchsorted(self.hashes, hashes, side) for side in ("left", "right"))
        counts = last - first
        # The places of all shared seeds in the items, and the tokens that they cover.
        offsets = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        covered = np.unique(self.spots[offsets][:, None] + np.arange(self.min_match))
        for n, reach in zip(*(x.tolist() for x in np.unique(self._item_of(covered), return_counts=True))):
            item = self.numbers[self.starts[n]:self.starts[n + 1]]
            if reach >= coverage * len(item):
                marks = tiles(document, item, self.min_match)
                total = sum(length for _, _, length in marks)
                if total >= coverage * len(item):
                    yield self.ids[n], len(marks), total, len(item)


def _found(docs: DataFrame, block: Block, item_type: T.DataType, coverage: float) -> DataFrame:
    """Leaked items of one block, written before the block's broadcast is taken back."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            rows, found = [], []
            for n, text in enumerate(batch.column(2).to_pylist()):
                for leak in block.leaks(text, coverage):
                    rows.append(n)
                    found.append(leak)
            if rows:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(columns[0]),
                     *[pa.array(c, pa.int64()) for c in columns[1:]]],
                    names=["doc_id", "text_hash", "item_id", "n_tiles", "covered", "n_tokens"])

    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([
        docs.schema["doc_id"], long("text_hash"), T.StructField("item_id", item_type), long("n_tiles"), long("covered"), long("n_tokens")])
    found = stored(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(search, schema), "leaks")
    shared.unpersist()
    return found


def leaked_items(docs: DataFrame, benchmark: DataFrame, min_match: int = 4, coverage: float = 0.7,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, n_tiles, covered, n_tokens`` for every document row that covers an item.

    ``benchmark`` has item_id and text. Items with fewer than ``min_match`` tokens, null and empty
    texts match nothing; rows with a null id are searched like others; repeated documents give
    repeated rows, repeated items count once. Empty tables give no rows. Tokens are word
    characters in lower case, so punctuation and line breaks do not matter. The benchmark is
    broadcast in blocks of ``block_bytes``; each block is one pass over the documents. A very long
    or repetitive text costs passes over its tokens, not pairs of places.
    """
    return _leaks(docs, benchmark, min_match, coverage, block_bytes).drop("text_hash")


def _leaks(docs: DataFrame, benchmark: DataFrame, min_match: int, coverage: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The leaked items with the ``text_hash`` of the row that covers them."""
    if not 0 < coverage <= 1 or min_match < 1:
        raise ValueError("coverage must be in (0, 1], min_match positive")
    items = benchmark.select("item_id", "text").filter("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for n in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n).collect()
        texts = sorted(((r["item_id"], tokens(r["text"])) for r in rows), key=lambda x: (x[0] is None, x[0], x[1]))
        texts = [(i, w) for i, w in texts if len(w) >= min_match]
        if texts or n == blocks - 1:
            found.append(_found(docs, Block(texts, min_match), benchmark.schema["item_id"].dataType, coverage))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_match: int = 4, coverage: float = 0.7) -> DataFrame:
    """``docs`` without the rows that cover a test item; rows are matched by doc_id (null included) and text."""
    leaked = _leaks(docs, benchmark, min_match, coverage).select(F.col("doc_id").alias("leaked_id"), "text_hash").distinct()
    return docs.join(
        leaked, docs["doc_id"].eqNullSafe(leaked["leaked_id"]) & (F.xxhash64(docs["text"]) == leaked["text_hash"]), "left_anti")
