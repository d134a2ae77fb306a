"""Pairing of field sequences against all order-preserving pairings of short ones."""

import itertools
import random
import re

from webloom.operators.mining import match_sequences, matched_fields, pair_sequences


def worth(own, seed, pairs):
    tag = lambda p: re.split("[/:]", p)[-1]
    if any(own[i] != seed[j] and tag(own[i]) != tag(seed[j]) for i, j in pairs):
        return None
    equal = sum(own[i] == seed[j] for i, j in pairs)
    return equal, len(pairs) - equal, -sum(abs(i - j) for i, j in pairs)


def best(own, seed):
    found = []
    for k in range(min(len(own), len(seed)) + 1):
        for a in itertools.combinations(range(len(own)), k):
            for b in itertools.combinations(range(len(seed)), k):
                found.append(worth(own, seed, list(zip(a, b))))
    return max(w for w in found if w is not None)


def test_pairings_are_the_best_of_all():
    draw = random.Random(3)
    paths = ["0:li/a", "0:li/a/[T]", "0:li/b", "0:li/p/[T]", "1:li/p/b"]
    for _ in range(300):
        own, seed = ([draw.choice(paths) for _ in range(draw.randrange(6))] for _ in range(2))
        got = pair_sequences(own, seed)
        pairs = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert all(x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert worth(own, seed, pairs) == best(own, seed)


def test_shifted_and_missing_fields():
    seed = ["li/a", "li/b", "li/i", "li/p/[T]"]
    assert pair_sequences(["li/b", "li/i"], seed) == [1, 2]
    assert pair_sequences(["li/x", "li/a", "li/p/[T]"], seed) == [-1, 0, 3]
    assert pair_sequences(["li/a", "li/div/b", "li/i"], seed) == [0, 1, 2]  # another path, the same last tag
    assert pair_sequences([], seed) == [] and pair_sequences(["li/a"], []) == [-1]


def test_majority_of_items(spark):
    rows = [(1, 7, 1, item, key, n, item * 10 + n) for item, keys in enumerate([["0:a#0", "0:b#0", "0:c#0"], ["0:b#0", "0:c#0"], ["0:c#0"], ["0:a#0", "0:z/c#0"]]) for n, key in enumerate(keys)]
    fields = spark.createDataFrame(rows, "page_id long, label long, parent long, item long, key string, column long, node long")
    got = {r["key"]: (r["present"], r["items"]) for r in match_sequences(fields).collect()}
    assert got == {"0:a#0": (2, 4), "0:b#0": (2, 4), "0:c#0": (4, 4)}
    alone = {(r["item"], r["key"]): r["seed_key"] for r in matched_fields(fields).collect()}
    assert alone[3, "0:z/c#0"] == "0:c#0" and match_sequences(fields.limit(0)).count() == 0
