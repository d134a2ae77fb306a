"""The prefix trie against a plain dictionary of all prefixes."""

import collections
import hashlib
import random
import zlib

import pytest

from webloom.llm import prefix_trie
from webloom.llm.common import stored

SCHEMA = "conv_id long, turn long, role string, text string, sid long, path string, depth long, len int"


def brute(rows, group=20, heads=4):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = own.get(c - c % group, []) if c >= 0 else own.get(c + -c % group, [])
        built[c] = tuple(base[:h] + turns[h:])
    nodes = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, members in nodes.items():
        cost = (len(members) - 1) * len(k[-1][1].split()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += cost
    ends = lambda k, members: ",".join(map(str, sorted(c for c in members if built[c] == k)))
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k, m).encode()).hexdigest())
                  for k, m in nodes.items())


def nodes_of(spark, rows, **settings):
    table = spark.createDataFrame([(*r, 5, "x", 6, 7) for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(table, **settings)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


def talk(seed, convs, alphabet, most):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c, k, draw.choice(["user", "bot"][:alphabet]), draw.choice(["a b", "c", "", "d e f"][:alphabet])) for k in range(draw.randrange(most) + 1)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, convs, alphabet, most", [(1, 60, 2, 9), (2, 40, 1, 30), (3, 30, 4, 3)])
def test_nodes_equal_brute_force(spark, seed, convs, alphabet, most):
    rows = talk(seed, convs, alphabet, most)
    assert nodes_of(spark, rows) == brute(rows)


def test_nulls_copies_and_one_long_conversation(spark):
    rows = [(None, 0, "user", "lost"), (3, None, None, "first"), (3, 1, "user", None), (4, 0, "user", ""), (-5, 0, "user", "below zero"), (-20, 0, "bot", "base")]
    rows += [(c, k, "user", "same words here") for c in range(100, 400) for k in range(2)]
    rows += [(7, k, "user", f"turn {k % 5}") for k in range(700)] + [(8, k, "user", f"turn {k % 5}") for k in range(650)]
    assert nodes_of(spark, rows) == brute(rows)


def test_chain_of_strings_that_are_prefixes_of_each_other(spark):
    rows = [(c, k, "user", "go on") for c in range(1, 25) for k in range(c)]
    assert nodes_of(spark, rows, heads=1) == brute(rows, heads=1)


def test_repeated_turn_rows_and_turnless_conversations(spark):
    # crc32("1") % 4 == 3: conversation 1 has too few turns of its own and no base, so none is left.
    rows = [(1, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "b"), (2, 1, "bot", "c")]
    assert zlib.crc32(b"1") % 4 == 3
    got = nodes_of(spark, rows)
    assert got == brute(rows) and got[0][4] <= 1


def test_no_conversation_has_no_node(spark):
    assert nodes_of(spark, []) == []


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    best = lambda a, b: max(range(a + 1, b + 1), key=lambda n: n & -n)
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.fattest("a", "b").alias("f")).collect()
    assert all(r["f"] == best(r["a"], r["b"]) for r in got)


def test_an_exit_node_is_found_for_every_string(spark):
    """Strings inserted already are located at their own ends by the fat search."""
    rows = talk(4, 30, 2, 12)
    table = spark.createDataFrame([(*r, 5, "x", 6, 7) for r in rows], SCHEMA)
    convs = prefix_trie.rebuilt(table, heads=1).mapInArrow(prefix_trie._prefixes, f"conv_id bigint, len int, path {prefix_trie.TURNS}")
    strings = stored(convs.filter("len > 0").selectExpr("conv_id as sid", "len", "path", "1L as n").dropDuplicates(["path"]), "strings")
    segments, ended = prefix_trie.compacted(strings)
    ends = {r["sid"]: r["len"] for s in segments for r in s.collect()} | {r["sid"]: r["m"] for r in ended.collect()}
    assert ends == {r["sid"]: r["len"] for r in strings.collect()}
