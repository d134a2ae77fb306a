"""Operators on small tables with nulls, empty and long texts, repeated rows and clashing columns, against brute force."""

import collections
import io
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import chunk_dedup, components, decontaminate, langid, line_dedup, lm_scoring, minhash, packing, quality, sharding, warc
from webloom.llm.queries import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, row long, record string, kept boolean, key long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, 7, 8, "x", True, 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def edge(spark):
    same = prose(1, 80)
    rows = [(None, prose(2, 30)), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, prose(3, 20000)), (5, same), (5, same), (6, same),
            (7, same + " one more"), (8, "<|endoftext|> é\n\n  two  blanks "), (9, "a\n" + "line of some length here\n" * 3), (10, "word")]
    rows += [(100 + k, prose(50 + k, 60)) for k in range(20)]
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.limit(0)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# --- sharding

def test_shards_hold_every_row_in_equal_numbers(edge, nothing):
    got = sharding.shuffled(edge, shards=4, bucket_bytes=2000).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(pairs(edge), key=key)
    assert got[0]["record"] == "x" and len(got[0]) == len(edge.columns) + 1
    assert sharding.shuffled(nothing).count() == 0


def test_few_rows_in_many_shards_and_repeatable(edge):
    few = edge.limit(3)
    assert sorted(r["shard"] for r in sharding.shuffled(few, shards=40).collect()) == [0, 1, 2]
    place = lambda: sorted(map(str, sharding.shuffled(edge.repartition(1), shards=5, seed=3).select("doc_id", "shard", "slot").collect()))
    assert place() == place()


# --- quality

def test_quality_counts(spark, edge, nothing):
    twice = "one two three four five six seven one two three four five six eight"
    docs = edge.unionByName(table(spark, [(20, twice), (21, "x y\nx y\n\nx y"), (22, "a b " * 30), (23, "## $ a<b")]))
    got = {(r["doc_id"], r["n_words"]): r for r in quality.assess(docs).collect()}
    for doc_id, text in pairs(docs):
        w = (text or "").encode().split()
        grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        r = got[doc_id, len(w)]
        assert r["n_repeat_words"] == len(covered)
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality.assess(nothing).count() == 0 and quality.accepted(nothing).columns == nothing.columns


def test_divergent_documents_are_rejected(spark):
    rows = [(k, prose(k, 200)) for k in range(30)] + [(90, " ".join(["#$%"] * 5 + WORDS) + " &|< " * 200)]
    got = {r["doc_id"]: r["kept"] for r in quality.assess(table(spark, rows)).select("doc_id", "kept").collect()}
    assert not got.pop(90) and all(got.values())


# --- near duplicates

def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    names = collections.defaultdict(list)
    for n, (doc_id, _) in enumerate(rows):
        names[root(n)].append(doc_id)
    return sorted((str(i), len(s), str(min((x for x in names[root(n)] if x is not None), default=None))) for n, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, edge, size, percent):
    draw = random.Random(size)
    rows = pairs(edge.filter("doc_id is null or doc_id <> 4"))
    base = prose(77, 120).split()
    for k in range(60):  # a group whose similarities lie on both sides of the threshold
        w = list(base)
        for _ in range(draw.randrange(6)):
            w[draw.randrange(len(w))] = f"new{k}"
        rows.append((200 + k, " ".join(w)))
    got = minhash.near_duplicates(table(spark, rows), size, percent).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, size, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_row_of_a_group_stays(edge, nothing):
    stays = minhash.kept_documents(edge, 5, 80)
    assert stays.columns == edge.columns
    ids = [r["doc_id"] for r in stays.select("doc_id").collect()]
    assert ids.count(5) == 1 and 6 not in ids and 7 not in ids and {1, 2, 3, 4} <= set(ids)
    assert minhash.near_duplicates(nothing).count() == 0


def test_unlike_texts_stay_under_one_id_or_none(spark):
    same, other = prose(1, 80), prose(4, 60)
    rows = [(None, prose(2, 60)), (None, prose(3, 60)), (None, other), (None, other), (5, prose(5, 60)), (5, prose(6, 60)), (6, same), (5, same + " more"),
            (None, same), (7, None), (7, ""), (None, None), (None, " "), (None, None), (8, other + " x"), (9, "y"), (9, "y")]
    got = pairs(minhash.kept_documents(table(spark, rows), 5, 80))
    key = lambda r: (str(r[0]), str(r[1]))
    lost = [(None, other), (None, other), (6, same), (None, same), (None, None), (9, "y")]
    want = list(rows)
    for r in lost:
        want.remove(r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_estimate_corrects_chance_collisions():
    assert minhash.estimate(minhash.PERMUTATIONS) == 1 and abs(minhash.estimate(minhash.PERMUTATIONS / 16)) < 1e-9
    a, b = minhash.shingle_set(prose(1, 400), 1), minhash.shingle_set(prose(1, 400) + " " + prose(9, 60), 1)
    sketch = minhash.Sketcher(4, 1)
    (_, x), (_, y) = sketch(a), sketch(b)
    lanes = (x ^ y).view(np.uint64).reshape(minhash.LOW_BITS, minhash.LANES)
    equal = minhash.PERMUTATIONS - int(np.bitwise_count(np.bitwise_or.reduce(lanes)).sum())
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(minhash.estimate(equal) - real) < 0.1


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 301), (301, 302), (302, 300), (300, 300), (301, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, 300: 300, 301: 300, 302: 300}


# --- language model

def test_lattice_sums_over_all_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "aba"] + [f"<0x{i:02X}>" for i in range(256)]
    log_p = np.log(lm_scoring.first_weights([-float(i) for i in range(len(pieces))]))
    lattice = lm_scoring.Lattice(pieces, log_p)

    def every(s):
        if not s:
            return 1.0
        found = sum(math.exp(log_p[pieces.index(p)]) * every(s[len(p):]) for p in pieces[:7] if s.startswith(p))
        if s[0] not in pieces[:7]:
            found += math.prod(math.exp(log_p[7 + b]) for b in s[0].encode()) * every(s[1:])
        return found

    long_word = "ab" * 400
    assert -1e5 < lattice.log_probability(long_word) < -300
    plain, logs = [0.0] * len(pieces), [0.0] * len(pieces)
    lattice.expect("abaé", 3.0, plain)
    lattice._expect_long("▁abaé", lattice.arcs("▁abaé"), 3.0, logs)
    assert np.allclose(plain, logs)
    for word in ("a", "abab", "aé", "bbba", "ca"):
        assert math.isclose(lattice.log_probability(word), math.log(every("▁" + word)), rel_tol=1e-9)
        counts = [0.0] * len(pieces)
        lattice.expect(word, 2.0, counts)
        letters = sum(c * (len(p) if n < 7 else 1 / len("é".encode()) if "é" in word else 1) for n, (p, c) in enumerate(zip(pieces, counts)))
        assert math.isclose(letters, 2 * (len(word) + 1), rel_tol=1e-6)


def test_scores_equal_brute_force(spark, edge, nothing):
    pieces, scores = ["▁", *WORDS, *"0123456789abcdefghijklmnopqrstuvwxyz"] + [f"<0x{i:02X}>" for i in range(256)], None
    scores = [-float(i) for i in range(len(pieces))]
    train = edge.filter(F.coalesce("doc_id", F.lit(0)) % 2 == 0)
    model = lm_scoring.train(train, pieces, scores, rounds=1)
    counts, documents = collections.Counter(), 0
    for _, text in pairs(train):
        counts.update(lm_scoring.words_of(text))
        documents += 1
    total, types = sum(counts.values()) + documents, len(counts) + 1
    assert (model.tokens, model.types) == (total, types)
    lattice = lm_scoring.Lattice(pieces, model.log_p)
    for share in (5e-7, 1e-3):  # all words frequent, and some joined
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in lm_scoring.score(edge, model, share).collect())
        want = []
        for doc_id, text in pairs(edge):
            w = lm_scoring.words_of(text)
            base = sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w) + math.log10((documents + 1) / (total + types + 1))
            inner = (sum(lattice.log_probability(x.decode()) for x in w) + model.log_end) / math.log(10)
            want.append((str(doc_id), len(w) + 1, sum(x in counts for x in w) + 1, round(base, 5), round(inner, 5)))
        assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
        assert np.allclose([x[3:] for x in got], [x[3:] for x in sorted(want)], rtol=1e-6, atol=1e-4)
    assert lm_scoring.score(nothing, lm_scoring.train(nothing, pieces, scores)).count() == 0
    # Words of other rows noted in the same pass change neither the counts nor a score.
    once = lm_scoring.train(edge, pieces, scores, rounds=1, training=F.coalesce("doc_id", F.lit(0)) % 2 == 0)
    assert (once.tokens, once.types, once.documents) == (model.tokens, model.types, model.documents) and np.allclose(once.log_p, model.log_p)
    again = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm_scoring.score(edge, once, counted=True).collect())
    assert [x[:3] for x in again] == [x[:3] for x in got] and np.allclose([x[3:] for x in again], [x[3:] for x in got], rtol=1e-6, atol=1e-4)


def test_common_words_are_found_by_bucket(spark):
    common = [f"w{k}" for k in range(400)]  # More words than buckets, so some share one.
    draw = random.Random(7)
    rows = [(k, [draw.choice([*common, "other", "é", ""]) for _ in range(draw.randrange(60))]) for k in range(40)]
    terms = spark.createDataFrame(rows, "id long, terms array<string>")
    made = spark.createDataFrame([(common,)], "common array<string>").select(quality._buckets(F.col("common")).alias("buckets"))
    got = {r[0]: r[1] for r in terms.crossJoin(made).select("id", quality._places(F.col("terms"), F.col("buckets"))).collect()}
    assert got == {k: sorted(common.index(w) + 1 for w in words if w in common) for k, words in rows}
    none = spark.createDataFrame([(["a"], [])], "terms array<string>, common array<string>")
    assert none.select(quality._places(F.col("terms"), quality._buckets(F.col("common")))).first()[0] == []


# --- substrings

def test_chunks_survive_insertions_and_keep_characters_whole():
    text = (prose(4, 2000) + " é è ü ñ ").encode()
    cut = lambda d: [d[a:b] for a, b in zip([0, *chunk_dedup.chunk_ends(d)[:-1]], chunk_dedup.chunk_ends(d))]
    plain, moved = cut(text), cut(b"an insertion" + text)
    assert b"".join(plain) == text and len(set(moved) - set(plain)) <= 4
    assert all(c.decode() for c in cut("éèüñ".encode() * 900))
    assert max(map(len, cut(b"a" * 5000))) <= chunk_dedup.MOST and chunk_dedup.chunk_ends(b"") == []


def test_hash_equals_the_rolling_definition():
    data = np.frombuffer(prose(5, 50).encode(), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(chunk_dedup.GEAR[b])) % 2**32
        want.append(h)
    assert chunk_dedup.gear_hash(data).tolist() == want


def test_shared_passages_are_found_and_clean_texts_left_alone(spark, edge, nothing):
    passages = [prose(900 + k, 55) for k in range(20)]
    rows = [(k, f"{prose(k, 70)}\n{passages[k % 20]} {prose(500 + k, 40)}") for k in range(60)] + [(300 + k, prose(2000 + k, 150)) for k in range(60)]
    found = {r["doc_id"] for r in chunk_dedup.repeated_spans(table(spark, rows)).collect()}
    assert found == set(range(60))
    got = dict(pairs(chunk_dedup.without_repeats(table(spark, rows))))
    assert all(got[300 + k] == dict(rows)[300 + k] for k in range(60))
    assert sum(len(t) for t in got.values()) < sum(len(t) for _, t in rows) - 40 * 150
    assert {r["doc_id"] for r in chunk_dedup.repeated_spans(edge).collect()} == {5, 6, 7}
    assert chunk_dedup.repeated_spans(nothing).count() == 0


def test_no_passage_of_the_wanted_length_is_missed(spark):
    draw = random.Random(12)
    letters = lambda n: "".join(draw.choice("abcdeé ñ") for _ in range(n))
    rows, shared = [], []
    for k in range(150):  # 90 to 100 bytes, each in two unlike surroundings
        passage = letters(70)
        while len(passage.encode()) < 90:
            passage += draw.choice("abé")
        shared.append(passage)
        rows += [(2 * k + side, letters(draw.randrange(200)) + "XY"[side] + passage + "ZW"[side] + letters(draw.randrange(200))) for side in (0, 1)]
    rows.append((900, letters(50) + "Q" + shared[0][1:] + "Q"))
    docs = table(spark, rows).repartition(3)
    spans = collections.defaultdict(list)
    for r in chunk_dedup.repeated_spans(docs).collect():
        spans[r["doc_id"]].append((r["span_start"], r["span_start"] + r["span_bytes"]))
    for n, (i, text) in enumerate(rows[:-1]):
        passage = shared[n // 2]
        start = len(text[:text.index(passage)].encode())
        assert spans[i] == [(start, start + len(passage.encode()))]
    left = dict(pairs(chunk_dedup.without_repeats(docs)))
    for k, passage in enumerate(shared):
        assert sorted(passage in left[2 * k + side] for side in (0, 1)) == [False, True]
        assert sorted(len(dict(rows)[2 * k + side]) - len(left[2 * k + side]) for side in (0, 1)) == [0, len(passage)]


def test_only_shared_anchors_are_stored(spark, monkeypatch):
    rows = [(k, prose(3000 + k, 300)) for k in range(60)]
    rows += [(100 + k, f"{prose(4000 + k, 30)} {rows[k][1][500:700]} {prose(5000 + k, 30)}") for k in range(2)]
    kept = {}

    def counted(df, name):
        found = keep(df, name)
        kept[name] = found.count()
        return found

    keep = chunk_dedup.stored
    monkeypatch.setattr(chunk_dedup, "stored", counted)
    assert {r["doc_id"] for r in chunk_dedup.repeated_spans(table(spark, rows)).collect()} == {0, 1, 100, 101}
    assert kept and max(kept.values()) < 100  # 62 texts of some 2,000 bytes have about 4,000 anchors
    again = [(k, f"{prose(6000 + k, 30)} {'Is onhe. ' * 2000}") for k in range(2)]
    spans = chunk_dedup.repeated_spans(table(spark, again)).collect()
    assert all(r["span_bytes"] >= 18000 and r["n_chunks"] > 300 for r in spans) and len(spans) == 2
    assert max(kept.values()) < 100  # a text hands on each context once, with all its places


@pytest.mark.parametrize("paired", [64, 2])
def test_spans_of_many_surroundings_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(chunk_dedup, "PAIRED", paired)
    draw = random.Random(31)
    parts = ["".join(draw.choice("abcdeé ñ") for _ in range(draw.randrange(25, 120))) for _ in range(9)]
    rows = [(k, "".join(draw.choice(parts)[draw.randrange(5):] + draw.choice("XYZ") for _ in range(draw.randrange(1, 7)))) for k in range(70)]
    holders, inside = collections.defaultdict(set), collections.defaultdict(list)
    for i, text in rows:
        data = text.encode()
        edges = [p for p in range(len(data) + 1) if p == len(data) or data[p] & 0xC0 != 0x80]
        for a in edges:
            for b in [b for b in edges if 90 <= b - a <= 96]:
                holders[data[a:b]].add(i)
                inside[i].append((a, b))
    want = set()
    for i, text in rows:
        data, runs = text.encode(), []
        for a, b in sorted(x for x in inside[i] if len(holders[data[slice(*x)]]) > 1):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        want |= {(i, a, b - a) for a, b in runs}
    found = chunk_dedup.repeated_spans(table(spark, rows))
    assert want and {(r["doc_id"], r["span_start"], r["span_bytes"]) for r in found.collect()} == want


# --- lines

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_equal_brute_force(spark, edge):
    draw = random.Random(8)
    rows = [(i, t) for i, t in pairs(edge) if i is not None and i not in (4, 5)]
    base = [prose(600 + k, n) for k, n in enumerate((3, 4, 9, 10, 20, 21, 60))]
    for k in range(80):
        line = draw.choice(base)
        for _ in range(draw.randrange(3)):
            at = draw.randrange(len(line) + 1)
            line = line[:at] + draw.choice(["", "z", "é"]) + line[at + draw.randrange(2):]
        rows.append((200 + k, f"first {k}\n{line}\nshort\n{draw.choice(base)}"))
    docs = table(spark, rows)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.deduplicate(docs).collect()}
    earlier, want = [], {}
    for doc_id, text in sorted(rows):
        kept, lines = [], [] if text is None else text.split("\n")
        for line in lines:
            late = any(e == line or min(len(e), len(line)) >= 20 and abs(len(e) - len(line)) < 2 and edits(e, line) <= 1 for e in earlier)
            if line.strip(" \t\n\x0b\x0c\r"):
                earlier.append(line)
            if not late:
                kept.append(line)
        want[doc_id] = (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    assert got == want


def test_lines_of_edge_tables(edge, nothing):
    got = line_dedup.deduplicate(edge)
    assert got.columns == [*edge.columns, "n_lines", "n_dropped"] and got.count() == edge.count()
    assert line_dedup.deduplicate(nothing).count() == 0


def test_short_lines_go_only_as_copies_and_counts_take_free_names(spark):
    rows = [(1, "subscribe now\n\nread more\n   \na"), (2, "subscribe now\n\nread mere\n   \na\nb"), (3, "a\n" * 50)]
    named = table(spark, rows).withColumn("n_lines", F.lit(99))
    got = line_dedup.deduplicate(named, counts=("all", "gone")).orderBy("doc_id").collect()
    assert [(r["text"], r["all"], r["gone"], r["n_lines"]) for r in got] == [
        (rows[0][1], 5, 0, 99), ("\nread mere\n   \nb", 6, 2, 99), ("", 51, 50, 99)]


# --- language

def test_forward_backward_equals_enumeration():
    draws = np.random.default_rng(3)
    evidence, lengths = draws.normal(size=(4, 2, 3)), np.array([4, 2])
    transitions, start = draws.normal(size=(3, 3)), draws.normal(size=3)
    gamma, both, logs = langid.forward_backward(evidence, lengths, transitions, start)
    total = np.zeros((3, 3))
    for row, n in enumerate(lengths):
        weight, place, step = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(start[path[0]] + sum(evidence[t, row, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            weight += w
            for t, y in enumerate(path):
                place[t, y] += w
            for a, b in zip(path, path[1:]):
                step[a, b] += w
        total += step / weight
        assert np.allclose(gamma[:n, row], place / weight) and math.isclose(logs[row], math.log(weight))
    assert np.allclose(both, total)


def test_prediction_pass_equals_the_training_pass():
    draws = np.random.default_rng(4)
    evidence, lengths = draws.normal(size=(9, 5, 4)) * 6, np.array([9, 1, 4, 9, 2])
    transitions, start = draws.normal(size=(4, 4)), draws.normal(size=4)
    gamma, _, _ = langid.forward_backward(evidence, lengths, transitions, start)
    for kind, gap in ((np.float64, 1e-9), (np.float32, 1e-4)):
        got = langid.posteriors(np.ascontiguousarray(evidence.transpose(0, 2, 1)).astype(kind), lengths, transitions, start)
        assert all(np.allclose(got[:n, :, r], gamma[:n, r], atol=gap) for r, n in enumerate(lengths))


def test_features_of_words():
    found = ["Abc", "abc,", "x", "12", "", "étaient", "abd"]
    owner, number, lettered = langid.features(found)
    own = [sorted(number[owner == k].tolist()) for k in range(len(found))]
    assert lettered.tolist() == [True, True, True, False, False, True, True]
    assert own[0] == own[1] and own[3] == own[4] == [0] and own[0] != own[6]
    assert [len(f) for f in own] == [7 + 4 + 3, 14, 7 + 2 + 1, 1, 1, 7 + 8 + 7, 14]
    assert len(set(own[0]) & set(own[6])) >= 5  # the prefixes a and ab, ^a, ab and ^ab
    for k, word in enumerate(found):  # a word's features do not depend on its neighbours
        assert sorted(langid.features([word])[1].tolist()) == own[k]
    assert langid.features([])[0].size == 0


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    rows = [(None, f"the cat sat on the mat {prose(k, 5)}", "en") for k in range(700)] + [(None, f"der hund lag auf dem sofa {prose(k, 5)}", "de") for k in range(700)]
    drawn = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert all(60 < sum(lang == k for lang, _ in drawn) < 150 for k in ("en", "de"))


def test_languages_are_told_apart_also_inside_a_text(spark, edge, nothing):
    vocab = {"aa": "ka lo mi ruta zeno".split(), "bb": "schtrum plotz wern glauf".split()}
    text = lambda lang, seed, n: " ".join(random.Random(seed).choices(vocab[lang], k=n))
    rows = [(k, text(lang, k, 60), lang) for k, lang in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    probe = spark.createDataFrame([(1, text("aa", 500, 9)), (2, text("bb", 501, 9)), (3, text("aa", 502, 20) + " " + text("bb", 503, 30)),
                                   (4, None), (5, ""), (6, "12 | 34"), (None, text("aa", 504, 5))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.tag(probe, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, 5, 6, None)] == ["aa", "bb", "bb", "und", "und", "und", "aa"]
    assert [(s["first"], s["past"], s["lang"]) for s in got[3]["spans"]] == [(0, 20, "aa"), (20, 50, "bb")]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.tag(nothing, model).count() == 0 and langid.tag(edge, model).count() == edge.count()
    assert {r["lang_pred"] for r in langid.tag(probe, langid.train(nothing)).collect()} == {"und"}


# --- packing

def test_token_ids_are_those_of_the_tokenizers_library(spark, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    marked = table(spark, [(800 + k, t) for k, t in enumerate([f"a {end} b", end, end * 3, f"x{end}y z", f" {end} ", f"a b{end}", f"<|endof text|> {end[:-1]}", f"{end}\n\nc  d"])])
    docs = edge.unionByName(marked)
    got = collections.defaultdict(list)
    for r in packing.pieces(docs.filter("doc_id is not null and doc_id <> 5"), *byte_bpe(), with_ids=True).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]))
    for doc_id, text in pairs(docs):
        if doc_id in (None, 5):
            continue
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        found = sorted(got[doc_id])
        assert [x for p in found for x in p[4]] == ids
        assert all(p[2] == 2048 for p in found[1:]) and [p[1] for p in found] == [sum(q[2] for q in found[:k]) for k in range(len(found))]
        assert all(p[3] == zlib.crc32(np.array(p[4], "<u4").tobytes()) for p in found)


def check_plan(histogram, stretches, capacity):
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for length, rank, count, first, offset in stretches:
        assert rank == seen[length]
        seen[length] += count
        for s in range(first, first + count):
            bins[s].append((offset, length))
    assert seen == collections.Counter({l: c for l, c in histogram.items() if c})
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


@pytest.mark.parametrize("seed,n", [(0, 0), (1, 1), (2, 30), (3, 4000)])
def test_plans_are_valid_and_tight(seed, n):
    draws = np.random.default_rng(seed)
    lengths = np.minimum(draws.lognormal(6.3, 1, n).astype(int) % 2048 + 1, 2048)
    histogram = dict(collections.Counter(lengths.tolist()))
    for least in (683, 1025):
        check_plan(histogram, packing.plan_with(histogram, 2048, 40, least), 2048)
    used = check_plan(histogram, packing.plan(histogram), 2048)
    gaps = []
    for length in sorted(lengths.tolist(), reverse=True):  # first fit, longest first
        at = next((k for k, g in enumerate(gaps) if g >= length), None)
        if at is None:
            gaps.append(2048 - length)
        else:
            gaps[at] -= length
    assert used <= math.ceil(1.01 * len(gaps))


def test_pieces_get_gapless_places(edge, nothing):
    rows = packing.packed(packing.pieces(edge, *byte_bpe())).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(rows) == packing.pieces(edge, *byte_bpe()).count()
    assert packing.packed(packing.pieces(nothing, *byte_bpe())).count() == 0


# --- decontamination

def test_tiles_cover_moved_parts_without_overlap():
    item, doc = np.arange(1, 21), np.concatenate([np.arange(11, 21), [0, 0], np.arange(1, 11), [0], np.arange(5, 9)])
    assert decontaminate.tiles(doc, item, 4) == [(12, 0, 10), (0, 10, 10)]
    assert decontaminate.tiles(np.array([1, 2, 3, 9, 1, 2, 3, 4]), np.array([1, 2, 3, 4]), 3) == [(4, 0, 4)]
    assert decontaminate.tiles(np.zeros(0, int), item, 4) == []
    # One token throughout: as many whole items as needed, then what is left of a shorter text.
    assert decontaminate.tiles(np.full(30_000, 7), np.full(200, 7), 4) == [(0, 0, 200)]
    assert decontaminate.tiles(np.full(10, 7), np.full(4_000, 7), 4) == [(0, 0, 10)]


def plain_tiles(document, item, least):
    """The greedy tiling by its definition."""
    found, doc_free, item_free = [], [True] * len(document), [True] * len(item)
    run = lambda p, i, n: p + n <= len(document) and i + n <= len(item) and all(doc_free[p:p + n]) and all(item_free[i:i + n]) and document[p:p + n] == item[i:i + n]
    for n in range(min(len(document), len(item)), least - 1, -1):
        for i, p in itertools.product(range(len(item)), range(len(document))):
            if run(p, i, n):
                doc_free[p:p + n], item_free[i:i + n] = [False] * n, [False] * n
                found.append((p, i, n))
    return found


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_their_definition(seed):
    draw = random.Random(seed)
    letters = draw.choice([1, 2, 3, 8])
    some = lambda n: [draw.randrange(1, letters + 1) for _ in range(draw.randrange(n))]
    item, document = some(25), [0] + some(30)
    document = document + [0] * draw.randrange(3) + item[draw.randrange(9):] + item[:draw.randrange(1, 9)]
    least = draw.randrange(1, 5)
    assert decontaminate.tiles(np.array(document), np.array(item, int), least) == plain_tiles(document, item, least)


def test_leaks_equal_brute_force(spark, edge, nothing):
    items = {1: prose(41, 30), 2: prose(42, 40), 3: "too short", 4: None}
    half = items[1].split()
    rows = [(1, "x " + items[1].upper() + "."), (2, " ".join(half[15:] + ["and"] + half[:15])), (3, " ".join(half[:15])), (4, prose(43, 200)),
            (None, items[2]), (5, items[2]), (5, items[2]), (6, None), (7, prose(44, 5000) + " " + items[2])]
    bench = spark.createDataFrame([(k, v, 1) for k, v in items.items()] + [(1, items[1], 2)], "item_id long, text string, doc_id long")
    for size in (8 << 20, 60):  # one block, and one block per item or so
        got = decontaminate.leaked_items(table(spark, rows), bench, block_bytes=size).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], r["covered"]) for r in got) == sorted(
            [("1", 1, 30), ("2", 1, 30), ("None", 2, 40), ("5", 2, 40), ("5", 2, 40), ("7", 2, 40)])
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(table(spark, rows), bench).collect()) == [3, 4, 6]
    assert decontaminate.leaked_items(nothing, bench).count() == 0 and decontaminate.leaked_items(edge, bench.limit(0)).count() == 0


def test_only_the_leaking_text_of_an_id_goes(spark):
    item = prose(41, 30)
    rows = [(None, item), (None, prose(2, 40)), (None, None), (5, "x " + item), (5, prose(3, 40)), (5, prose(3, 40)), (6, prose(7, 40))]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    key = lambda r: (str(r[0]), str(r[1]))
    got = pairs(decontaminate.clean_documents(table(spark, rows), bench))
    assert sorted(got, key=key) == sorted([r for r in rows if item not in (r[1] or "")], key=key)


# --- archives

def test_records_round_trip(spark):
    pages = [(1, "http://a/ x", "<p>é</p>" * 50), (2, None, "<p>é</p>" * 50), (3, "u", ""), (4, "u", None), (5, "u", "b\r\n\r\nc"), (None, "u", "no id")]
    pages += [(100 + k, f"u{k}", f"<html>{prose(k, 200)}</html>") for k in range(60)]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, payload int")
    got = {r["page_id"]: r for r in warc.archived(df).collect()}
    assert len(got) == len(pages)
    for page_id, url, html in pages:
        body = (html or "").encode()
        owner = {1: 2, 3: 4}.get(page_id)
        r = got[page_id]
        assert (r["refers_to"], r["record_type"]) == (owner, "revisit" if owner else "response")
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == warc.digest(body)
        assert bytes(r["payload"]) == (b"" if owner else body)
        assert r["url"] == (None if url is None else " ".join(url.split()))
    assert warc.archived(df.limit(0)).count() == 0


def test_archives_begin_with_their_dictionary():
    records = [warc.record(k, f"http://x/{k}", f"<html><body class='page'>{prose(k, 80)}</body></html>".encode()) for k in range(200)]
    packed = warc.archive(records)
    assert int.from_bytes(packed[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.read_archive(io.BytesIO(packed))) == records
    assert warc.train_dictionary(records) and len(packed) < sum(map(len, records)) / 2
    assert list(warc.read_archive(io.BytesIO(warc.archive([])))) == []
    draw = random.Random(4)
    noise = lambda n: draw.randbytes(n // 2).hex().encode()
    for few in ([noise(200_000) for _ in range(20)], [noise(60) for _ in range(15)], [noise(3_000_000), *records], [b"x"], [b"a" * 100_000] * 3):
        packed = warc.archive(few)
        assert int.from_bytes(packed[4:8], "little") > 9 and warc.train_dictionary(few) and list(warc.read_archive(io.BytesIO(packed))) == few
        assert sum(map(len, warc.sample(few))) <= warc.SAMPLE_BYTES
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(packed[:-5])))
