"""The registered queries of the subpackage, and the pipeline stage by stage, on the smallest tables."""

import collections
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import FOLDER
from tests.llm.test_operators import brute_components
from tools.check import rows_of
from webloom.llm import ORACLES, QUERIES
from webloom.llm.common import stored, table


def test_entry_offers_the_queries():
    names = {n.split("_")[0] for n in entry.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_held_out_languages(spark):
    rows = QUERIES["op6_language_id"](spark, FOLDER).join(table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = [r["lang"] == r["lang_pred"] for r in rows if len(r["lang_pred"]) and r["lang_pred"] != "und"]
    assert len(rows) > 20 and sum(right) >= 0.95 * len(right)


def test_leaks_are_the_items_that_texts_hold(spark, duck):
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    docs = [(i, words(t or "")) for i, t in duck.execute("select doc_id, text from documents").fetchall()]
    items = [(i, words(t)) for i, t in duck.execute("select item_id, text from benchmark").fetchall()]
    whole = {(d, i) for d, text in docs for i, item in items if item in text}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_benchmark_decontamination"](spark, FOLDER).collect()}
    assert whole and whole <= got and len(got) <= 1.2 * len(whole)


def test_shared_passages(spark, duck):
    """Every document with 50 words in a row that another document has is reported."""
    docs = [(i, (t or "").split()) for i, t in duck.execute("select doc_id, text from documents").fetchall()]
    owners = collections.defaultdict(set)
    for i, w in docs:
        for at in range(len(w) - 50):
            owners[tuple(w[at:at + 51])].add(i)
    planted = {i for found in owners.values() if len(found) > 1 for i in found}
    got = {r["doc_id"] for r in QUERIES["op4_substring_dedup"](spark, FOLDER).collect()}
    assert planted and len(planted - got) <= 0.02 * len(planted)


def test_every_document_with_a_shared_passage_is_reported(spark, duck):
    docs = duck.execute("select doc_id, text from documents where text is not null").fetchall()
    owners = collections.defaultdict(set)
    for i, text in docs:
        for at in range(len(text) - 89):
            owners[hash(text[at:at + 90])].add(i)
    planted = {i for found in owners.values() if len(found) > 1 for i in found}
    got = {r["doc_id"] for r in QUERIES["op4_substring_dedup"](spark, FOLDER).collect()}
    assert planted and planted <= got


def test_pipeline_stages(spark, duck):
    docs = table(spark, FOLDER, "documents")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], FOLDER), name))
        assert name == "best_fit_packing" or tables[-1].columns == docs.columns
    local = [[(r["doc_id"], r["text"]) for r in t.collect()] for t in tables[:5]]
    # Quality: the rows that the twin keeps.
    kept = {r[0] for r in duck.execute(f"select doc_id from ({ORACLES['op10_quality_rules']}) where kept").fetchall()}
    assert sorted(local[1]) == sorted(r for r in local[0] if r[0] in kept)
    # Lines: the twin over what is left.
    view = duck.cursor()
    view.execute("create or replace temp table documents as select * from (values " + ",".join(["(?::bigint, ?)"] * len(local[1])) + ") t(doc_id, text)",
                 [x for r in local[1] for x in r])
    lines = {i: (t, n) for i, t, _, n in view.execute(f"select doc_id, text, n_lines, n_dropped from ({ORACLES['op5_line_dedup']})").fetchall()}
    assert sorted(local[2]) == sorted((i, t) for i, (t, n) in lines.items() if not n or t.split())
    # Near duplicates: the named documents of the brute-force components.
    names = {i for i, _, name in brute_components(local[2], 5, 80) if i == name}
    assert sorted(local[3]) == sorted(r for r in local[2] if str(r[0]) in names)
    # Decontamination: no whole item is left, and only documents that hold most of one go.
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(t) for _, t in duck.execute("select item_id, text from benchmark").fetchall()]
    assert not any(item in words(t) for _, t in local[4] for item in items)
    gone = [t for i, t in local[3] if (i, t) not in set(local[4])]
    assert all(any(sum(w in words(t).split() for w in item.split()) >= 0.7 * len(item.split()) for item in items) for t in gone)
    # Packing: every document's pieces, in sequences without gaps.
    places = collections.defaultdict(list)
    for r in tables[5].collect():
        places[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
    assert {p[2] for found in places.values() for p in found} == {i for i, _ in local[4]}
    for found in places.values():
        found.sort()
        assert [p[0] for p in found] == [sum(q[1] for q in found[:k]) for k in range(len(found))] and sum(p[1] for p in found) <= 2048
