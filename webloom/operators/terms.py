"""Words of documents: counts, vocabulary, weights, search and keyphrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators.joins import lookup
from webloom.operators.ordered import ordinal
from webloom.operators.spread import dealt, pieces
from webloom.session import checkpoint


def bag_of_words(docs: DataFrame, words: Column, count: bool = True) -> DataFrame:
    """(doc_id, term, tf); without ``count`` presence only. Texts are dealt by document before they
    become words, so counting, norms and rows by document shuffle no words."""
    if not count:
        return docs.select("doc_id", F.explode(F.array_distinct(words)).alias("term")).withColumn("tf", F.lit(1).cast("bigint"))
    return dealt(docs, "doc_id").select("doc_id", F.explode(words).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_counts(docs: DataFrame, words: Column) -> DataFrame:
    """Total count and number of documents per term, in one shuffle.

    Documents are counted from each row's distinct words, so the (document, term)
    grouping is not needed, and the map side adds up frequent words first.
    """
    one = lambda tf, df: lambda w: F.struct(w.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df"))
    pieces = F.concat(F.transform("_words", one(1, 0)), F.transform(F.array_distinct("_words"), one(0, 1)))
    return (
        docs.select(words.alias("_words")).select(F.inline(pieces))
        .groupBy("term").agg(F.sum("tf").alias("total_count"), F.sum("df").alias("total_docs")))


def vocabulary(docs: DataFrame, words: Column, min_count: int = 5) -> DataFrame:
    """Terms that occur at least ``min_count`` times, numbered from 0 in term order."""
    # Numbering reads its input three times, so the counted words are stored first.
    kept = checkpoint(term_counts(docs, words).filter(F.col("total_count") >= min_count))
    numbered = ordinal(kept, ["term"], "pos")
    return numbered.withColumn("pos", F.col("pos") - 1)


def known_only(facts: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Facts whose key is listed. The list holds each key once, so a broadcast or a
    shuffled semi join is the optimizer's choice by measured size."""
    return facts.join(known.select(key), key, "left_semi")


def tfidf(docs: DataFrame, words: Column, min_count: int = 5) -> DataFrame:
    """Weight ln(1 + tf / total_count) * ln(N / df + 1) of the kept terms."""
    n = docs.select(F.count("*")).scalar()
    # The vocabulary is needed twice (size check and join): keep it as a stored table.
    kept = checkpoint(term_counts(docs, words).filter(F.col("total_count") >= min_count))
    found = lookup(bag_of_words(docs, words), kept, "term", spread_on="doc_id")
    weight = F.log1p(F.col("tf") / F.col("total_count")) * F.log(n / F.col("total_docs") + 1)
    return found.select("doc_id", "term", weight.alias("weight"))


def unit_weights(bag: DataFrame) -> DataFrame:
    """Term counts divided by the document's Euclidean norm."""
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy("doc_id")))
    return bag.select("doc_id", "term", (F.col("tf") / norm).alias("weight"))


def search_top(docs: DataFrame, words: Column, query: list[str], n: int = 10) -> DataFrame:
    """The ``n`` documents with the highest summed tf-idf of the query words.

    Only postings of the query words leave the scan: one narrow pass, then a top-n.
    """
    asked = F.array(*[F.lit(w) for w in sorted(set(query))])
    hits = docs.select("doc_id", F.explode(F.filter(words, lambda w: F.array_contains(asked, w))).alias("term"))
    postings = hits.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    total = docs.select(F.count("*")).scalar()
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))  # one row per query word
    scored = postings.join(F.broadcast(frequency), "term")
    score = F.round(F.sum(F.col("tf") * F.log(total / F.col("df") + 1)), 6)
    return scored.groupBy("doc_id").agg(score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(n)


def phrases(docs: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """Candidate phrases: maximal word runs without stop word or punctuation."""
    stop = "|".join(sorted(stop_words, key=lambda w: (-len(w), w)))
    lowered = F.lower("text")
    cut = F.regexp_replace(lowered, rf"(?<![\p{{L}}\p{{N}}'])(?:{stop})(?![\p{{L}}\p{{N}}'])", "\u0001")
    pieces = F.split(F.regexp_replace(cut, r"[^\p{L}\p{N}' \u0001]+", "\u0001"), "\u0001")
    clean = F.filter(F.transform(pieces, lambda p: F.trim(F.regexp_replace(p, " +", " "))), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(clean).alias("at", "phrase"))


def rake_keywords(docs: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """Phrases of a document scored by the sum of degree / frequency of their words.

    One shuffle by document; both the word totals and the phrase totals reuse it. Its partitions
    follow the input, as a document takes far more room in words than as text.
    """
    found = phrases(docs.repartition(pieces(docs), "doc_id"), stop_words)
    words = F.split("phrase", " ")
    exploded = found.select("doc_id", "at", "phrase", F.size(words).alias("size"), F.explode(words).alias("word"))
    same_word = Window.partitionBy("doc_id", "word")
    scored = exploded.withColumn("word_score", F.sum("size").over(same_word) / F.count("*").over(same_word))
    per_place = scored.groupBy("doc_id", "at", "phrase").agg(F.sum("word_score").alias("score"))
    return per_place.groupBy("doc_id", "phrase").agg(F.round(F.max("score"), 6).alias("score"))


def keyword_categories(urls: DataFrame, dictionary: DataFrame, id_col: str, url: str) -> DataFrame:
    """(id, category) for every dictionary keyword that occurs inside a URL.

    Substring search becomes an equi-join: a URL is cut into its distinct substrings of
    the lengths the dictionary uses, each looked up once.
    """
    longest = urls.select(F.max(F.length(url))).first()[0] or 0
    dictionary = checkpoint(dictionary.select("keyword", "category").filter(F.length("keyword").between(1, longest)))
    # At most one size per character of the longest URL.
    sizes = sorted(r[0] for r in dictionary.select(F.length("keyword")).distinct().collect())
    text = F.lower(F.col(url))
    cuts = lambda n: F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = F.array_distinct(F.concat(*[cuts(n) for n in sizes])) if sizes else F.array().cast("array<string>")
    exploded = urls.select(id_col, F.explode(grams).alias("keyword"))
    return lookup(exploded, dictionary, "keyword", spread_on=id_col).select(id_col, "category").distinct()
