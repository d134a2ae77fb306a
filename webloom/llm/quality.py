"""Quality rules: length, repetition and distribution divergence, all in SQL expressions.

A document's histogram of character classes and its histogram of common words are compared
with those of its language by Jensen-Shannon distance (base 2, 0 to 1). The language
references are counted over all documents. Documents with few words have noisy histograms;
below ``min_words`` the divergence is not judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import SPACE_CLASS, SPACES, let, stored
from webloom.operators.joins import lookup

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"'()[]-"
WINDOW = 5
#: Common words of a language are looked up by hash, in so many buckets.
BUCKETS = 256


def _cut(text: Column, marks: str) -> Column:
    """What is left between runs of ``marks``. No lambda, so it is compiled."""
    return F.array_remove(F.split(text, marks + "+"), "")


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text.

    Windows are compared by 64-bit hashes. The starts of repeated windows are sorted, and each
    covers the words up to the next start, five at most.
    """
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    return F.when(F.size(tokens) > WINDOW, let(hashed, lambda h: let(_windows(h), _covered))).otherwise(0)


def _windows(h: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))


def _covered(windows: Column) -> Column:
    placed = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
        let(placed, lambda s: let(_repeated_starts(s), _stretch)))


def _repeated_starts(placed: Column) -> Column:
    twice = F.filter(placed, lambda x, k: (x["h"] == F.get(placed, k - 1)["h"]) | (x["h"] == F.get(placed, k + 1)["h"]))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _stretch(starts: Column) -> Column:
    return F.aggregate(
        F.transform(starts, lambda s, k: F.least(F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda a, b: a + b)


def _terms(text: Column) -> Column:
    """Lower-case words, cut at white space and marks."""
    return _cut(F.lower(text), "[\\x20\\x09-\\x0D.,;:!?\"()\\[\\]]")


def _bucket(word: Column) -> Column:
    return F.hash(word).bitwiseAND(F.lit(BUCKETS - 1))


def _buckets(words: Column) -> Column:
    """Per bucket the ``words`` whose hash falls into it, with their places from 1 on."""
    placed = F.transform(words, lambda w, i: F.struct(_bucket(w).alias("bucket"), w.alias("word"), (i + 1).alias("place")))
    return let(placed, lambda found: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: let(
        F.filter(found, lambda x: x["bucket"] == b),
        lambda own: F.struct(F.transform(own, lambda x: x["word"]).alias("words"), F.transform(own, lambda x: x["place"]).alias("places")))))


def _places(terms: Column, buckets: Column) -> Column:
    """Places of those terms that the buckets hold, ascending."""
    own = lambda t: F.get(buckets, _bucket(t))
    held = F.filter(terms, lambda t: F.array_contains(own(t)["words"], t))
    return F.sort_array(F.transform(held, lambda t: F.get(own(t)["places"], F.array_position(own(t)["words"], t).cast("int") - 1)))


def _bones(text: Column) -> Column:
    """What small letters leave of a text: the one full pass that the character classes need."""
    return F.regexp_replace(text, "[\\p{L}&&[^\\p{Lu}]]+", "")


def _classes(text: Column, bones: Column) -> list[Column]:
    """Characters by class: small and other letters, capitals, digits, white space, punctuation, symbols, the rest."""
    bare = F.translate(bones, SPACES, "")
    plain = F.translate(bare, SYMBOLS, "")
    no_letter = F.regexp_replace(plain, "\\p{Lu}+", "")
    no_digit = F.regexp_replace(no_letter, "\\p{Nd}+", "")
    rest = F.length(F.translate(no_digit, PUNCTUATION, ""))
    size = F.length
    return [size(text) - size(bones), size(plain) - size(no_letter), size(no_letter) - size(no_digit),
            size(bones) - size(bare), size(no_digit) - rest, size(bare) - size(plain), rest]


def language_references(docs: DataFrame, common: int = 50) -> DataFrame:
    """Per ``lang`` (null as empty): character-class shares, its most frequent words by bucket and their shares.

    Counted over whole texts of all documents; word counts are summed on the map side first.
    Equal counts are ordered by word.
    """
    base = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    boned = base.withColumn("bones", _bones(F.col("text")))
    sums = boned.select("lang", F.array(*_classes(F.col("text"), F.col("bones"))).alias("c")).groupBy("lang").agg(
        F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(7)]).alias("classes"))
    counts = base.select("lang", F.explode(_terms(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= common).groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    share = lambda n, total: n.cast("double") / F.greatest(total, F.lit(1))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    joined = sums.join(totals, "lang", "left").join(top, "lang", "left")
    shares = F.transform(F.coalesce("top", F.expr("array()")), lambda t: share(t["n"], F.col("total")))
    return joined.select(
        "lang", F.transform("classes", lambda n: share(n, chars)).alias("class_shares"),
        _buckets(F.coalesce(F.transform("top", lambda t: t["word"]), F.expr("cast(array() as array<string>)"))).alias("buckets"),
        F.concat(F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)), shares).alias("word_shares"))


def _part(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence."""
    one = lambda a: F.when(a > 0, a * F.log2(2 * a / (p + q))).otherwise(0.0)
    return 0.5 * (one(p) + one(q))


def assess(docs: DataFrame, common: int = 50, min_words: int = 40, max_class_distance: float = 0.25,
           max_word_distance: float = 0.47) -> DataFrame:
    """``docs`` (doc_id, text, lang) with counts, distances, ``base_failed`` and ``kept``.

    The whole row stands in ``record``; other columns of ``docs`` are only there.

    Null and empty texts have no words and fail the base rules. A null language is a
    language of its own. Repeated rows are judged one by one, an empty table gives none.
    ``class_distance`` and ``word_distance`` are null below ``min_words``; a document is
    rejected if either exceeds its bound.
    """
    references = stored(language_references(docs, common), "references")
    base = docs.select(F.struct("*").alias("record"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = (
        base.withColumn("tokens", _cut(F.col("text"), SPACE_CLASS))
        .withColumn("bones", _bones(F.col("text")))
        .withColumn("classes", F.array(*_classes(F.col("text"), F.col("bones"))))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
        .select(
            "record", "doc_id", "lang", "classes", F.size("tokens").cast("long").alias("n_words"),
            (F.length("text") - F.get("classes", F.lit(3))).cast("long").alias("word_chars"),
            F.get("classes", F.lit(5)).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("tokens")).cast("long").alias("n_repeat_words"),
            _terms(F.col("text")).alias("terms")))
    joined = lookup(found, references, "lang", "left", spread_on="doc_id")
    joined = joined.withColumn("places", _places(F.col("terms"), F.col("buckets")))
    # Sorted places: each run of equal ones is a bin.
    joined = joined.withColumn("starts", F.filter(
        F.transform("places", lambda x, i: i), lambda i: (i == 0) | (F.get("places", i) != F.get("places", i - 1))))
    n = F.greatest(F.size("terms"), F.lit(1)).cast("double")
    bins = F.concat(
        F.array(F.struct(F.lit(0).alias("at"), ((F.size("terms") - F.size("places")) / n).alias("p"))),
        F.transform("starts", lambda s, k: F.struct(
            F.get("places", s).alias("at"),
            ((F.coalesce(F.get("starts", k + 1), F.size("places")) - s) / n).alias("p"))))
    share_of = lambda b: F.get("word_shares", b["at"])
    word = F.lit(0.5) + F.aggregate(bins, F.lit(0.0), lambda acc, b: acc + _part(b["p"], share_of(b)) - 0.5 * share_of(b))
    chars = F.greatest(F.aggregate("classes", F.lit(0), lambda a, b: a + b), F.lit(1)).cast("double")
    char = let(chars, lambda total: F.aggregate(
        F.zip_with("classes", "class_shares", lambda c, q: _part(c / total, q)), F.lit(0.0), lambda a, b: a + b))
    judged = F.col("n_words") >= min_words
    distance = lambda d: F.when(judged, F.sqrt(F.greatest(d, F.lit(0.0))))
    result = joined.select(
        "record", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        distance(char).alias("class_distance"), distance(word).alias("word_distance"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"))
    far = lambda name, most: F.coalesce(F.col(name) > most, F.lit(False))
    return result.withColumn("kept", ~(
        F.col("base_failed") | far("class_distance", max_class_distance) | far("word_distance", max_word_distance)))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    # A filter on a generated column stays above it; pushed down it would compute the verdict several times over.
    judged = assess(docs).select("record", F.explode(F.array("kept")).alias("passed"))
    return judged.filter("passed").select("record.*")
