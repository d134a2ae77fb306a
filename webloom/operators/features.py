"""Feature preparation: domains, encodings, scaling, order and splits."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.vectors import fixed_size
from webloom.operators.joins import lookup
from webloom.operators.ordered import ordinal
from webloom.session import checkpoint

MAX_INDICATORS = 4096


def column_bounds(df: DataFrame, names: list[str]) -> DataFrame:
    """(name, low, high) of numeric columns in one pass."""
    pairs = [F.struct(F.lit(n).alias("name"), F.min(n).cast("double").alias("low"), F.max(n).cast("double").alias("high")) for n in names]
    return df.agg(F.array(*pairs).alias("b")).select(F.inline("b"))


def category_domain(df: DataFrame, name: str) -> DataFrame:
    """(value, index): distinct values numbered from 0 in value order."""
    values = checkpoint(df.select(F.col(name).alias("value")).filter("value is not null").distinct())
    return ordinal(values, ["value"], "index").withColumn("index", F.col("index") - 1)


def categorical_mapping(df: DataFrame, name: str, mapping: DataFrame, spread_on: str) -> DataFrame:
    """Replace a value by its index; a value outside the mapping is an error."""
    table = mapping.select(F.col("value").alias(name), "index")
    found = lookup(df, table, name, "left", spread_on)
    unknown = F.raise_error(F.concat(F.lit(f"unknown category in {name}: "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))
    return found.withColumn("index", F.when(F.col("index").isNotNull(), F.col("index")).otherwise(unknown.cast("bigint")))


@dataclass
class OneHot:
    """Indicator columns ``col_value`` of categorical columns, domain learnt from the data."""

    columns: list[str]
    domains: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "OneHot":
        for name in self.columns:
            values = [r[0] for r in df.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name).limit(MAX_INDICATORS + 1).collect()]
            if len(values) > MAX_INDICATORS:
                raise ValueError(f"{name} has more than {MAX_INDICATORS} values; use categorical_mapping")
            self.domains[name] = values
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        indicators = [
            (F.col(name) == value).cast("int").alias(f"{name}_{value}") for name in self.columns for value in self.domains[name]]
        return df.select(*[c for c in df.columns if c not in self.columns], *indicators)


@dataclass
class MinMaxScale:
    """(v - min) / (max - min) without clipping; constant columns stay. Bounds are reusable."""

    columns: list[str]
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "MinMaxScale":
        self.bounds = {r["name"]: (r["low"], r["high"]) for r in column_bounds(df, self.columns).collect()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(name: str) -> Column:
            low, high = self.bounds.get(name, (None, None))
            if low is None or low == high:
                return F.col(name)
            return ((F.col(name) - low) / (high - low)).alias(name)

        return df.select(*[scaled(c) if c in self.columns else c for c in df.columns])


def label_offset(df: DataFrame, label: str, offset: int) -> DataFrame:
    return df.withColumn(label, F.col(label) + offset)


def missing_value_filter(df: DataFrame, id_cols: list[str], names: list[str], missing: float | None) -> DataFrame:
    """Cells (ids, name, value) without those equal to the missing marker. NaN cells are an
    error unless NaN is the marker (``None``)."""
    cells = df.select(*id_cols, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])))
    if missing is None:
        return cells.filter(~F.isnan("value"))
    checked = cells.withColumn("value", F.when(F.isnan("value"), F.raise_error(F.lit("NaN cell")).cast("double")).otherwise(F.col("value")))
    return checked.filter(F.col("value") != missing)


def drop_label_or_id(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names])


def hash_order(ids: list[str], seed: int) -> Column:
    """A reproducible random sort key."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def shuffle(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    """Rows numbered from 1 in a seeded random order."""
    return ordinal(df.withColumn("_key", hash_order(ids, seed)), ["_key", *ids], "position").drop("_key")


def train_test_split(df: DataFrame, ids: list[str], fraction: float, seed: int) -> DataFrame:
    """The first floor(n * (1 - fraction)) rows of a seeded order train, the rest test."""
    cut = df.select(F.floor(F.count("*") * (1 - fraction))).scalar()
    return shuffle(df, ids, seed).withColumn("part", F.when(F.col("position") <= cut, "train").otherwise("test"))


def channel_means(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Element-wise mean of vectors, one pass without exploding them."""
    means = F.array(*[F.avg(F.get(vector, i)) for i in range(size)])
    return df.agg(means.alias("m")).select(F.posexplode("m").alias("pos", "mean"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight per class, n / (classes * count)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.select(F.sum("n")).scalar()
    kinds = counts.select(F.count("*")).scalar()
    return counts.select(label, (total / (kinds * F.col("n"))).alias("weight"))


def document_term_matrix(bag: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, positions, values): sparse row per document, positions ascending."""
    cells = lookup(bag, vocab.select("term", "pos"), "term", spread_on="doc_id")
    row = F.array_sort(F.collect_list(F.struct("pos", F.col("tf").cast("double").alias("value"))))
    return cells.groupBy("doc_id").agg(row.alias("r")).select("doc_id", F.col("r.pos").alias("positions"), F.col("r.value").alias("values"))


def embed_index_sequence(docs: DataFrame, words: Column, vocab: DataFrame, size: int) -> DataFrame:
    """Vocabulary positions of the first ``size`` distinct words of a document, in order of
    first use; words outside the vocabulary are skipped, short rows padded with 0."""
    first = docs.select("doc_id", F.posexplode(F.slice(F.array_distinct(words), 1, size)).alias("at", "term"))
    cells = lookup(first, vocab.select("term", "pos"), "term", spread_on="doc_id")
    rows = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "pos"))).alias("r"))
    known = rows.select("doc_id", F.col("r.pos").alias("p"))
    every = docs.select("doc_id").join(known, "doc_id", "left")
    return every.select("doc_id", fixed_size(F.coalesce("p", F.array().cast("array<bigint>")), size, 0).alias("positions"))
