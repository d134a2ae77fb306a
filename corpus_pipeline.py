"""From raw documents to packed training sequences, one written table per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import decontaminate, line_dedup, minhash, packing, quality
from webloom.llm.common import stored, table, words
from webloom.llm.queries import byte_bpe

#: SQL cannot state the byte-pair tokens of the last stage; tests/llm holds a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null texts have no words and go, repeated rows share one verdict."""
    return quality.accepted(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document that loses all its words goes.

    Null, empty and blank texts lose no line and stay; repeated rows lose the same lines; an empty
    table gives no rows.
    """
    gone = "_" * max(map(len, docs.columns)) + "gone"  # longer than any column
    clean = line_dedup.deduplicate(docs, counts=(gone + "_of", gone))
    clean = clean.filter((F.col(gone) == 0) | (F.size(words(F.col("text"))) > 0))
    return clean.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 80 percent; texts without words have no duplicates."""
    return minhash.kept_documents(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item; null and empty texts cover none, repeated rows go or stay together."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences of 2048 tokens; a null text is an empty one."""
    return packing.packed(packing.pieces(docs, *byte_bpe()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
