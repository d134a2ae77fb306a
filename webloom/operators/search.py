"""Keyword and pattern search over pages and records."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_keyword(pages: DataFrame, keyword: str) -> DataFrame:
    """Case-insensitive search: found flag and the first enclosing tag fragment."""
    word = re.escape(keyword)
    context = F.regexp_extract("html", f"(?i)(<[^<]+)({word})([^>]+>)", 0)
    return pages.select("page_id", F.col("html").rlike(f"(?i){word}").alias("found"),
                        F.regexp_replace(context, r"[\r\n]", "").alias("context"))


def search_regex(pages: DataFrame, pattern: str) -> DataFrame:
    return pages.select("page_id", F.col("html").rlike(pattern).alias("found"),
                        F.regexp_replace(F.regexp_extract("html", pattern, 0), r"[\r\n]", "").alias("context"))


def record_text_filter(records: DataFrame, group: str, wanted: Column) -> DataFrame:
    """All rows of the groups in which at least one row is wanted."""
    hits = records.filter(wanted).select(group).distinct()
    return records.join(hits, group, "left_semi")


def priority_pick(seen: DataFrame, visited: DataFrame, key: str) -> DataFrame:
    """The unvisited category with most followers among those seen more than once."""
    totals = seen.groupBy(key).agg(F.sum("followers").alias("followers"), F.count("*").alias("n"))
    return totals.filter("n > 1").join(visited.select(key), key, "left_anti").orderBy(F.desc("followers"), key).limit(1).drop("n")


def mail_body(parts: Column, body: Column, snippet: Column) -> Column:
    """Plain-text parts joined, else the first part, else the body, else the snippet."""
    plain = F.array_join(F.transform(F.filter(parts, lambda p: p["mime"] == "text/plain"), lambda p: p["data"]), "")
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(plain), filled(F.get(parts, 0)["data"]), filled(body), snippet)


def paragraph_text(paragraphs: Column) -> Column:
    """Text of the type-1 paragraphs."""
    return F.array_join(F.transform(F.filter(paragraphs, lambda p: p["type"] == 1), lambda p: p["text"]), "")
