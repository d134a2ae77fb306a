"""What the operators share: word rules, shared storage and the table reader."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import configure, shared_dir

#: The six white-space characters that separate words, as a character class and as text.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
SPACES = " \t\n\x0b\x0c\r"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/webloom-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place in this application's part of the folder that driver and executors share."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what the operators of this application have stored, once their results are written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back, which cuts the lineage.

    A lost executor then costs a re-read, never a second computation.
    """
    place = scratch(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, also where ``fn`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))
