"""Words and small shared expressions. A word is a run of characters other than ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACE + "+"), "")


def n_words_of(text: Column) -> Column:
    """Number of words without building them."""
    return F.regexp_count(whole(text), F.lit(NOT_SPACE + "+")).cast("long")


def squeezed(text: Column) -> Column:
    """Each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(whole(text), SPACE + "+", " ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
