"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.session import ensure_checkpoint_dir, ship_package

#: White space that separates words everywhere in this subpackage: U+0020 and U+0009 to U+000D.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Make checkpoints and the package usable on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text (no empty strings)."""
    return F.array_remove(F.split(text, WORD_GAP), "")
