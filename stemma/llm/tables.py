"""Reading the given tables and small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that no name of theirs meets another."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (id, SHA-256 of the text) is in ``kept``, each pair once.

    ``kept`` has the columns ``doc_id`` and ``row_sha256``, each pair at most
    once. Null ids match null ids. Of rows that are equal in both, one stays.
    The text moves through one shuffle, keyed by the id and the hash, so no
    key gathers more than the repeated rows of one document.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    marked = docs.select(
        whole_row(docs), named(id_col).alias("key"), F.sha2(text_or_empty(text_col).cast("binary"), 256).alias("sha")
    )
    wanted = kept.select(named("doc_id").alias("key"), F.col("row_sha256").alias("sha"))
    return marked.join(wanted, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"]).select("row.*")
