"""Labelled rows for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that a classifier is fitted on; the bound of every forced broadcast of labels.
TRAIN_ROWS = 100_000


def fold(id_col: str = "doc_id") -> Column:
    """The remainder by 3 of the CRC-32 of the id as text; rows with remainder 1 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def label_sample(labels: DataFrame, column: str, rows: int | None = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label) outside the held-out fold, at most about ``rows`` of them, chosen by a hash of the id, or all if None.

    Null ids and labels are left out. An id with several labels gets their majority, 1 on a tie.
    """
    kept = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold() != 1))
        .groupBy("doc_id")
        .agg((F.avg(column) >= 0.5).cast("double").alias("label"))
    )
    if rows is None:
        return kept
    found = kept.count()
    if found > rows:
        kept = kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * rows // found)
    return kept


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, text: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, label, part) of the labelled documents, equal texts once; part is 0 to 4, by a hash of the id."""
    sample = label_sample(labels, column, rows).withColumnRenamed("doc_id", "_id")
    return (
        docs.select(F.col("doc_id").alias("_id"), text.alias("text"))
        .join(F.broadcast(sample), "_id")  # at most TRAIN_ROWS rows of two numbers
        .select("text", "label", F.pmod(F.xxhash64("_id"), F.lit(5)).alias("part"), F.md5("text").alias("_md5"))
        .dropDuplicates(["_md5"])
        .drop("_md5")
    )
