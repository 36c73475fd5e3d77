"""The corpus pipeline: filters, duplicates and packing over ``documents``, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemma.llm.exact_dedup import exact_dedup
from stemma.llm.packing import pack_documents
from stemma.llm.quality_sites import good_rows, quality_scores
from stemma.llm.queries import TOXIC
from stemma.llm.simhash_dedup import simhash_dedup
from stemma.llm.tables import keep_rows, table
from stemma.llm.toxicity import toxicity
from stemma.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior says good stay."""
    return good_rows(docs, quality_scores(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold stay."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.where(scored.score < TOXIC).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return keep_rows(docs, exact_dedup(docs).where("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays."""
    return keep_rows(docs, simhash_dedup(docs).where("kept"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents that are left."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: The classifiers and the packing have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
