"""Surrogate keys and public ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.session import cut_lineage

_ROW_BITS = (1 << 33) - 1


def dense_ids(df: DataFrame, id_column: str, *order: Column, start: int = 0) -> DataFrame:
    """Number rows ``start+1 .. start+n`` in ``order`` without one big sort task.

    Rows are range-partitioned by the order key and kept once in the shared
    folder; each partition then starts after the rows of the ones before it.
    The table of offsets has one row per partition, so broadcasting it is safe.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(
        ordered.withColumn("_part", F.spark_partition_id()).withColumn(
            "_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
        )
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(id_column, F.col("_before") + F.col("_row") + 1 + start).drop(
        "_part", "_row", "_before"
    )


def public_uuid(*parts: Column) -> Column:
    """A stable uuid text derived from the natural key, so that a rerun gives the same one."""
    digest = F.md5(F.concat_ws("\u0000", *parts).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def with_audit_columns(df: DataFrame, kind: str, natural_key: str) -> DataFrame:
    """Add ``uuid``, ``created_at`` and ``updated_at``."""
    return (
        df.withColumn("uuid", public_uuid(F.lit(kind), F.col(natural_key)))
        .withColumn("created_at", F.current_timestamp())
        .withColumn("updated_at", F.current_timestamp())
    )
