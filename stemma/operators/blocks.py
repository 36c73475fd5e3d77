"""Joins whose hot keys are split by their counted size.

A block of n rows that all meet each other is dealt to k parts, and every two
parts meet in a cell of their own: k (k + 1) / 2 cells of like size, each of
them a key of the join. So a single hot key is as many tasks as it needs,
whatever the layout of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import cut_lineage

#: Rows of a part: a cell compares at most about the square of this number.
PART = 1024


def pairs_in_blocks(rows: DataFrame, key: str, item: str, part: int = PART) -> DataFrame:
    """``(key, a, b)`` with a < b for every two different items of a block; ``rows`` holds each item of a key once."""
    rows = cut_lineage(rows.select(F.col(key).alias("_key"), F.col(item).alias("_item")).where(F.col("_key").isNotNull()))
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    dealt = rows.join(sizes, "_key").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("_item"), "parts").cast("int"))
    dealt = cut_lineage(dealt.select("_key", "_item", "parts", "own"))
    # A part is the first one of the cells it forms with itself and later parts, and the second one of the others.
    first = dealt.select("_key", F.col("_item").alias("x"), F.col("own").alias("c1"), F.explode(F.sequence("own", F.col("parts") - 1)).alias("c2"))
    second = dealt.select("_key", F.col("_item").alias("y"), F.explode(F.sequence(F.lit(0), "own")).alias("c1"), F.col("own").alias("c2"))
    met = first.join(second, ["_key", "c1", "c2"]).where("x < y or (c1 < c2 and x <> y)")
    return met.select(F.col("_key").alias(key), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], cell: int = PART * PART) -> DataFrame:
    """``left`` joined to ``right`` on ``keys``; where a key gives more than ``cell`` pairs, its left rows are dealt to parts.

    The right rows of such a key go to every part; those of other keys are not
    copied. Null keys meet nothing.
    """
    # Dealt out by the place in the written table, which is the same whenever a task is run again.
    left = cut_lineage(left).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    right = cut_lineage(right)
    n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    m = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    hot = n.join(m, keys).where(F.col("_l") * F.col("_r") > cell)
    parts = F.ceil(F.col("_l") * F.col("_r") / cell).cast("int")
    hot = cut_lineage(hot.select(*keys, F.least(parts, F.col("_l").cast("int")).alias("_parts")))
    if hot.isEmpty():
        return left.drop("_salt").join(right, keys)
    some = lambda c: F.coalesce(c, F.lit(1))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod("_salt", some(F.col("_parts"))).cast("int")).drop("_parts", "_salt")
    copied = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), some(F.col("_parts")) - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_part"]).drop("_part")
