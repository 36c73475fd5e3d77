"""Interval joins over date sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels of nested buckets; the widest holds every year up to 2**27.
_BITS = 28


def _bucket(level: Column, year: Column) -> Column:
    return F.struct(level.alias("level"), F.call_function("shiftright", year, level).alias("bucket"))


def _points(year: Column) -> Column:
    """Every bucket that holds a year, one per level."""
    return F.transform(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda k: _bucket(k, year))


def _cover(low: Column, high: Column) -> Column:
    """At most two buckets that cover a period together: the level whose width just exceeds it."""
    span = F.greatest(high - low, F.lit(0)) + 1
    level = F.ceil(F.log2(span.cast("double"))).cast("int")
    return F.array_distinct(F.array(_bucket(level, low), _bucket(level, high)))


def period_join(periods: DataFrame, points: DataFrame) -> DataFrame:
    """Rows of ``periods`` with the rows of ``points`` whose ``at`` lies within ``low..high``.

    A period is keyed by at most two buckets of about its own width and a
    point by its bucket of every level, so the number of keys does not grow
    with the length of a period.
    """
    year = lambda c: F.floor(F.col(c) / 10000).cast("int")
    left = periods.where("low <= high").withColumn("_k", F.explode(_cover(year("low"), year("high"))))
    right = points.withColumn("_k", F.explode(_points(year("at"))))
    return left.join(right, "_k").where("at between low and high").drop("_k")


def period_matches(periods: DataFrame, contained: bool = False) -> DataFrame:
    """For each distinct period the number of periods it overlaps, or contains, itself included.

    ``periods`` holds distinct ``(start_sort, end_sort)`` with their number of
    rows ``n``; equal periods are counted, never paired up.
    """
    forward = periods.where("start_sort <= end_sort")
    key = ["start_sort", "end_sort"]
    own = forward.select(*key, F.col("start_sort").alias("low"), F.col("end_sort").alias("high"))
    starts = forward.select(F.col("start_sort").alias("at"), F.col("end_sort").alias("to"), "n")
    within = period_join(own, starts)
    if contained:
        hits = within.where("to <= end_sort").select(*key, "n")
    else:
        # Two periods overlap when the start of one lies within the other.
        later = within.select(*key, "n")
        earlier = period_join(
            forward.select(F.col("start_sort").alias("low"), F.col("end_sort").alias("high"), F.col("n")),
            forward.select(F.col("start_sort").alias("at"), *key),
        ).where("low < start_sort").select(*key, "n")
        hits = later.unionByName(earlier)
    return hits.groupBy(*key).agg(F.sum("n").alias("matches"))
