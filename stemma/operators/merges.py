"""The outcome of merge decisions taken one after the other, found in parallel.

Decision j removes its secondary for good unless a person it names is gone by
then. Let A(j) say that the secondary of j is gone after j. With the last
earlier decision about to remove a person called ``prev``:

    A(j) = A(prev of the secondary)  or  not A(prev of the primary)

and a decision stands if neither of its persons is gone before it. So every
A is the "or" of two literals that name earlier decisions or are known. Each
round replaces a literal by what its decision has become: a known value, or a
single literal of a still earlier one. A chain of decisions halves with every
round, where waiting for one decision after the other takes as many rounds as
the chain has links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.session import cut_lineage


def removed_before(decisions: DataFrame) -> DataFrame:
    """``(rank, gone)``: whether a person of the decision is gone by the time it is taken.

    ``decisions`` holds ``(rank, primary_id, secondary_id, takes)`` in the
    order of the unique ``rank``; both persons exist at first and differ. One
    without ``takes`` removes nobody, whatever it finds.
    """
    decisions = cut_lineage(decisions)
    seen = _literals(decisions)
    gates = seen.where("takes").select(
        "rank",
        *[F.col(f"secondary_{c}").alias(f"a_{c}") for c in ("var", "neg", "known")],
        F.col("primary_var").alias("b_var"),
        (~F.col("primary_neg")).alias("b_neg"),
        (~F.col("primary_known")).alias("b_known"),
    )
    gates = cut_lineage(_simplified(gates))
    while not gates.where("a_known is null").isEmpty():
        gates = cut_lineage(_simplified(_replaced(_replaced(gates, gates, "a"), gates, "b")))
    found = _replaced(_replaced(seen, gates, "primary"), gates, "secondary")
    return found.select("rank", (F.col("primary_known") | F.col("secondary_known")).alias("gone"))


def _literals(decisions: DataFrame) -> DataFrame:
    """Per decision and person named: whether the person is gone before, as known value or as a literal.

    A decision whose primary nobody was about to remove leaves its secondary
    removed for certain: all later decisions on that person are known at once.
    Only what lies before the first such decision is put in order, so a person
    in a large part of all decisions is not gathered.
    """
    takers = decisions.where("takes")
    first = takers.groupBy(F.col("secondary_id").alias("person")).agg(F.min("rank").alias("first"))
    safe = takers.join(first, F.col("primary_id") == F.col("person"), "left").where("first is null or first >= rank")
    certain = safe.groupBy(F.col("secondary_id").alias("person")).agg(F.min("rank").alias("certain"))
    about = cut_lineage(first.join(certain, "person", "left"))
    roles = [
        decisions.select("rank", F.col(f"{role}_id").alias("person"), F.lit(role).alias("role"), (F.col("takes") & (F.lit(role) == "secondary")).alias("takes"))
        for role in ("primary", "secondary")
    ]
    named = roles[0].unionByName(roles[1]).join(about, "person", "left")
    known = (
        F.when(F.col("first").isNull() | (F.col("first") >= F.col("rank")), F.lit(False))
        .when(F.col("certain") < F.col("rank"), F.lit(True))
    )
    named = cut_lineage(named.withColumn("known", known))
    # Whoever is about to remove a person before the certain one, and whoever asks in between.
    some = named.where("known is null or (takes and (certain is null or rank <= certain))")
    before = W.partitionBy("person").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    placed = some.withColumn("var", F.last(F.when(F.col("takes"), F.col("rank")), ignorenulls=True).over(before))
    literals = named.where("known is not null").withColumn("var", F.lit(None).cast("bigint")).unionByName(
        placed.where("known is null")
    )
    one = lambda role: literals.where(F.col("role") == role).select(
        "rank",
        F.when(F.col("known").isNull(), F.col("var")).alias(f"{role}_var"),
        F.lit(False).alias(f"{role}_neg"),
        F.col("known").alias(f"{role}_known"),
    )
    return cut_lineage(decisions.select("rank", "takes").join(one("primary"), "rank").join(one("secondary"), "rank"))


def _simplified(gates: DataFrame) -> DataFrame:
    """The "or" of literals a and b: known, one literal (as a, with b known to be false), or both."""
    a, b = F.col("a_known"), F.col("b_known")
    true = F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    one = a.isNull() & b.isNull() & (F.col("a_var") == F.col("b_var"))
    true = true | (one & (F.col("a_neg") != F.col("b_neg")))
    only_b = F.coalesce(~a, F.lit(False))

    def pick(if_true: Column, if_b: Column, otherwise: Column) -> Column:
        return F.when(true, if_true).when(only_b, if_b).otherwise(otherwise)

    nothing = F.lit(None).cast("bigint")
    left_over = ~true & ~only_b & ~F.coalesce(one, F.lit(False))
    return gates.select(
        "rank",
        pick(nothing, F.col("b_var"), F.col("a_var")).alias("a_var"),
        pick(F.lit(False), F.col("b_neg"), F.col("a_neg")).alias("a_neg"),
        pick(F.lit(True), b, a).alias("a_known"),
        F.when(left_over, F.col("b_var")).alias("b_var"),
        (left_over & F.col("b_neg")).alias("b_neg"),
        F.when(left_over, b).otherwise(F.lit(False)).alias("b_known"),
    )


def _replaced(rows: DataFrame, gates: DataFrame, literal: str) -> DataFrame:
    """``rows`` with a literal replaced by what its decision is by now, unless that still has two literals."""
    var, neg, known = (F.col(f"{literal}_{c}") for c in ("var", "neg", "known"))
    told = gates.where("b_known = false").select(
        F.col("rank").alias("_rank"), F.col("a_var").alias("_var"), F.col("a_neg").alias("_neg"), F.col("a_known").alias("_known")
    )
    joined = rows.join(told, var == F.col("_rank"), "left")
    hit = F.col("_rank").isNotNull()
    return joined.withColumns(
        {
            f"{literal}_known": F.when(hit, F.col("_known") != neg).otherwise(known),
            f"{literal}_var": F.when(hit, F.col("_var")).otherwise(var),
            f"{literal}_neg": F.when(hit & F.col("_known").isNull(), neg != F.col("_neg")).when(hit, F.lit(False)).otherwise(neg),
        }
    ).drop("_rank", "_var", "_neg", "_known")
