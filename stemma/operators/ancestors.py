"""Ancestors of many persons at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.session import cut_lineage

# Default and highest number of generations.
DEFAULT_DEPTH, MAX_DEPTH = 3, 6


def ancestor_edges(families: DataFrame, parent_children: DataFrame) -> DataFrame:
    """Distinct ``(child_id, parent_id)`` over both parents of each family."""
    couples = families.selectExpr("family_id", "stack(2, father_id, mother_id) as parent_id").where("parent_id is not null")
    return parent_children.select("family_id", "child_id").join(couples, "family_id").select(
        "child_id", "parent_id"
    ).dropDuplicates()


def ancestors(roots: DataFrame, edges: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """``(root_id, person_id, depth)``: each ancestor once, at its smallest depth; the root has depth 0.

    One equi-join per generation for all roots together. A generation is
    written once and read by the next one. A cycle only repeats persons,
    which the final aggregation removes, so the walk always ends.
    """
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"depth is between 1 and {MAX_DEPTH}")
    edges = cut_lineage(edges)
    level = roots.select(F.col("person_id").alias("root_id"), F.col("person_id"))
    levels = [level.withColumn("depth", F.lit(0))]
    for depth in range(1, max_depth + 1):
        step = level.join(edges, F.col("person_id") == F.col("child_id")).select(
            "root_id", F.col("parent_id").alias("person_id")
        )
        level = cut_lineage(step.dropDuplicates())
        levels.append(level.withColumn("depth", F.lit(depth)))
    walked = reduce(DataFrame.unionByName, levels)
    return walked.groupBy("root_id", "person_id").agg(F.min("depth").alias("depth"))


def tree_nodes(found: DataFrame, edges: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """``(root_id, child_id, parent_id, depth)``: nodes of the drawn trees below their root.

    A person reached twice is drawn twice but expanded once.
    """
    expanded = found.where(F.col("depth") < max_depth)
    return expanded.join(edges, F.col("person_id") == F.col("child_id")).select(
        "root_id", "child_id", "parent_id", (F.col("depth") + 1).alias("depth")
    )


def tree_sizes(found: DataFrame, edges: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """``(root_id, person_count)``: nodes of each drawn tree, the root included.

    Parents are counted per child once; the trees themselves are not built.
    """
    per_child = edges.groupBy("child_id").agg(F.count(F.lit(1)).alias("n"))
    counted = found.join(per_child, F.col("person_id") == F.col("child_id"), "left")
    drawn = F.when(F.col("depth") < max_depth, F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    return counted.groupBy("root_id").agg((F.sum(drawn) + 1).alias("person_count"))


def tree_rows(nodes: DataFrame, persons: DataFrame, events: DataFrame) -> DataFrame:
    """Tree nodes with name, sex and the first dated birth and death year of the parent."""
    year = lambda kind: F.min_by(
        "date_year", F.when((F.col("event_type") == kind) & F.col("date_year").isNotNull(), F.col("event_id"))
    )
    years = events.where("person_id is not null").groupBy("person_id").agg(
        year("birth").alias("birth_year"), year("death").alias("death_year")
    )
    shown = persons.select("person_id", "xref", "given_name", "surname", "sex").join(years, "person_id", "left")
    return nodes.join(shown, F.col("parent_id") == F.col("person_id")).drop("person_id")
