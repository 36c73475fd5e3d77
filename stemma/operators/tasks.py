"""Research tasks suggested by gaps and by possible duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.functions.dates import YEAR
from stemma.functions.numeric import exact_round
from stemma.functions.text import has_text

# Kind, objective and hypothesis of each suggestion.
TASKS = {
    "birth": ("birth", "Buscar baptisme/naixement", "Es desconeix la data de naixement"),
    "precise_birth": ("birth", "Precisar data de naixement (dia i mes)", "Només es coneix l'any"),
    "marriage": ("marriage", "Buscar matrimoni", "No consta cap unió"),
    "death": ("death", "Buscar defunció", "Es desconeix la defunció"),
    "parents": ("parents", "Identificar pares", "No es coneix la família d'origen"),
}

# Kinds of high and low priority; the others are medium.
HIGH = ("duplicate", "death", "error")
LOW = ("parents", "place", "toponym")

# Default length of the task list, and of each kind's list.
FIRST_TASKS, PER_KIND = 200, 12


def _task(step: int, task: str) -> Column:
    kind, objective, hypothesis = TASKS[task]
    return F.struct(
        F.lit(step).alias("step"), F.lit(objective).alias("objective"), F.lit(kind).alias("kind"),
        F.lit(hypothesis).alias("hypothesis"),
    )


def person_tasks(persons: DataFrame) -> DataFrame:
    """Tasks of every person in a single narrow pass."""
    born = has_text(F.col("birth_date"))
    tasks = F.array_compact(
        F.array(
            F.when(~born, _task(1, "birth")).when(F.col("birth.precision") == YEAR, _task(1, "precise_birth")),
            F.when(has_text(F.col("sex")) & ~F.col("has_family"), _task(2, "marriage")),
            F.when(~has_text(F.col("death_date")), _task(3, "death")),
            F.when(~F.col("has_parents"), _task(4, "parents")),
        )
    )
    rows = persons.select("person_id", "xref", F.explode(tasks).alias("t"))
    return rows.select(
        "person_id",
        "xref",
        "t.objective",
        "t.kind",
        "t.hypothesis",
        F.array().cast("array<bigint>").alias("related_person_ids"),
        F.struct(
            F.lit(0).alias("block"), F.lit(0.0).alias("rank"), F.col("person_id").alias("i"),
            F.col("t.step").cast("bigint").alias("j"),
        ).alias("position"),
    )


def duplicate_tasks(candidates: DataFrame) -> DataFrame:
    """One review task per candidate pair."""
    objective = F.concat(
        F.lit("Revisar possible duplicat entre "), F.col("a_name"), F.lit(" i "), F.col("b_name")
    )
    return candidates.select(
        F.col("a_id").alias("person_id"),
        F.col("a_xref").alias("xref"),
        objective.alias("objective"),
        F.lit("duplicate").alias("kind"),
        F.concat(F.lit("Similitud "), _two_decimals(F.col("score"))).alias("hypothesis"),
        F.array("b_id").alias("related_person_ids"),
        F.struct(
            F.lit(1).alias("block"), (-F.col("score")).alias("rank"), F.col("a_id").alias("i"), F.col("b_id").alias("j")
        ).alias("position"),
    )


def _two_decimals(score: Column) -> Column:
    hundredths = F.round(exact_round(score, 2) * 100).cast("int")
    whole = F.floor(hundredths / 100).cast("int").cast("string")
    return F.concat(whole, F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def all_tasks(persons: DataFrame, candidates: DataFrame) -> DataFrame:
    """Person tasks and duplicate reviews with status and priority."""
    tasks = person_tasks(persons).unionByName(duplicate_tasks(candidates))
    return tasks.select("*", F.lit("open").alias("status"), priority(F.col("kind")).alias("priority"))


def priority(kind: Column) -> Column:
    lower = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(lower.isin(*HIGH), F.lit("high")).when(lower.isin(*LOW), F.lit("low")).otherwise(F.lit("medium"))


def first_tasks(tasks: DataFrame, n: int = FIRST_TASKS) -> DataFrame:
    """The first ``n`` tasks: persons by id, then duplicates by score."""
    return tasks.orderBy("position").limit(n)


def task_records(tasks: DataFrame) -> DataFrame:
    """Tasks as stored records, without their kind."""
    return tasks.select(
        "person_id", "objective", "hypothesis", "related_person_ids", F.lit("open").alias("status")
    )


def filter_tasks(
    tasks: DataFrame, status: str = "all", priority: str = "all", kind: str = "all", text: str = ""
) -> DataFrame:
    """Tasks of a status, priority and kind whose objective or record id holds a text."""
    for column, wanted in (("status", status), ("priority", priority), ("kind", kind)):
        if wanted != "all":
            tasks = tasks.where(F.col(column) == wanted)
    needle = text.strip().lower()
    if needle:
        haystack = F.lower(F.concat(F.col("objective"), F.lit(" "), F.coalesce("xref", F.lit(""))))
        tasks = tasks.where(F.contains(haystack, F.lit(needle)))
    return tasks


def task_kinds(tasks: DataFrame) -> DataFrame:
    """Kinds with their number of tasks, in alphabetic order."""
    return tasks.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")


def first_per_kind(tasks: DataFrame, n: int = PER_KIND) -> DataFrame:
    """The first ``n`` tasks of each kind.

    Spark keeps only ``n`` rows per kind in each input partition before the
    shuffle (window group limit), so a kind may hold most of the tasks.
    """
    order = W.partitionBy("kind").orderBy("position")
    return tasks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def tasks_of(tasks: DataFrame, persons: DataFrame) -> DataFrame:
    """Tasks of the persons in a ``person_id`` table."""
    return tasks.join(persons.select("person_id").dropDuplicates(), "person_id", "left_semi")
