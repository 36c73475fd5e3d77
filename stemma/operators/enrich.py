"""Person enrichment: life events, family links, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.dates import parse_date
from stemma.functions.text import blank_to_null, has_text

# Event types that stand for a birth or a death.
BIRTH_TYPES = ("birth", "christening", "baptism")
DEATH_TYPES = ("death", "burial")


def _when_type(types: tuple[str, ...], order: Column, event_type: Column) -> Column:
    return F.when(event_type.isin(*types), order)


def person_events(events: DataFrame) -> DataFrame:
    """Events of persons; events that belong to a family only are left out."""
    return events.where("person_id is not null")


def event_summary(events: DataFrame) -> DataFrame:
    """One row per person: first dated birth and death texts, life events, event count.

    A single aggregation serves date derivation, summary rows and quality
    inputs; it combines on the map side, so one person may own any number of
    events.
    """
    kind, order = F.col("event_type"), F.col("event_id")
    lower = F.lower(kind)
    dated = F.when(has_text(F.col("date_text")), order)
    life = F.struct("date_year", "place")
    grouped = person_events(events).groupBy("person_id").agg(
        F.min_by("date_text", _when_type(BIRTH_TYPES, dated, kind)).alias("birth_text"),
        F.min_by("date_text", _when_type(DEATH_TYPES, dated, kind)).alias("death_text"),
        F.min_by(life, _when_type(BIRTH_TYPES, order, lower)).alias("b"),
        F.min_by(life, _when_type(DEATH_TYPES, order, lower)).alias("d"),
        F.count(F.lit(1)).alias("event_count"),
    )
    return grouped.select(
        "person_id",
        "birth_text",
        "death_text",
        F.col("b.date_year").alias("birth_year"),
        F.col("b.place").alias("birth_place"),
        F.col("d.date_year").alias("death_year"),
        F.col("d.place").alias("death_place"),
        "event_count",
    )


def child_edges(parent_children: DataFrame) -> DataFrame:
    """``(person_id, family_id)`` for every family a person is a child of."""
    return parent_children.select(F.col("child_id").alias("person_id"), "family_id")


def spouse_edges(families: DataFrame) -> DataFrame:
    """``(person_id, family_id)`` for every family a person is father or mother of."""
    fathers = families.select(F.col("father_id").alias("person_id"), "family_id")
    mothers = families.select(F.col("mother_id").alias("person_id"), "family_id")
    return fathers.unionByName(mothers).where("person_id is not null")


def parent_edges(families: DataFrame, parent_children: DataFrame) -> DataFrame:
    """``(person_id, child_id)``, distinct: a parent and a child of an own family."""
    children = parent_children.select("family_id", "child_id")
    return spouse_edges(families).join(children, "family_id").select("person_id", "child_id").dropDuplicates()


def id_lists(edges: DataFrame, value: str, name: str) -> DataFrame:
    """Sorted distinct ids per person, for nested results only."""
    return edges.select("person_id", value).dropDuplicates().groupBy("person_id").agg(
        F.array_sort(F.collect_list(value)).alias(name)
    )


def family_children(parent_children: DataFrame) -> DataFrame:
    """Children of each family without repeats, in sibling order."""
    firsts = parent_children.groupBy("family_id", "child_id").agg(F.min("sibling_order").alias("sibling_order"))
    return firsts.select("family_id", "child_id", "sibling_order")


def link_flags(families: DataFrame, parent_children: DataFrame) -> DataFrame:
    """Whether a person has parents, an own family and children; one aggregation for all three."""
    sizes = parent_children.groupBy("family_id").agg(F.lit(True).alias("_has_child"))
    as_child = child_edges(parent_children).select(
        "person_id", F.lit(True).alias("p"), F.lit(False).alias("f"), F.lit(False).alias("c")
    )
    as_spouse = spouse_edges(families).join(sizes, "family_id", "left").select(
        "person_id",
        F.lit(False).alias("p"),
        F.lit(True).alias("f"),
        F.coalesce("_has_child", F.lit(False)).alias("c"),
    )
    return as_child.unionByName(as_spouse).groupBy("person_id").agg(
        F.bool_or("p").alias("has_parents"),
        F.bool_or("f").alias("has_family"),
        F.bool_or("c").alias("has_children"),
    )


def enrich_persons(
    persons: DataFrame, families: DataFrame, parent_children: DataFrame, events: DataFrame
) -> DataFrame:
    """Persons with derived dates, parsed dates, life events and link flags.

    All joins are on ``person_id``, so persons are shuffled once.
    """
    joined = persons.join(event_summary(events), "person_id", "left").join(
        link_flags(families, parent_children), "person_id", "left"
    )
    dated = joined.select(
        *[c for c in persons.columns if c not in ("birth_date", "death_date")],
        F.coalesce(blank_to_null(F.col("birth_date")), F.col("birth_text")).alias("birth_date"),
        F.coalesce(blank_to_null(F.col("death_date")), F.col("death_text")).alias("death_date"),
        "birth_year",
        "birth_place",
        "death_year",
        "death_place",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_parents", "has_family", "has_children")],
    )
    # One parsing expression for both dates keeps the plan small.
    both = dated.withColumn("_parsed", F.transform(F.array("birth_date", "death_date"), parse_date))
    return both.withColumns({"birth": F.col("_parsed")[0], "death": F.col("_parsed")[1]}).drop("_parsed")


def referenced_places(events: DataFrame) -> DataFrame:
    """Distinct places of person events."""
    return person_events(events).where(has_text(F.col("place"))).groupBy("place_key").agg(
        F.first("place", ignorenulls=True).alias("name")
    )


def events_by_person(events: DataFrame) -> DataFrame:
    """Nested events per person in insertion order."""
    item = F.struct("event_id", "event_type", "date_text", "date_iso", "date_year", "place")
    return person_events(events).groupBy("person_id").agg(F.array_sort(F.collect_list(item)).alias("events"))
