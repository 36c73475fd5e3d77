"""Import statistics and demographic statistics.

Counts come as long ``(metric, key, value)`` rows or one-row tables, so
nothing is gathered on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.dates import normalize_date
from stemma.functions.numeric import exact_round
from stemma.functions.text import has_text, place_key

# Lengths of the top lists.
TOP_PLACES, TOP_SURNAMES, LARGEST_BRANCHES = 10, 15, 5


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(entity, n)`` per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("entity"), "n") for k, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def sex_code(sex: Column) -> Column:
    """Upper-case sex, ``U`` when missing."""
    return F.upper(F.when(has_text(sex), sex).otherwise(F.lit("U")))


def sex_distribution(persons: DataFrame) -> DataFrame:
    return persons.groupBy(sex_code(F.col("sex")).alias("sex")).agg(F.count(F.lit(1)).alias("n"))


def males_females(persons: DataFrame) -> DataFrame:
    code = sex_code(F.col("sex"))
    return persons.agg(F.count_if(code == "M").alias("males"), F.count_if(code == "F").alias("females"))


def events_by_type(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    label = F.lower(F.when(has_text(kind), kind).otherwise(F.lit("unknown")))
    return events.groupBy(label.alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


def surname_frequency(persons: DataFrame) -> DataFrame:
    """Persons per surname; works on name variants as well."""
    return persons.where(has_text(F.col("surname"))).groupBy("surname").agg(F.count(F.lit(1)).alias("n"))


def top_surnames(persons: DataFrame, n: int = TOP_SURNAMES) -> DataFrame:
    return surname_frequency(persons).orderBy(F.desc("n"), "surname").limit(n)


def persons_without_name(persons: DataFrame, names: DataFrame) -> DataFrame:
    """How many persons have no usable name variant."""
    usable = names.where(has_text(F.col("given")) | has_text(F.col("surname"))).select(
        F.col("owner_xref").alias("xref")
    )
    return persons.join(usable, "xref", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def distinct_places(events: DataFrame) -> DataFrame:
    """Number of distinct place keys."""
    return events.agg(F.count_distinct(place_key(F.col("place"))).alias("places"))


def life_event_counts(events: DataFrame) -> DataFrame:
    """Birth and death events; counts events, not persons."""
    kind = F.lower("event_type")
    return events.agg(
        F.count_if(kind == "birth").alias("persons_with_birth"),
        F.count_if(kind == "death").alias("persons_with_death"),
    )


def import_birth_years(events: DataFrame) -> DataFrame:
    """Range of birth years by the import date flavour."""
    year = F.when(F.lower("event_type") == "birth", normalize_date(F.col("date_text"))["year"])
    return events.select(year.alias("y")).agg(F.min("y").alias("min_year"), F.max("y").alias("max_year"))


def unresolved_references(links: DataFrame, sources: DataFrame, media: DataFrame, notes: DataFrame) -> DataFrame:
    """Source, media and note pointers that lead to none of the three tables."""
    known = sources.select("xref").unionByName(media.select("xref")).unionByName(notes.select("xref"))
    refs = links.where(F.col("tag").isin("SOUR", "OBJE", "NOTE"))
    return refs.join(known.withColumnRenamed("xref", "target"), "target", "left_anti").agg(
        F.count(F.lit(1)).alias("unresolved_refs")
    )


def incomplete_persons(persons: DataFrame) -> DataFrame:
    """Persons without a name, and without a name and dates."""
    named = has_text(F.col("given_name")) | has_text(F.col("surname"))
    dated = has_text(F.col("birth_date")) | has_text(F.col("death_date"))
    return persons.agg(
        F.count_if(~named).alias("persons_without_name"),
        F.count_if(~(named | dated)).alias("persons_without_data"),
    )


def age_at_death(persons: DataFrame) -> DataFrame:
    """Average (one decimal) and highest age of persons whose death year is not before their birth year."""
    age = F.col("death.year") - F.col("birth.year")
    ages = persons.select(F.when(age >= 0, age).alias("age"))
    return ages.agg(
        exact_round(F.sum("age") / F.count("age"), 1).alias("average_age"), F.max("age").alias("max_age")
    )


def persons_by_year(persons: DataFrame, column: str) -> DataFrame:
    """Persons per ``birth`` or ``death`` year, ordered as a series."""
    year = F.col(f"{column}.year")
    return persons.where(year.isNotNull()).groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n"))


def year_series(by_year: DataFrame) -> DataFrame:
    """Yearly counts in numeric order."""
    return by_year.orderBy("year")


def birth_year_range(persons: DataFrame, events: DataFrame) -> DataFrame:
    """Range over the persons' birth years and the years of the birth events of persons."""
    own = persons.select(F.col("birth.year").alias("y"))
    told = events.where(F.col("person_id").isNotNull() & (F.lower("event_type") == "birth"))
    from_events = told.select(F.col("date_year").alias("y"))
    return own.unionByName(from_events).agg(F.min("y").alias("min_year"), F.max("y").alias("max_year"))


def top_places(events: DataFrame, n: int = TOP_PLACES) -> DataFrame:
    """The most frequent places of events of persons."""
    named = events.where(F.col("person_id").isNotNull() & has_text(F.col("place"))).select(F.col("place").alias("name"))
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(n)


def largest_branches(parent_children: DataFrame, n: int = LARGEST_BRANCHES) -> DataFrame:
    """Families with the most children."""
    sizes = parent_children.groupBy("family_id").agg(F.count_distinct("child_id").alias("children"))
    return sizes.orderBy(F.desc("children"), "family_id").limit(n)


def totals(
    persons: DataFrame, families: DataFrame, events: DataFrame, sources: int | DataFrame = 0, media: int | DataFrame = 0
) -> DataFrame:
    """One row: number of persons, families, events, sources and media."""

    def count(df: int | DataFrame, name: str) -> DataFrame:
        if isinstance(df, int):
            return persons.sparkSession.range(1).select(F.lit(df).cast("bigint").alias(name))
        return df.agg(F.count(F.lit(1)).alias(name))

    named = {"persons": persons, "families": families, "events": events, "sources": sources, "media": media}
    return one_row(*[count(df, name) for name, df in named.items()])


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def first_persons(persons: DataFrame, n: int) -> DataFrame:
    """The first ``n`` persons by id."""
    return persons.orderBy("person_id").limit(n)


def long_form(metric: str, df: DataFrame, key: str, value: str = "n") -> DataFrame:
    """``(metric, key, value)`` rows of a grouped count."""
    return df.select(
        F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key"), F.col(value).cast("bigint").alias("value")
    )


def import_statistics(
    persons: DataFrame,
    families: DataFrame,
    events: DataFrame,
    names: DataFrame,
    links: DataFrame,
    sources: DataFrame,
    media: DataFrame,
    notes: DataFrame,
) -> DataFrame:
    """All import statistics as ``(metric, key, value)``."""

    def single(df: DataFrame, column: str, metric: str | None = None) -> DataFrame:
        return df.select(
            F.lit(metric or column).alias("metric"), F.lit("").alias("key"), F.col(column).cast("bigint").alias("value")
        )

    person_side = events.where("person_id is not null")
    tables = {
        "persons": persons, "families": families, "sources": sources, "media": media, "notes": notes, "events": events,
    }
    counts = row_counts(tables).select(
        F.col("entity").alias("metric"), F.lit("").alias("key"), F.col("n").alias("value")
    )
    life, years = life_event_counts(person_side), import_birth_years(person_side)
    parts = [
        counts,
        long_form("events_by_type", events_by_type(events), "event_type"),
        long_form("sex_by", sex_distribution(persons), "sex"),
        long_form("surname_frequency", surname_frequency(names), "surname"),
        single(persons_without_name(persons, names), "n", "persons_without_name"),
        single(distinct_places(events), "places"),
        single(life, "persons_with_birth"),
        single(life, "persons_with_death"),
        single(years, "min_year", "birth_year_min"),
        single(years, "max_year", "birth_year_max"),
        single(unresolved_references(links, sources, media, notes), "unresolved_refs"),
    ]
    return reduce(DataFrame.unionByName, parts)
