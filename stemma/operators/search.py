"""Lookups and searches over persons and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.names import display_name
from stemma.functions.text import fold
from stemma.operators.quality import quality_inputs, quality_scores

# Default page lengths.
PERSON_PAGE, PLACE_PAGE = 50, 100


def lookup(table: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose column equals a value; the filter reaches the Parquet scan."""
    return table.where(F.col(column) == value)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered table."""
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def search_persons(persons: DataFrame, q: str | None = None, sex: str | None = None, limit: int = PERSON_PAGE, offset: int = 0) -> DataFrame:
    """Basic search: a text within given name or surname, and sex."""
    if q:
        pattern = f"%{q}%"
        persons = persons.where(F.col("given_name").ilike(pattern) | F.col("surname").ilike(pattern))
    if sex:
        persons = persons.where(F.col("sex") == sex)
    return page(persons.orderBy("surname", "given_name", "person_id"), limit, offset)


def summaries(persons: DataFrame) -> DataFrame:
    """Summary rows of enriched persons."""
    return persons.select(
        "person_id",
        "xref",
        "given_name",
        "surname",
        "sex",
        display_name(F.col("given_name"), F.col("surname"), F.col("xref")).alias("display_name"),
        "birth_date",
        "death_date",
        "birth_year",
        "death_year",
        "birth_place",
        "death_place",
    )


def _holds(column: Column, text: str) -> Column:
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(text.lower()))


def find_persons(
    persons: DataFrame,
    events: DataFrame,
    q: str | None = None,
    given_name: str | None = None,
    surname: str | None = None,
    sex: str | None = None,
    place: str | None = None,
    birth_year: int | None = None,
) -> DataFrame:
    """All enriched persons that pass every filter that is set."""
    given, family = F.coalesce("given_name", F.lit("")), F.coalesce("surname", F.lit(""))
    if q:
        persons = persons.where(_holds(F.concat(given, F.lit(" "), family), q))
    if given_name:
        persons = persons.where(_holds(given, given_name))
    if surname:
        persons = persons.where(_holds(family, surname))
    if sex:
        persons = persons.where(F.col("sex") == sex)
    if birth_year is not None:
        persons = persons.where(F.col("birth_year") == birth_year)
    if place:
        there = events.where(F.col("person_id").isNotNull() & _holds(F.col("place"), place)).select("person_id")
        persons = persons.join(there, "person_id", "left_semi")
    return persons


def search_catalog(persons: DataFrame, events: DataFrame, limit: int = PERSON_PAGE, offset: int = 0, **filters: object) -> DataFrame:
    """Full search: one ordered page of summaries with the quality score of each row."""
    matched = find_persons(persons, events, **filters)
    order = [F.coalesce("surname", F.lit("")), F.coalesce("given_name", F.lit("")), F.col("person_id")]
    shown = page(matched.orderBy(*order), limit, offset)
    scores = quality_scores(quality_inputs(shown)).select("person_id", F.col("score").alias("quality"))
    return summaries(shown).join(scores, "person_id").orderBy(*order)


def list_places(places: DataFrame, q: str | None = None, limit: int = PLACE_PAGE, offset: int = 0) -> DataFrame:
    """Places by name, optionally those holding a text."""
    if q:
        places = places.where(F.col("name").ilike(f"%{q}%"))
    return page(places.orderBy("name"), limit, offset)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def token_index(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """Distinct ``(token, key)`` over the whole texts of some columns."""
    text = F.concat_ws(" ", *columns)
    exploded = table.select(key, F.explode(F.array_distinct(_tokens(text))).alias("token"))
    return exploded.select("token", key).dropDuplicates()


def search_index(index: DataFrame, key: str, query: str, limit: int | None = PERSON_PAGE) -> DataFrame:
    """Keys whose text holds every word of the query, lowest keys first."""
    wanted = F.array_distinct(_tokens(F.lit(query)))
    hits = index.where(F.array_contains(wanted, F.col("token")))
    found = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size(wanted)).select(key)
    return found if limit is None else found.orderBy(key).limit(limit)
