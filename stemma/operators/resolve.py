"""From parsed records to conformed dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.functions.dates import normalize_date
from stemma.functions.text import (
    blank_to_null,
    letters_key,
    place_key,
    search_name,
    slug,
    soundex,
    title_given,
    title_surname,
)
from stemma.operators import keys, merges
from stemma.operators.pair_rules import keep_where
from stemma.session import cut_lineage


def latest_per_xref(records: DataFrame, order: str = "seq", key: str = "xref") -> DataFrame:
    """Keep the last record of every id. Aggregates before the shuffle, so a hot id is no burden."""
    rest = [c for c in records.columns if c != key]
    last = records.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return last.select(key, "r.*").select(*records.columns)


def person_rows(records: DataFrame) -> DataFrame:
    """Normalised person rows from ``(xref, seq, given, surname, sex, notes)``."""
    named = latest_per_xref(records).select(
        "xref",
        "seq",
        title_given(F.col("given")).alias("given_name"),
        title_surname(F.col("surname")).alias("surname"),
        "sex",
        blank_to_null(F.col("notes")).alias("notes"),
    )
    full = search_name(F.col("given_name"), F.col("surname"))
    return named.select(
        "*",
        blank_to_null(full).alias("search_name"),
        slug(full).alias("slug"),
        soundex(F.col("surname")).alias("soundex"),
        letters_key(full).alias("metaphone"),
    )


def place_dimension(spellings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per place key with its first-seen spelling.

    ``spellings`` holds ``(place, seq)``. A stored place of the same name is
    reused: ``existing_id`` is then its id. Spellings are counted down to the
    distinct ones before any key is made, so a frequent place is neither
    sorted nor shuffled row by row.
    """
    distinct = spellings.where("place is not null").groupBy("place").agg(F.min("seq").alias("seq"))
    # A plain filter on the key would be moved below the grouping, and the key be made for every row.
    keyed = keep_where(distinct.select(place_key(F.col("place")).alias("place_key"), "place", "seq"), F.col("place_key").isNotNull())
    firsts = keyed.groupBy("place_key").agg(
        F.min_by("place", "seq").alias("name"), F.min("seq").alias("first_seq")
    )
    if existing is None:
        return firsts.withColumn("existing_id", F.lit(None).cast("bigint"))
    stored = existing.select(F.col("place_id").alias("existing_id"), "name")
    return firsts.join(stored, "name", "left").select("place_key", "name", "first_seq", "existing_id")


def source_map(records: DataFrame) -> DataFrame:
    """Which stored source each source record leads to: the first record of its title.

    ``records`` holds ``(xref, seq, title, author)``; the result holds
    ``(xref, title, source_xref, author)``.
    """
    titled = latest_per_xref(records).select(
        "xref", "seq", F.coalesce(blank_to_null(F.col("title")), F.col("xref")).alias("title"), "author"
    )
    kept = titled.groupBy("title").agg(
        F.min_by("xref", "seq").alias("source_xref"),
        F.min_by(F.struct(blank_to_null(F.col("author")).alias("author")), "seq").alias("first"),
    )
    return titled.select("xref", "title").join(kept, "title").select(
        "xref", "title", "source_xref", F.col("first.author").alias("author")
    )


def source_rows(mapping: DataFrame) -> DataFrame:
    """Stored sources: one row per title."""
    return mapping.where("xref = source_xref").select("xref", "title", "author")


def media_rows(records: DataFrame) -> DataFrame:
    """Stored media; the path of a record without a file is empty."""
    return latest_per_xref(records).select(
        "xref", F.coalesce("file", F.lit("")).alias("file_path"), F.col("title").alias("caption")
    )


def family_rows(records: DataFrame, persons: DataFrame) -> DataFrame:
    """Families with husband and wife resolved to person ids, NULL when unknown."""
    fathers = persons.select(F.col("person_id").alias("father_id"), F.col("xref").alias("husband_xref"))
    mothers = persons.select(F.col("person_id").alias("mother_id"), F.col("xref").alias("wife_xref"))
    return (
        records.select("family_id", "xref", "husband_xref", "wife_xref")
        .join(fathers, "husband_xref", "left")
        .join(mothers, "wife_xref", "left")
        .select("family_id", "xref", "father_id", "mother_id")
    )


def with_marriage(families: DataFrame, events: DataFrame) -> DataFrame:
    """Fill marriage date and place from the first marriage event of the family or its couple."""
    marriages = events.where(F.lower("event_type") == "marriage")
    first = marriages.where("family_id is not null").groupBy("family_id").agg(
        F.min_by(F.struct("date_text", "place"), "event_id").alias("m")
    )
    return families.drop("marriage_date", "marriage_place").join(first, "family_id", "left").select(
        *[c for c in families.columns if not c.startswith("marriage_")],
        F.col("m.date_text").alias("marriage_date"),
        F.col("m.place").alias("marriage_place"),
    )


def parent_child_rows(children: DataFrame, persons: DataFrame, families: DataFrame) -> DataFrame:
    """Facts for children that exist; the order counts every pointer of the record.

    ``children`` holds ``(family_xref, child_xref, sibling_order)`` where the
    order is the position within the family record, so no window is needed.
    """
    known = persons.select(F.col("person_id").alias("child_id"), F.col("xref").alias("child_xref"))
    owners = families.select("family_id", "father_id", F.col("xref").alias("family_xref"))
    return (
        children.select("family_xref", "child_xref", "sibling_order")
        .join(known, "child_xref")
        .join(owners, "family_xref")
        .select(
            "family_id",
            "child_id",
            F.col("father_id").alias("parent_id"),
            F.when(F.col("father_id").isNotNull(), F.lit("father")).alias("role"),
            "sibling_order",
        )
    )


def event_rows(events: DataFrame, places: DataFrame) -> DataFrame:
    """Event facts with normalised date and the stored name of the place.

    ``events`` holds ``(event_id, person_id, family_id, event_type, date_text, place)``.
    Dates and places are read once per distinct text; the written tables have
    a known size, so they are broadcast if they are small.
    """
    both = F.array(
        F.struct(F.lit("date").alias("kind"), F.col("date_text").alias("text")),
        F.struct(F.lit("place").alias("kind"), F.col("place").alias("text")),
    )
    texts = cut_lineage(events.select(F.explode(both).alias("x")).select("x.kind", "x.text").where("text is not null").distinct())
    own = lambda kind: texts.where(F.col("kind") == kind)
    read_dates = cut_lineage(own("date").select(F.col("text").alias("date_text"), normalize_date(F.col("text")).alias("d")))
    read_places = cut_lineage(own("place").select(F.col("text").alias("place"), place_key(F.col("text")).alias("place_key")))
    dated = events.join(read_dates, "date_text", "left").join(read_places, "place", "left").select(
        "event_id",
        "person_id",
        "family_id",
        F.lower("event_type").alias("event_type"),
        "date_text",
        F.col("d.iso").alias("date_iso"),
        F.col("d.year").alias("date_year"),
        "place_key",
    )
    names = places.select("place_key", F.col("name").alias("place"))
    return dated.join(names, "place_key", "left").select(
        "event_id",
        "person_id",
        "family_id",
        "event_type",
        "date_text",
        "date_iso",
        "date_year",
        "place_key",
        "place",
    )


def link_rows(links: DataFrame, owners: DataFrame, targets: DataFrame, tag: str) -> DataFrame:
    """Bridge rows without repeats; unknown owners and targets drop out.

    ``owners`` holds ``(owner_xref, owner_id)``, ``targets`` ``(target, target_id)``.
    """
    return (
        links.where(F.col("tag") == tag)
        .select("owner_xref", "target")
        .join(owners, "owner_xref")
        .join(targets, "target")
        .select("owner_id", "target_id")
        .dropDuplicates()
    )


def import_summary(counts: dict[str, DataFrame]) -> DataFrame:
    """One ``(metric, value)`` row per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
        for name, df in counts.items()
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def append_new(existing: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split new rows into those a unique key admits and those it refuses.

    Rows whose key is stored already, or comes twice in the batch, are
    refused; the first of the batch (lowest ``seq``) is admitted.
    """
    stored = existing.select(key).dropDuplicates()
    first = new.groupBy(key).agg(F.min("seq").alias("_first"))
    status = new.join(first, key, "left").join(stored.withColumn("_stored", F.lit(True)), key, "left")
    reason = F.when(F.col("_stored"), F.lit("stored")).when(
        F.col("seq") > F.col("_first"), F.lit("repeated")
    )
    flagged = status.withColumn("reason", F.when(F.col(key).isNotNull(), reason)).drop("_first", "_stored")
    return flagged.where("reason is null").drop("reason"), flagged.where("reason is not null")


# Why a merge is refused.
MERGE_SELF = "No es pot fusionar una persona amb si mateixa"
MERGE_MISSING = "Una de les persones no existeix"
MERGE_SAME_XREF = "xref duplicat; revisa la coherència"


def check_merges(decisions: DataFrame, persons: DataFrame, order: str = "seq") -> DataFrame:
    """Every decision ``(primary_id, secondary_id)`` with its ``conflict``, NULL when it stands.

    Decisions are taken one after the other, by ``order``: one that stands
    removes its secondary, and a later one that needs a person removed before
    is refused. See `merges.removed_before` for how that is found in parallel.
    """
    ranked = keys.dense_ids(
        decisions.select(F.col(order).alias("_order"), "primary_id", "secondary_id"),
        "rank", F.col("_order"), F.col("primary_id"), F.col("secondary_id"),
    )
    first = persons.select(F.col("person_id").alias("primary_id"), F.col("xref").alias("primary_xref"))
    second = persons.select(F.col("person_id").alias("secondary_id"), F.col("xref").alias("secondary_xref"))
    found = ranked.join(first.withColumn("_p", F.lit(True)), "primary_id", "left").join(
        second.withColumn("_s", F.lit(True)), "secondary_id", "left"
    )
    same = F.upper(F.coalesce("primary_xref", F.lit(""))) == F.upper(F.coalesce("secondary_xref", F.lit("")))
    there = F.col("_p").isNotNull() & F.col("_s").isNotNull()
    alone = F.coalesce(F.col("primary_id") == F.col("secondary_id"), F.lit(False))
    judged = cut_lineage(
        found.select("rank", "primary_id", "secondary_id", alone.alias("self"), there.alias("there"), same.alias("same"))
    )
    asked = judged.where("there and not self").select("rank", "primary_id", "secondary_id", (~F.col("same")).alias("takes"))
    gone = merges.removed_before(asked)
    conflict = (
        F.when(F.col("self"), F.lit(MERGE_SELF))
        .when(~F.col("there") | F.col("gone"), F.lit(MERGE_MISSING))
        .when(F.col("same"), F.lit(MERGE_SAME_XREF))
    )
    return judged.join(gone, "rank", "left").select("primary_id", "secondary_id", conflict.alias("conflict"))


def apply_merges(persons: DataFrame, checked: DataFrame) -> DataFrame:
    """Persons without the secondaries of decisions that stand."""
    gone = checked.where("conflict is null").select(F.col("secondary_id").alias("person_id"))
    return persons.join(gone, "person_id", "left_anti")
