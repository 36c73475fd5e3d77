"""The registered queries: each takes a session and a data folder and returns a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import dates, labels, names, places, text
from stemma.operators import (
    ancestors,
    duplicates,
    enrich,
    findings,
    integrity,
    keys,
    periods,
    quality,
    relations,
    resolve,
    search,
    statistics,
    tasks,
    variants,
)
from stemma.operators.pair_rules import CustomRule, Settings
from stemma.plans import fixtures, imports
from stemma.plans.dataset import Dataset, from_fixtures
from stemma.plans.rendering import nation_documents, write_gedcom
from stemma.session import cut_lineage, staging_dir
from stemma.sources import gedcom, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_datasets: dict[tuple[str, str], Dataset] = {}
_parsed: dict[tuple[str, str], DataFrame] = {}


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    """The data set of a folder, its shared tables written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _datasets:
        _datasets[key] = from_fixtures(spark, sf_dir)
    return _datasets[key]


def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The GEDCOM files of a folder, parsed once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _parsed:
        _parsed[key] = cut_lineage(gedcom.parse_records(gedcom.read_records(spark, write_gedcom(spark, sf_dir))))
    return _parsed[key]


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def on_dataset(name: str) -> Callable[[Callable[[Dataset], DataFrame]], Callable]:
    """Register a query over the conformed tables."""

    def register(function: Callable[[Dataset], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: function(dataset(spark, sf_dir))
        return function

    return register


def on_files(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Register a query over the parsed files."""

    def register(function: Callable[[DataFrame], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: function(parsed_files(spark, sf_dir))
        return function

    return register


def _joined(column: str | Column, separator: str = "|") -> Column:
    return F.array_join(column, separator)


# ------------------------------------------------------------- scans of files

@on_files("gedcom_lines")
def _(parsed: DataFrame) -> DataFrame:
    lines = gedcom.line_table(parsed)
    return lines.groupBy("level", "tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") != "").alias("with_value"))


@on_files("gedcom_tree")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.line_table(parsed).groupBy("parent_tag", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("gedcom_rejected_lines")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    parsed = gedcom.parse_records(gedcom.records_from_text(whole))
    bad = gedcom.rejected_lines(parsed)
    return bad.groupBy("path", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


@on_files("gedcom_documents")
def _(parsed: DataFrame) -> DataFrame:
    roots = gedcom.entities(parsed)
    return roots.where(~F.col("tag").isin("HEAD", "TRLR")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("xref").alias("ids")
    )


@on_files("gedcom_persons")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.persons(gedcom.entities(parsed)).select(
        "xref", "sex", F.coalesce("given", F.lit("")).alias("given"), F.coalesce("surname", F.lit("")).alias("surname")
    )


@on_files("gedcom_names")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.person_names(gedcom.entities(parsed)).select("owner_xref", "position", "given", "surname", "suffix")


@on_files("gedcom_families")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.families(gedcom.entities(parsed)).drop("seq")


@on_files("gedcom_family_children")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.family_children(gedcom.entities(parsed)).drop("seq")


@on_files("gedcom_events")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.events(gedcom.entities(parsed)).select("owner_xref", "owner_kind", "event_type", "date_text", "place")


@on_files("gedcom_first_births")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.first_events(gedcom.events(gedcom.entities(parsed)), "birth")


@on_files("gedcom_sources")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.sources(gedcom.entities(parsed)).drop("seq")


@on_files("gedcom_media")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.media(gedcom.entities(parsed)).drop("seq")


@on_files("gedcom_notes")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.notes(gedcom.entities(parsed)).select("xref", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query("import_in_two_parts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per stored table and batch after three imports into one folder.

    The first import holds all but the families, as one document. The second
    holds the families, each with a malformed line; their members are in
    another document. The third holds every tenth person again and is refused
    as a whole.
    """
    records = gedcom.read_records(spark, write_gedcom(spark, sf_dir))
    tag = F.regexp_extract("text", "^0 (?:@[^@]*@ )?([A-Z]+)", 1)
    folder = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
    again = records.where((tag == "INDI") & F.col("text").rlike("^0 @I[0-9]*0@"))
    families = records.where(tag == "FAM").withColumn("text", F.concat("text", F.lit("\nno level")))
    for name, part in (("people", records.where(tag != "FAM")), ("families", families), ("again", again)):
        # A part of a file counts as a file with its head.
        imports.import_records(part.withColumn("head", F.lit(True)), folder, fail_fast=False, document=F.lit(name))
    stored = {**imports.stored_tables(spark, folder), **imports.stored_reports(spark, folder)}
    counted = [
        stored[name].groupBy("batch").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        for name in (
            "persons", "families", "parent_children", "events", "places", "sources", "media", "person_sources", "person_media",
            "event_sources", "event_media", "rejected", "conflicts",
        )
    ]
    rows = counted[0]
    for more in counted[1:]:
        rows = rows.unionByName(more)
    return rows.select("name", "batch", "n")


def _imported_nations(spark: SparkSession, sf_dir: str) -> str:
    """The folder that holds one import of many documents, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _nations:
        folder = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
        imports.import_records(nation_documents(spark, sf_dir), folder, fail_fast=False)
        _nations[key] = folder
    return _nations[key]


_nations: dict[tuple[str, str], str] = {}


@query("import_documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of one document per nation: all use the same ids, and some are refused."""
    folder = _imported_nations(spark, sf_dir)
    stored = {**imports.stored_tables(spark, folder), **imports.stored_reports(spark, folder)}
    people = stored["persons"].select(F.col("id").alias("person_id"), F.col("xref").alias("key"))
    told = stored["events"].select(F.col("id").alias("event_id"), "person_id", "event_type", "date_text").join(people, "person_id")
    titles = stored["sources"].select(F.col("id").alias("source_id"), F.col("title").alias("detail"))
    files = stored["media"].select(F.col("id").alias("media_id"), F.col("file_path").alias("detail"))
    named = lambda role: people.select(F.col("person_id").alias(f"{role}_id"), F.col("key").alias(role))
    families = stored["families"].select(F.col("id").alias("family_id"), F.col("xref").alias("family"), "father_id", "mother_id")
    couples = families.join(named("father"), "father_id", "left").join(named("mother"), "mother_id", "left")
    kids = stored["parent_children"].join(families.drop("father_id", "mother_id"), "family_id").join(named("child"), "child_id")
    joined = lambda *parts: F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    audited = [
        stored[name].agg(F.countDistinct("uuid").alias("a"), F.count("created_at").alias("b"), F.count("updated_at").alias("c"))
        .select(F.lit(name).alias("key"), joined("a", "b", "c").alias("detail"))
        for name in ("persons", "families", "events", "sources", "media")
    ]
    found = {
        "person": people.select("key", F.lit("").alias("detail")),
        "event": told.select("key", joined("event_type", "date_text").alias("detail")),
        "family": couples.select(F.col("family").alias("key"), joined("father", "mother").alias("detail")),
        "child": kids.select(F.col("family").alias("key"), joined("child", "sibling_order").alias("detail")),
        "person_source": stored["person_sources"].join(people, "person_id").join(titles, "source_id"),
        "person_media": stored["person_media"].join(people, "person_id").join(files, "media_id"),
        "event_source": stored["event_sources"].join(told, "event_id").join(titles, "source_id"),
        "event_media": stored["event_media"].join(told, "event_id").join(files, "media_id"),
        "document": stored["documents"].select(F.col("document").alias("key"), joined("admitted", "n_conflicts").alias("detail")),
        "conflict": stored["conflicts"].select(F.col("document").alias("key"), joined("table", "key", "reason").alias("detail")),
        "audit": reduce(DataFrame.unionByName, audited),
    }
    rows = [df.select(F.lit(kind).alias("kind"), "key", "detail") for kind, df in found.items()]
    return reduce(DataFrame.unionByName, rows)


@query("dashboard_of_stored")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard over stored tables, which know when they were imported."""
    ds = imports.dataset_from_tables(spark, _imported_nations(spark, sf_dir))
    return ds.dashboard().select("persons", "families", "events", "sources", F.col("last_import").isNotNull().alias("dated"))


@on_files("gedcom_links")
def _(parsed: DataFrame) -> DataFrame:
    return gedcom.links(gedcom.entities(parsed)).drop("seq")


@query("lookup_person")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup(fixtures.persons(spark, sf_dir), "xref", "I42")


@query("lookup_place")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lookup(dataset(spark, sf_dir).places, "place_key", "nation_7").select("place_key", "name")


# -------------------------------------------------------------- normalisation


def _date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fixtures.persons(spark, sf_dir).select(F.explode(F.array("birth_date", "death_date")).alias("date_text"))
    told = fixtures.life_events(spark, sf_dir).select("date_text")
    return stored.unionByName(told).where("date_text is not null").dropDuplicates()


@query("date_normalize")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _date_texts(spark, sf_dir).withColumn("d", dates.normalize_date(F.col("date_text")))
    return parsed.select("date_text", *[f"d.{c}" for c in ("qualifier", "year", "month", "day", "iso", "valid")])


def _parsed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _date_texts(spark, sf_dir).withColumn("d", dates.parse_date(F.col("date_text")))


@query("date_parse")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("year", "month", "day", "precision", "modifier", "iso", "start_iso", "end_iso")
    return _parsed_texts(spark, sf_dir).select("date_text", *[f"d.{c}" for c in fields])


@query("date_keys")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return _parsed_texts(spark, sf_dir).select(
        "date_text",
        dates.is_valid(d).alias("valid"),
        d["start_sort"].alias("start_sort"),
        d["end_sort"].alias("end_sort"),
        dates.is_exact(d).alias("is_exact"),
        dates.is_range(d).alias("is_range"),
        dates.as_date(d).cast("string").alias("calendar_date"),
    )


@on_dataset("date_from_iso")
def _(ds: Dataset) -> DataFrame:
    d = dates.date_from_iso(F.col("date_iso"), F.col("date_text"), F.col("date_year"))
    return ds.events.select("event_id", d.alias("d")).select(
        "event_id", *[f"d.{c}" for c in ("original", "iso", "year", "month", "day", "precision", "start_sort")]
    )


@on_dataset("date_compare")
def _(ds: Dataset) -> DataFrame:
    b, d = F.col("birth"), F.col("death")
    return ds.enriched.where(dates.is_valid(b) & dates.is_valid(d)).select(
        "person_id",
        dates.compare_dates(b, d).alias("order"),
        dates.same_date(b, d).alias("same"),
        dates.contains(b, d).alias("contains"),
        dates.overlaps(b, d).alias("overlaps"),
    )


@on_dataset("date_overlaps")
def _(ds: Dataset) -> DataFrame:
    births = ds.enriched.where("birth.year is not null").groupBy(
        F.col("birth.start_sort").alias("start_sort"), F.col("birth.end_sort").alias("end_sort")
    ).agg(F.count(F.lit(1)).alias("n"))
    return periods.period_matches(births)


@on_dataset("date_contains")
def _(ds: Dataset) -> DataFrame:
    births = ds.enriched.where("birth.year is not null").groupBy(
        F.col("birth.start_sort").alias("start_sort"), F.col("birth.end_sort").alias("end_sort")
    ).agg(F.count(F.lit(1)).alias("n"))
    return periods.period_matches(births, contained=True)


@query("name_normalize")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, surname = F.col("given"), F.col("surname")
    shown = fixtures.name_variants(spark, sf_dir).select(
        "owner_xref", "seq", text.title_given(given).alias("given_name"), text.title_surname(surname).alias("surname")
    )
    full = text.search_name(F.col("given_name"), F.col("surname"))
    return shown.select(
        "*", full.alias("search_name"), text.slug(full).alias("slug"), text.soundex(F.col("surname")).alias("soundex"),
        text.letters_key(full).alias("metaphone"),
    )


@query("fold_documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = fixtures.table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("t"))
    return folded.select("doc_id", F.md5("t").alias("folded_md5"), F.length("t").alias("n_chars"))


@query("slugs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = fixtures.persons(spark, sf_dir)
    given, surname = F.col("given_name"), F.col("surname")
    return people.select(
        "person_id",
        names.name_slug(given, surname).alias("name_slug"),
        places.place_slug(F.coalesce(surname, F.lit(""))).alias("place_slug"),
        text.slug(given, None).alias("entity_slug"),
    )


@query("document_slugs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text"), None).alias("slug"))


@query("person_name_columns")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, surname = F.col("given_name"), F.col("surname")
    prefix = F.when(F.col("sex") == "M", F.lit("Sr."))
    return fixtures.persons(spark, sf_dir).select(
        "person_id",
        names.full_name(given, surname, prefix=prefix).alias("full_name"),
        names.display_name(given, surname, F.col("xref")).alias("display_name"),
        names.initials(given, surname).alias("initials"),
    )


@query("soundex")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = search.token_index(fixtures.table(spark, sf_dir, "documents"), "doc_id", "text").select("token").dropDuplicates()
    return words.select("token", text.soundex(F.col("token")).alias("soundex"), text.letters_key(F.col("token")).alias("metaphone"))


@query("phonetic_key")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.persons(spark, sf_dir).select(
        "person_id", text.phonetic_key(F.coalesce("surname", "given_name")).alias("phonetic_key")
    )


@query("place_keys")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = fixtures.life_events(spark, sf_dir).select("place").dropDuplicates()
    name = F.col("place")
    return spelled.select(
        "place",
        text.place_key(name).alias("place_key"),
        places.place_canonical(name).alias("canonical"),
        _joined(places.place_tokens(name)).alias("tokens"),
    )


@query("name_keys")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.persons(spark, sf_dir).select(
        "person_id", text.name_key(F.col("surname")).alias("surname_key"), text.name_key(F.col("given_name")).alias("given_key")
    )


@on_dataset("presentation_labels")
def _(ds: Dataset) -> DataFrame:
    scores = ds.quality.select("person_id", "score")
    return ds.enriched.join(scores, "person_id").select(
        "person_id",
        labels.life_span(F.col("birth_year"), F.col("death_year")).alias("life_span"),
        labels.sex_label(F.col("sex")).alias("sex_label"),
        labels.quality_label(F.col("score")).alias("quality_label"),
        labels.percent(F.col("score")).alias("percent"),
    )


@on_dataset("event_labels")
def _(ds: Dataset) -> DataFrame:
    return ds.events.groupBy(labels.event_label(F.col("event_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- resolution


@on_files("person_rows")
def _(parsed: DataFrame) -> DataFrame:
    return resolve.person_rows(gedcom.persons(gedcom.entities(parsed))).drop("seq")


@query("place_dimension")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spellings = fixtures.life_events(spark, sf_dir).select("place", F.col("event_id").alias("seq"))
    stored = fixtures.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("place_id"), F.col("n_name").alias("name"))
    return resolve.place_dimension(spellings, stored).select("place_key", "name", "existing_id")


@query("source_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.source_map(fixtures.source_records(spark, sf_dir))


@query("media_rows")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.media_rows(fixtures.media_records(spark, sf_dir))


@on_dataset("family_parents")
def _(ds: Dataset) -> DataFrame:
    return ds.families.select("family_id", "xref", "father_id", "mother_id")


@on_dataset("parent_child_rows")
def _(ds: Dataset) -> DataFrame:
    return ds.parent_children


@on_dataset("event_rows")
def _(ds: Dataset) -> DataFrame:
    return ds.events.select("event_id", "person_id", "event_type", "date_text", "date_iso", "date_year", "place_key", "place")


@on_dataset("person_source_links")
def _(ds: Dataset) -> DataFrame:
    return ds.person_sources


@query("person_media_links")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = fixtures.persons(spark, sf_dir)
    media = resolve.media_rows(fixtures.media_records(spark, sf_dir))
    return resolve.link_rows(
        fixtures.person_links(spark, sf_dir),
        people.select(F.col("xref").alias("owner_xref"), F.col("person_id").alias("owner_id")),
        media.select(F.col("xref").alias("target"), F.col("xref").alias("target_id")),
        "OBJE",
    ).select(F.col("owner_id").alias("person_id"), F.col("target_id").alias("media_xref"))


@query("surrogate_keys")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = resolve.media_rows(fixtures.media_records(spark, sf_dir)).select("xref")
    numbered = keys.dense_ids(media, "media_id", F.col("xref"))
    return numbered.select("media_id", "xref", keys.public_uuid(F.lit("media"), F.col("xref")).alias("uuid"))


@query("import_summary")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = dataset(spark, sf_dir)
    return resolve.import_summary(
        {
            "persons": ds.persons,
            "families": ds.families,
            "sources": fixtures.source_records(spark, sf_dir),
            "media": ds.media,
            "places": ds.places,
            "events": ds.events,
            "children": ds.parent_children,
        }
    )


def _append(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every supplier's title arrives at a table that holds the registers of some regions."""
    records = fixtures.source_records(spark, sf_dir).select("seq", "title")
    stored = fixtures.table(spark, sf_dir, "nation").where("n_regionkey < 2").select(
        F.concat(F.lit("Register "), F.col("n_nationkey")).alias("title")
    )
    return resolve.append_new(stored, records, "title")


@query("incremental_append")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _append(spark, sf_dir)[0]


@query("append_conflicts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _append(spark, sf_dir)[1]


def _merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions in a scattered order; every seventh merges into one person, who is merged away in turn."""
    return fixtures.table(spark, sf_dir, "customer").selectExpr(
        "(c_custkey * 7919) % 1000003 as seq",
        "case when c_custkey % 7 = 0 then 10 else c_custkey + 1 end as primary_id",
        "case when c_custkey % 5 = 0 then c_custkey + 1 when c_custkey % 5 = 1 then c_custkey + 1000000 else c_custkey + 2 end as secondary_id",
    )


@query("merge_conflicts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.check_merges(_merge_decisions(spark, sf_dir), fixtures.persons(spark, sf_dir))


@query("apply_merges")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = fixtures.persons(spark, sf_dir)
    return resolve.apply_merges(people, resolve.check_merges(_merge_decisions(spark, sf_dir), people)).select("person_id", "xref")


# ----------------------------------------------------------------- enrichment


@on_dataset("derived_life_dates")
def _(ds: Dataset) -> DataFrame:
    return ds.enriched.select("person_id", "birth_date", "death_date")


@on_dataset("families_as_child")
def _(ds: Dataset) -> DataFrame:
    return enrich.child_edges(ds.parent_children)


@on_dataset("families_as_spouse")
def _(ds: Dataset) -> DataFrame:
    return enrich.spouse_edges(ds.families)


@on_dataset("children_of_parents")
def _(ds: Dataset) -> DataFrame:
    return enrich.parent_edges(ds.families, ds.parent_children)


@on_dataset("children_of_families")
def _(ds: Dataset) -> DataFrame:
    return enrich.family_children(ds.parent_children)


@on_dataset("person_events_with_places")
def _(ds: Dataset) -> DataFrame:
    return enrich.person_events(ds.events).select("event_id", "person_id", "event_type", "place")


@on_dataset("referenced_places")
def _(ds: Dataset) -> DataFrame:
    return enrich.referenced_places(ds.events)


@on_dataset("life_events")
def _(ds: Dataset) -> DataFrame:
    return enrich.event_summary(ds.events)


@on_dataset("events_by_person")
def _(ds: Dataset) -> DataFrame:
    nested = enrich.events_by_person(ds.events)
    shown = F.transform("events", lambda e: F.concat_ws(":", e["event_id"].cast("string"), e["event_type"]))
    return nested.select("person_id", _joined(shown).alias("events"))


# ------------------------------------------------------------------ integrity


def _checks(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    people = fixtures.persons(spark, sf_dir)
    fams = fixtures.family_records(spark, sf_dir)
    links = fixtures.person_links(spark, sf_dir)
    told = fixtures.life_events(spark, sf_dir).select(F.concat(F.lit("I"), "person_id").alias("owner_xref"), "date_text")
    written = people.select(F.col("xref").alias("owner_xref"), F.col("birth_date").alias("date_text"))
    return {
        "duplicate_xref": lambda: integrity.duplicate_xrefs(fixtures.record_xrefs(spark, sf_dir)),
        "missing_family_member": lambda: integrity.missing_family_members(fams, people),
        "missing_child": lambda: integrity.missing_children(fixtures.family_child_records(spark, sf_dir), people),
        "missing_family": lambda: integrity.missing_families(links, fams),
        "missing_source": lambda: integrity.missing_sources(links, fixtures.source_records(spark, sf_dir)),
        "missing_media": lambda: integrity.missing_media(links, fixtures.media_records(spark, sf_dir)),
        "missing_note": lambda: integrity.missing_notes(links, fixtures.note_records(spark, sf_dir)),
        "bad_date": lambda: integrity.bad_dates(told.unionByName(written)),
        "no_name": lambda: integrity.unnamed_persons(people, fixtures.name_variants(spark, sf_dir)),
    }


def _register_checks() -> None:
    codes = (
        "duplicate_xref", "missing_family_member", "missing_child", "missing_family", "missing_source",
        "missing_media", "missing_note", "bad_date", "no_name",
    )
    for code in codes:
        QUERIES[f"issues_{code}"] = lambda spark, sf_dir, code=code: _checks(spark, sf_dir)[code]()


_register_checks()


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = fixtures.persons(spark, sf_dir)
    told = fixtures.life_events(spark, sf_dir).select(F.concat(F.lit("I"), "person_id").alias("owner_xref"), "date_text")
    return integrity.all_issues(
        fixtures.record_xrefs(spark, sf_dir), people, fixtures.family_records(spark, sf_dir),
        fixtures.family_child_records(spark, sf_dir), fixtures.person_links(spark, sf_dir),
        fixtures.source_records(spark, sf_dir), fixtures.media_records(spark, sf_dir),
        fixtures.note_records(spark, sf_dir), told, fixtures.name_variants(spark, sf_dir),
    )


@query("issues_all")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("xref").alias("ids"))


# ----------------------------------------------------------------- statistics


def _import_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person events and one marriage event per family, as a file holds them."""
    own = fixtures.life_events(spark, sf_dir).select("person_id", F.lit(None).cast("bigint").alias("family_id"), "event_type", "date_text", "place")
    wed = fixtures.family_records(spark, sf_dir).selectExpr(
        "cast(null as bigint) as person_id", "family_id", "'marriage' as event_type",
        "cast(1800 + family_id % 150 as string) as date_text", "concat('Parish ', family_id % 11) as place",
    )
    return own.unionByName(wed)


@query("import_statistics")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.import_statistics(
        fixtures.persons(spark, sf_dir), fixtures.family_records(spark, sf_dir), _import_events(spark, sf_dir),
        fixtures.name_variants(spark, sf_dir), fixtures.person_links(spark, sf_dir),
        fixtures.source_records(spark, sf_dir), fixtures.media_records(spark, sf_dir), fixtures.note_records(spark, sf_dir),
    )


@query("unresolved_references")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.unresolved_references(
        fixtures.person_links(spark, sf_dir), fixtures.source_records(spark, sf_dir),
        fixtures.media_records(spark, sf_dir), fixtures.note_records(spark, sf_dir),
    )


@query("name_variant_surnames")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.surname_frequency(fixtures.name_variants(spark, sf_dir))


@query("import_events_by_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.events_by_type(_import_events(spark, sf_dir))


@query("distinct_places")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.distinct_places(_import_events(spark, sf_dir))


@query("import_birth_years")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.import_birth_years(_import_events(spark, sf_dir))


@query("life_event_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.life_event_counts(_import_events(spark, sf_dir))


@query("row_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = dataset(spark, sf_dir)
    return statistics.row_counts(
        {"Source": ds.sources, "Media": ds.media, "Person": ds.persons, "Family": ds.families, "Event": ds.events, "Place": ds.places}
    )


@on_dataset("totals")
def _(ds: Dataset) -> DataFrame:
    return statistics.totals(ds.persons, ds.families, enrich.person_events(ds.events), ds.sources, ds.media)


@on_dataset("sex_distribution")
def _(ds: Dataset) -> DataFrame:
    return statistics.sex_distribution(ds.persons)


@on_dataset("males_females")
def _(ds: Dataset) -> DataFrame:
    return statistics.males_females(ds.persons)


@on_dataset("surname_frequency")
def _(ds: Dataset) -> DataFrame:
    return statistics.surname_frequency(ds.persons)


@on_dataset("incomplete_persons")
def _(ds: Dataset) -> DataFrame:
    return statistics.incomplete_persons(ds.persons)


@on_dataset("age_at_death")
def _(ds: Dataset) -> DataFrame:
    return statistics.age_at_death(ds.enriched)


@on_dataset("births_by_year")
def _(ds: Dataset) -> DataFrame:
    return statistics.year_series(statistics.persons_by_year(ds.enriched, "birth"))


@on_dataset("deaths_by_year")
def _(ds: Dataset) -> DataFrame:
    return statistics.year_series(statistics.persons_by_year(ds.enriched, "death"))


@on_dataset("events_by_type")
def _(ds: Dataset) -> DataFrame:
    return statistics.events_by_type(enrich.person_events(ds.events))


@on_dataset("birth_year_range")
def _(ds: Dataset) -> DataFrame:
    return statistics.birth_year_range(ds.enriched, ds.events)


@on_dataset("top_places")
def _(ds: Dataset) -> DataFrame:
    return statistics.top_places(ds.events)


@on_dataset("top_surnames")
def _(ds: Dataset) -> DataFrame:
    return statistics.top_surnames(ds.persons)


@on_dataset("largest_branches")
def _(ds: Dataset) -> DataFrame:
    return statistics.largest_branches(ds.parent_children)


#: Persons that the statistics of the first persons look at; fewer than there are in all but the smallest folder.
FIRST_PERSONS = 700


@on_dataset("first_persons_statistics")
def _(ds: Dataset) -> DataFrame:
    first = statistics.first_persons(ds.enriched, FIRST_PERSONS)
    return statistics.one_row(
        first.agg(F.count(F.lit(1)).alias("persons")), statistics.males_females(first), statistics.age_at_death(first)
    )


@on_dataset("dashboard")
def _(ds: Dataset) -> DataFrame:
    return ds.dashboard()


# -------------------------------------------------------------------- quality


@on_dataset("quality_score")
def _(ds: Dataset) -> DataFrame:
    return ds.quality


@on_dataset("quality_partial_names_added")
def _(ds: Dataset) -> DataFrame:
    return quality.quality_scores(quality.quality_inputs(ds.enriched), penalise_partial_name=False)


@on_dataset("quality_by_citations")
def _(ds: Dataset) -> DataFrame:
    return quality.quality_scores(quality.quality_inputs(ds.enriched, "citations", ds.person_sources))


@on_dataset("quality_factors")
def _(ds: Dataset) -> DataFrame:
    return quality.factor_rows(quality.quality_details(quality.quality_inputs(ds.enriched)))


@on_dataset("quality_factor_chronology")
def _(ds: Dataset) -> DataFrame:
    return quality.factor(quality.quality_details(quality.quality_inputs(ds.enriched)), "chronology")


@on_dataset("quality_missing")
def _(ds: Dataset) -> DataFrame:
    details = quality.quality_details(quality.quality_inputs(ds.enriched))
    return details.select("person_id", _joined("missing").alias("missing"), _joined("issues").alias("issues"))


@on_dataset("quality_summary")
def _(ds: Dataset) -> DataFrame:
    return quality.quality_summary(ds.quality)


@on_dataset("quality_distribution")
def _(ds: Dataset) -> DataFrame:
    return quality.quality_distribution(ds.quality)


# ------------------------------------------------------------------- findings


@on_dataset("finding_impossible_dates")
def _(ds: Dataset) -> DataFrame:
    return findings.impossible_dates(ds.enriched)


@on_dataset("finding_missing_births")
def _(ds: Dataset) -> DataFrame:
    return findings.missing_births(ds.enriched)


@on_dataset("finding_missing_deaths")
def _(ds: Dataset) -> DataFrame:
    return findings.missing_deaths(ds.enriched)


@on_dataset("finding_chronology")
def _(ds: Dataset) -> DataFrame:
    return findings.broken_chronology(ds.enriched)


@on_dataset("finding_duplicates")
def _(ds: Dataset) -> DataFrame:
    return findings.possible_duplicates(ds.candidates).drop("metadata")


@on_dataset("finding_no_parents")
def _(ds: Dataset) -> DataFrame:
    return findings.without_parents(ds.enriched)


@on_dataset("finding_no_family")
def _(ds: Dataset) -> DataFrame:
    return findings.without_family(ds.enriched)


@on_dataset("finding_places")
def _(ds: Dataset) -> DataFrame:
    return findings.inconsistent_places(enrich.referenced_places(ds.events)).drop("metadata")


@on_dataset("finding_given_names")
def _(ds: Dataset) -> DataFrame:
    return findings.given_name_variants(ds.enriched).drop("metadata")


@on_dataset("findings_by_category")
def _(ds: Dataset) -> DataFrame:
    return ds.findings.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


@on_dataset("findings_by_severity")
def _(ds: Dataset) -> DataFrame:
    return findings.severity_totals(ds.findings)


@on_dataset("finding_errors")
def _(ds: Dataset) -> DataFrame:
    return findings.of_severity(ds.findings, "error").select("category", "message", "ref")


@on_dataset("finding_facets")
def _(ds: Dataset) -> DataFrame:
    return findings.facets(ds.findings, ds.candidates)


# ----------------------------------------------------------------- duplicates


def _pair_rows(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "a_id", "b_id", "score", "confidence", _joined("rules_used").alias("rules_used"), _joined("reasons").alias("reasons")
    )


@on_dataset("duplicate_candidates")
def _(ds: Dataset) -> DataFrame:
    return _pair_rows(ds.candidates)


@on_dataset("duplicate_rows")
def _(ds: Dataset) -> DataFrame:
    return ds.candidates.select("a_id", "a_xref", "a_name", "b_id", "b_xref", "b_name", "score")


@on_dataset("duplicate_rules_used")
def _(ds: Dataset) -> DataFrame:
    rows = ds.candidates.select(F.explode(F.arrays_zip("rules_used", "reasons")).alias("r"), "score")
    return rows.groupBy(F.col("r.rules_used").alias("rule")).agg(F.count(F.lit(1)).alias("pairs"), F.max("score").alias("best"))


@on_dataset("duplicate_top")
def _(ds: Dataset) -> DataFrame:
    return duplicates.top_candidates(ds.candidates, 100).select("a_id", "b_id", "score")


@on_dataset("duplicate_candidates_strict")
def _(ds: Dataset) -> DataFrame:
    settings = Settings(threshold=0.65, weights=(("name", 0.4), ("birth", 0.15)))
    return _pair_rows(duplicates.duplicate_candidates(ds.enriched, ds.families, ds.parent_children, settings))


@on_dataset("duplicate_candidates_with_place")
def _(ds: Dataset) -> DataFrame:
    settings = Settings(use_place=True)
    return _pair_rows(duplicates.duplicate_candidates(ds.enriched, ds.families, ds.parent_children, settings))


_SAME_SEX = CustomRule(
    name="sex",
    weight=0.1,
    score=lambda a, b: F.when(a["sex"] == b["sex"], F.lit(0.5)).otherwise(F.lit(0.0)),
    confidence=lambda a, b: F.lit(0.5),
    reason=lambda a, b: F.lit("mateix sexe"),
    inputs=("sex",),
    ceiling=0.5,
)


@on_dataset("duplicate_candidates_custom_rule")
def _(ds: Dataset) -> DataFrame:
    settings = Settings(custom=(_SAME_SEX,))
    return _pair_rows(duplicates.duplicate_candidates(ds.enriched, ds.families, ds.parent_children, settings))


@on_dataset("duplicates_of_person")
def _(ds: Dataset) -> DataFrame:
    person = search.lookup(ds.enriched, "xref", "I10").select("person_id")
    found = duplicates.duplicate_candidates(ds.enriched, ds.families, ds.parent_children, focus=person)
    return found.select("a_id", "b_id", "score")


@on_dataset("duplicate_groups")
def _(ds: Dataset) -> DataFrame:
    return duplicates.duplicate_groups(ds.persons)


@on_dataset("duplicate_groups_with_year")
def _(ds: Dataset) -> DataFrame:
    return duplicates.duplicate_groups(ds.persons, require_year=True)


@on_dataset("duplicate_groups_any_surname")
def _(ds: Dataset) -> DataFrame:
    return duplicates.duplicate_groups(ds.persons, match_on_surname=False)


@on_dataset("duplicate_group_members")
def _(ds: Dataset) -> DataFrame:
    return duplicates.group_members(ds.persons, require_year=True)


@on_dataset("quick_decisions")
def _(ds: Dataset) -> DataFrame:
    person = F.struct("given_name", "surname")
    a = ds.persons.select(F.col("person_id").alias("a_id"), person.alias("a"))
    b = ds.persons.select(F.col("person_id").alias("b_id"), (F.col("person_id") - 1).alias("a_id"), person.alias("b"))
    likely, message = duplicates.quick_decision("a", "b")
    return a.join(b, "a_id").select("a_id", "b_id", likely.alias("likely"), message.alias("message"))


@on_dataset("merge_candidates")
def _(ds: Dataset) -> DataFrame:
    pattern = "%ol%"
    matched = ds.persons.where(F.col("given_name").ilike(pattern) | F.col("surname").ilike(pattern))
    return duplicates.group_members(matched)


# ------------------------------------------------------------------- variants


@query("place_variants")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = variants.by_group_size(variants.place_variant_groups(fixtures.life_events(spark, sf_dir), "place"))
    return groups.select("canonical", _joined("variants").alias("variants"), "reason")


@query("place_variant_rows")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_rows(fixtures.life_events(spark, sf_dir), "place")


@on_dataset("name_variants")
def _(ds: Dataset) -> DataFrame:
    groups = variants.by_group_size(variants.name_variant_groups(ds.persons, "surname"))
    return groups.select("original", "normalized", _joined("alternatives").alias("alternatives"), "reason")


@query("variant_join")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = fixtures.life_events(spark, sf_dir).select("place").dropDuplicates()
    nation = fixtures.table(spark, sf_dir, "nation").select("n_name")
    return variants.variant_join(nation, spelled, "n_name", "place")


@query("known_variants")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of every person's given name; every second person has one of the common names in its place."""
    common = F.array(*[F.lit(x) for x in ("Jose", "JOSEP", "maría", "Joan", "Pablo", "Pere", "Anna")])
    at = (F.length(F.coalesce("given_name", F.lit(""))) + F.col("person_id")) % 7 + 1
    own = F.when(F.col("person_id") % 2 == 0, F.col("given_name")).otherwise(F.element_at(common, at.cast("int")))
    named = fixtures.persons(spark, sf_dir).select("person_id", own.alias("name"))
    return variants.known_variants(named, "name").select("person_id", "name", _joined("known_variants").alias("known_variants"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer place names: part words, nation and parish of every customer."""
    customer = fixtures.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = fixtures.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = fixtures.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("c_custkey") == F.col("p_partkey"))
        .selectExpr(
            """case when c_custkey % 3 = 0 then concat(p_name, ' de la ', n_name)
                    when c_custkey % 3 = 1 then concat(n_name, ' ', p_name, ' parish ', c_custkey % 5)
                    when c_custkey % 2 = 0 then p_name else upper(replace(p_name, ' ', '-')) end as name"""
        )
    )


@query("place_similarity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.place_similarity_join(_addresses(spark, sf_dir), 0.6)


@query("place_containment")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.place_containment_join(_addresses(spark, sf_dir))


@query("place_matches")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.place_match_join(_addresses(spark, sf_dir))


@on_dataset("name_similarity")
def _(ds: Dataset) -> DataFrame:
    full = ds.persons.select(names.full_name(F.col("given_name"), F.col("surname")).alias("name"))
    return variants.name_similarity_join(full, 0.6)


@query("word_similarity")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = search.token_index(fixtures.table(spark, sf_dir, "benchmark"), "item_id", "text").select("token")
    return variants.name_similarity_join(words, 0.8, "token")


# --------------------------------------------------------- search and details


@query("person_search")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_persons(fixtures.persons(spark, sf_dir), q="GE", sex="F", limit=50, offset=10).select("person_id", "given_name", "surname")


@on_dataset("person_search_catalog")
def _(ds: Dataset) -> DataFrame:
    return search.search_catalog(ds.enriched, ds.events, q="o", place="nation_1", sex="M", limit=100, offset=5)


@on_dataset("person_search_birth_year")
def _(ds: Dataset) -> DataFrame:
    found = search.search_catalog(ds.enriched, ds.events, surname="t", birth_year=1997, limit=100)
    return found.select("person_id", "display_name", "birth_year", "quality")


@on_dataset("person_summaries")
def _(ds: Dataset) -> DataFrame:
    return search.summaries(ds.enriched)


@on_dataset("person_parents")
def _(ds: Dataset) -> DataFrame:
    return relations.parents(ds.enriched, ds.families, ds.parent_children).select(
        "person_id", "family_id", "role", "parent_person_id", "parent_display_name", "parent_birth_year"
    )


@on_dataset("person_spouses")
def _(ds: Dataset) -> DataFrame:
    wed = ds.events.where("event_type = 'marriage'").withColumn("family_id", (F.floor((F.col("person_id") - 1) / 3) + 1).cast("bigint"))
    fams = resolve.with_marriage(ds.families, wed)
    return relations.spouses(ds.enriched, fams).select(
        "person_id", "family_id", "spouse_person_id", "spouse_display_name", "marriage_date", "marriage_place"
    )


@on_dataset("person_children")
def _(ds: Dataset) -> DataFrame:
    rows = relations.children(ds.enriched, ds.families, ds.parent_children)
    return rows.select("person_id", "child_person_id", "child_display_name", "child_birth_year")


@on_dataset("timeline")
def _(ds: Dataset) -> DataFrame:
    rows = relations.timeline(ds.events)
    return rows.select("person_id", "event_id", "event_type", "date_iso", "date_year", "place")


@on_dataset("person_sources")
def _(ds: Dataset) -> DataFrame:
    return relations.person_sources(ds.person_sources, ds.sources).select("person_id", "source_xref", "title", "author")


@on_dataset("person_detail")
def _(ds: Dataset) -> DataFrame:
    wanted = ds.enriched.select("person_id")
    rows = relations.person_details(
        ds.enriched, ds.families, ds.parent_children, ds.events, ds.person_sources, ds.sources, wanted
    )
    count = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    first_event = F.try_element_at("timeline", F.lit(1))
    return rows.select(
        "person_id",
        "display_name",
        count("parents").alias("parents"),
        count("spouses").alias("spouses"),
        count("children").alias("children"),
        count("timeline").alias("events"),
        count("duplicates").alias("duplicates"),
        count("tasks").alias("tasks"),
        count("sources").alias("sources"),
        F.col("quality_detail.score").alias("quality"),
        first_event["event_id"].alias("first_event"),
        _joined(F.transform("sources", lambda s: s["title"])).alias("titles"),
    )


@on_dataset("person_detail_content")
def _(ds: Dataset) -> DataFrame:
    """What the nested lists of a person's detail hold, one row per entry, in their order."""
    wanted = ds.enriched.select("person_id")
    rows = relations.person_details(
        ds.enriched, ds.families, ds.parent_children, ds.events, ds.person_sources, ds.sources, wanted
    )
    shown = {
        "parents": ("family_id", "role", "parent_person_id", "parent_display_name"),
        "spouses": ("family_id", "spouse_person_id", "spouse_display_name"),
        "children": ("child_person_id", "child_display_name", "child_birth_year"),
        "timeline": ("event_id", "event_type", "date_text", "place_key", "place"),
        "sources": ("title", "author"),
    }
    parts = []
    for name, fields in shown.items():
        entry = F.array_join(F.array(*[F.coalesce(F.col("e")[f].cast("string"), F.lit("")) for f in fields]), "|")
        parts.append(
            rows.select("person_id", F.posexplode(name).alias("at", "e")).select(
                "person_id", F.lit(name).alias("part"), "at", entry.alias("entry")
            )
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@on_dataset("family_list")
def _(ds: Dataset) -> DataFrame:
    shown = relations.list_families(ds.families, ds.enriched, limit=50, offset=20)
    return shown.select("family_id", "xref", "father_display_name", "mother_display_name")


def _kid_names(ds: Dataset, by_sibling_order: bool) -> DataFrame:
    rows = relations.family_details(ds.families, ds.enriched, ds.parent_children, ds.events, by_sibling_order)
    kids = F.transform("children", lambda c: c["child_xref"])
    return rows.select("family_id", "father_xref", "mother_xref", F.coalesce(_joined(kids), F.lit("")).alias("children"))


@on_dataset("family_detail")
def _(ds: Dataset) -> DataFrame:
    return _kid_names(ds, False)


@on_dataset("family_detail_by_sibling")
def _(ds: Dataset) -> DataFrame:
    return _kid_names(ds, True)


@query("family_detail_of_stored")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Couple, children and events of every family of the stored documents."""
    ds = imports.dataset_from_tables(spark, _imported_nations(spark, sf_dir))
    rows = relations.family_details(ds.families, ds.enriched, ds.parent_children, ds.events)
    told = F.transform("events", lambda e: F.concat_ws(":", e["event_type"], F.coalesce(e["date_text"], F.lit("")), F.coalesce(e["place"], F.lit(""))))
    kids = F.transform("children", lambda c: c["child_xref"])
    return rows.select(
        "xref", "father_xref", "mother_xref", F.coalesce(_joined(kids), F.lit("")).alias("children"),
        F.coalesce(_joined(told), F.lit("")).alias("events"),
    )


@on_dataset("place_list")
def _(ds: Dataset) -> DataFrame:
    return search.list_places(ds.places, q="Nation_1", limit=100, offset=2).select("name")


def _walk(ds: Dataset) -> tuple[DataFrame, DataFrame]:
    edges = ancestors.ancestor_edges(ds.families, ds.parent_children)
    return ancestors.ancestors(ds.persons.select("person_id"), edges, ancestors.MAX_DEPTH), edges


@on_dataset("ancestors")
def _(ds: Dataset) -> DataFrame:
    return _walk(ds)[0]


@on_dataset("ancestor_trees")
def _(ds: Dataset) -> DataFrame:
    found, edges = _walk(ds)
    nodes = ancestors.tree_nodes(found, edges, ancestors.MAX_DEPTH)
    return ancestors.tree_rows(nodes, ds.persons, ds.events).select(
        "root_id", "child_id", "parent_id", "depth", "xref", "birth_year", "death_year"
    )


@on_dataset("ancestor_counts")
def _(ds: Dataset) -> DataFrame:
    found, edges = _walk(ds)
    return ancestors.tree_sizes(found, edges, ancestors.MAX_DEPTH)


@on_dataset("fulltext_persons")
def _(ds: Dataset) -> DataFrame:
    index = search.token_index(ds.persons, "person_id", "given_name", "surname")
    return search.search_index(index, "person_id", "BLUE  Bolt", None)


@query("fulltext_documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.token_index(fixtures.table(spark, sf_dir, "documents"), "doc_id", "text")
    return search.search_index(index, "doc_id", "the and with", None)


@query("token_frequencies")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.token_index(fixtures.table(spark, sf_dir, "documents"), "doc_id", "text")
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


# ---------------------------------------------------------------------- tasks


@on_dataset("person_tasks")
def _(ds: Dataset) -> DataFrame:
    return tasks.person_tasks(ds.enriched).select("person_id", "xref", "objective", "kind", "hypothesis")


@on_dataset("duplicate_tasks")
def _(ds: Dataset) -> DataFrame:
    rows = tasks.duplicate_tasks(ds.candidates)
    return rows.select("person_id", "objective", "hypothesis", _joined(F.col("related_person_ids").cast("array<string>")).alias("related"))


@on_dataset("research_tasks")
def _(ds: Dataset) -> DataFrame:
    return tasks.first_tasks(ds.tasks).select("person_id", "objective", "kind", "status", "priority")


@on_dataset("task_records")
def _(ds: Dataset) -> DataFrame:
    return tasks.task_records(ds.tasks).groupBy("objective", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("person_id").alias("persons")
    )


@on_dataset("task_kinds")
def _(ds: Dataset) -> DataFrame:
    return tasks.task_kinds(ds.tasks)


@on_dataset("task_filter")
def _(ds: Dataset) -> DataFrame:
    return tasks.filter_tasks(ds.tasks, status="open", priority="low", kind="parents", text=" I12").select("person_id", "xref", "kind")


@on_dataset("tasks_per_kind")
def _(ds: Dataset) -> DataFrame:
    return tasks.first_per_kind(ds.tasks).select("kind", "rank", "person_id", "objective")


@on_dataset("tasks_of_persons")
def _(ds: Dataset) -> DataFrame:
    wanted = ds.enriched.select("person_id")
    return tasks.tasks_of(ds.tasks, wanted).select("person_id", "objective", "kind", "priority")


# ---------------------------------------------------------------------- sinks


@on_dataset("findings_json")
def _(ds: Dataset) -> DataFrame:
    parsed = writers.findings_json(ds.findings).select(
        "severity", F.from_json("json", "category string, severity string, message string, ref string, metadata string").alias("j")
    )
    return parsed.groupBy("severity", F.col("j.category").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("j.message")).alias("chars")
    )


@on_dataset("findings_markdown")
def _(ds: Dataset) -> DataFrame:
    return writers.markdown_lines(ds.findings).select("section", "line")


@query("import_report")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = dataset(spark, sf_dir)
    counts = QUERIES["import_summary"](spark, sf_dir)
    issues = _issues(spark, sf_dir)
    wanted = {"persons": fixtures.persons(spark, sf_dir).count(), "families": fixtures.family_records(spark, sf_dir).count()}
    lines = writers.import_report_lines(
        counts, issues, statistics.events_by_type(ds.events), statistics.top_surnames(ds.persons), wanted
    )
    return lines.select("section", "line")
