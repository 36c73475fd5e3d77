"""The conformed tables of one data set and what is derived from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import enrich, resolve, statistics
from stemma.operators.duplicates import duplicate_candidates
from stemma.operators.findings import all_findings
from stemma.operators.quality import quality_inputs, quality_scores, quality_summary
from stemma.operators.tasks import all_tasks
from stemma.plans import fixtures
from stemma.session import cut_lineage


@dataclass
class Dataset:
    """Conformed tables. What several jobs share is written once and read by all of them."""

    persons: DataFrame
    families: DataFrame
    parent_children: DataFrame
    events: DataFrame
    places: DataFrame
    sources: DataFrame | None = None
    person_sources: DataFrame | None = None
    media: DataFrame | None = None

    @cached_property
    def enriched(self) -> DataFrame:
        """Persons with derived dates, life events and link flags."""
        return cut_lineage(enrich.enrich_persons(self.persons, self.families, self.parent_children, self.events))

    @cached_property
    def candidates(self) -> DataFrame:
        """Duplicate pairs under the default settings; read from the pairs the search wrote, so that no job reads more than it uses."""
        return duplicate_candidates(self.enriched, self.families, self.parent_children)

    @cached_property
    def quality(self) -> DataFrame:
        """Quality score of every person."""
        return quality_scores(quality_inputs(self.enriched))

    @cached_property
    def findings(self) -> DataFrame:
        """The findings report."""
        return all_findings(self.enriched, self.candidates, enrich.referenced_places(self.events))

    @cached_property
    def tasks(self) -> DataFrame:
        """Research tasks of all persons and pairs."""
        return all_tasks(self.enriched, self.candidates)

    def dashboard(self) -> DataFrame:
        """One row of headline numbers."""
        count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        parts = [
            count(self.enriched, "persons"),
            count(self.families, "families"),
            count(enrich.person_events(self.events), "events"),
            count(enrich.referenced_places(self.events), "places"),
            statistics.males_females(self.enriched),
            statistics.age_at_death(self.enriched).select("average_age"),
            quality_summary(self.quality).select(F.col("average_score").alias("average_quality")),
            count(self.candidates, "duplicates"),
            count(self.tasks, "pending_tasks"),
        ]
        if self.sources is not None:
            parts.append(count(self.sources, "sources"))
        if self.media is not None:
            parts.append(count(self.media, "media"))
        if "created_at" in self.persons.columns:
            parts.append(self.persons.agg(F.max("created_at").alias("last_import")))
        return statistics.one_row(*parts)


class _Derived(Dataset):
    """Places and events of a data folder are made when a job first asks for them; many jobs read neither."""

    def __init__(self, life: DataFrame, **tables: DataFrame | None):
        self.life = life
        self.__dict__.update(tables)

    # Joined once, as places and events go over it several times.
    @cached_property
    def told(self) -> DataFrame:
        return cut_lineage(self.life)

    # Few rows out of one narrow pass over what is written already.
    @cached_property
    def places(self) -> DataFrame:
        return resolve.place_dimension(self.told.select("place", F.col("event_id").alias("seq")))

    # Written once, as some twenty jobs read the events.
    @cached_property
    def events(self) -> DataFrame:
        return cut_lineage(resolve.event_rows(self.told.withColumn("family_id", F.lit(None).cast("bigint")), self.places))


def from_fixtures(spark: SparkSession, sf_dir: str) -> Dataset:
    """Conformed tables over the derived genealogy of a data folder."""
    persons = fixtures.persons(spark, sf_dir)
    families = resolve.family_rows(fixtures.family_records(spark, sf_dir), persons).select(
        "*", F.lit(None).cast("string").alias("marriage_date"), F.lit(None).cast("string").alias("marriage_place")
    )
    children = resolve.parent_child_rows(fixtures.family_child_records(spark, sf_dir), persons, families)
    mapping = resolve.source_map(fixtures.source_records(spark, sf_dir))
    bridge = resolve.link_rows(
        fixtures.person_links(spark, sf_dir),
        persons.select(F.col("xref").alias("owner_xref"), F.col("person_id").alias("owner_id")),
        mapping.select(F.col("xref").alias("target"), F.col("source_xref").alias("target_id")),
        "SOUR",
    ).select(F.col("owner_id").alias("person_id"), F.col("target_id").alias("source_xref"))
    return _Derived(
        fixtures.life_events(spark, sf_dir), persons=persons, families=families, parent_children=children,
        sources=resolve.source_rows(mapping), person_sources=bridge, media=resolve.media_rows(fixtures.media_records(spark, sf_dir)),
    )
