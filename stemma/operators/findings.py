"""Data-quality findings ``(category, severity, message, ref, metadata)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.text import has_text
from stemma.operators.variants import name_variant_groups, place_variant_groups

# Years outside this range are impossible.
FIRST_YEAR, LAST_YEAR = 1500, 2100

# Fixed value: a birth text with such a year makes a person historic.
HISTORIC_YEAR = r"\b1[5-8]\d{2}\b"

# Categories in report order.
CATEGORIES = ("date", "completeness", "chronology", "duplicate", "relationships", "place", "name")
SEVERITIES = ("error", "warning", "info")


def _finding(df: DataFrame, category: str, severity: str, message: Column, ref: Column, metadata: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        ref.alias("ref"),
        (F.lit("{}") if metadata is None else F.to_json(metadata, {"ignoreNullFields": "false"})).alias("metadata"),
    )


def impossible_dates(persons: DataFrame) -> DataFrame:
    """Birth and death texts without a year, or with one outside the possible range."""
    both = persons.select(
        "xref",
        F.explode(
            F.array(
                F.struct(F.lit("naixement").alias("label"), F.col("birth_date").alias("raw"), F.col("birth.year").alias("year")),
                F.struct(F.lit("defunció").alias("label"), F.col("death_date").alias("raw"), F.col("death.year").alias("year")),
            )
        ).alias("d"),
    ).select("xref", "d.*")
    wrong = F.col("year").isNull() | ~F.col("year").between(FIRST_YEAR, LAST_YEAR)
    message = F.concat(F.lit("data de "), F.col("label"), F.lit(" impossible: '"), F.col("raw"), F.lit("'"))
    return _finding(
        both.where(has_text(F.col("raw")) & wrong), "date", "warning", message, F.col("xref"), F.struct("year")
    )


def missing_births(persons: DataFrame) -> DataFrame:
    lost = persons.where(~has_text(F.col("birth_date")))
    return _finding(lost, "completeness", "warning", F.lit("persona sense naixement"), F.col("xref"))


def missing_deaths(persons: DataFrame) -> DataFrame:
    """Persons of known sex without a death who are not historic."""
    historic = F.coalesce(F.col("birth_date").rlike(HISTORIC_YEAR), F.lit(False))
    lost = persons.where(~has_text(F.col("death_date")) & has_text(F.col("sex")) & ~historic)
    return _finding(lost, "completeness", "info", F.lit("persona sense defunció"), F.col("xref"))


def broken_chronology(persons: DataFrame) -> DataFrame:
    """Death year before birth year."""
    dated = has_text(F.col("birth_date")) & has_text(F.col("death_date"))
    wrong = persons.where(dated & (F.col("death.year") < F.col("birth.year")))
    message = F.concat(
        F.lit("defunció ("), F.col("death.year"), F.lit(") abans de naixement ("), F.col("birth.year"), F.lit(")")
    )
    return _finding(wrong, "chronology", "error", message, F.col("xref"))


def possible_duplicates(candidates: DataFrame) -> DataFrame:
    first = F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("noms similars"))
    side = lambda x: F.coalesce(F.nullif(f"{x}_xref", F.lit("")), F.col(f"{x}_id").cast("string"))
    return _finding(
        candidates,
        "duplicate",
        "warning",
        F.concat(F.lit("possible duplicat ("), first, F.lit(")")),
        F.concat(side("a"), F.lit(" / "), side("b")),
        F.struct("score"),
    )


def without_parents(persons: DataFrame) -> DataFrame:
    lost = persons.where(~F.col("has_parents"))
    return _finding(lost, "relationships", "warning", F.lit("persona sense pares"), F.col("xref"))


def without_family(persons: DataFrame) -> DataFrame:
    lost = persons.where(~F.col("has_family"))
    return _finding(lost, "relationships", "info", F.lit("persona sense família pròpia"), F.col("xref"))


def inconsistent_places(places: DataFrame) -> DataFrame:
    groups = place_variant_groups(places, "name")
    message = F.concat(F.lit("topònims inconsistents: "), F.array_join("variants", ", "))
    return _finding(groups, "place", "warning", message, F.col("canonical"), F.struct("variants"))


def given_name_variants(persons: DataFrame) -> DataFrame:
    groups = name_variant_groups(persons, "given_name")
    message = F.concat(F.lit("variants de nom: "), F.array_join("alternatives", ", "))
    return _finding(groups, "name", "info", message, F.col("original"), F.struct("alternatives"))


def all_findings(persons: DataFrame, candidates: DataFrame, places: DataFrame) -> DataFrame:
    """The whole report as one table."""
    return reduce(
        DataFrame.unionByName,
        [
            impossible_dates(persons),
            missing_births(persons),
            missing_deaths(persons),
            broken_chronology(persons),
            possible_duplicates(candidates),
            without_parents(persons),
            without_family(persons),
            inconsistent_places(places),
            given_name_variants(persons),
        ],
    )


def severity_totals(findings: DataFrame) -> DataFrame:
    """One row: total, errors, warnings, infos."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(
        F.count(F.lit(1)).alias("total"),
        count("error").alias("errors"),
        count("warning").alias("warnings"),
        count("info").alias("infos"),
    )


def of_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(F.col("severity") == severity)


def facets(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(tab, n)`` counts of the report tabs."""
    category, severity = F.col("category"), F.col("severity")
    soft = severity.isin("warning", "info")
    counted = findings.agg(
        F.count_if(severity == "error").alias("errors"),
        F.count_if(severity == "warning").alias("warnings"),
        F.count_if(severity == "info").alias("infos"),
        F.count_if(soft & (category == "completeness")).alias("incomplete"),
        F.count_if(soft & category.isin("place", "toponym")).alias("places"),
    )
    tabs = "stack(5, 'errors', errors, 'warnings', warnings, 'infos', infos, 'incomplete', incomplete, 'places', places)"
    pairs = candidates.agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicates").alias("tab"), "n")
    return counted.selectExpr(f"{tabs} as (tab, n)").unionByName(pairs)
