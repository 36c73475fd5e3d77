"""Referential and value checks over parsed records.

Every check yields ``(level, code, xref, message)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.dates import normalize_date
from stemma.functions.text import has_text, strip


def _quoted(text: Column) -> Column:
    """The text in single quotes, in double quotes when it holds a single quote."""
    inner = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    double = F.contains(inner, F.lit("'")) & ~F.contains(inner, F.lit('"'))
    single = F.replace(inner, F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), single, F.lit("'"))
    )


def _issue(df: DataFrame, level: str, code: str, xref: Column, message: Column) -> DataFrame:
    return df.select(
        F.lit(level).alias("level"), F.lit(code).alias("code"), xref.alias("xref"), message.alias("message")
    )


def duplicate_xrefs(records: DataFrame) -> DataFrame:
    """One issue per repeat of a record id after its first occurrence.

    ``records`` holds ``(xref, seq)`` of persons and families. Only repeated
    ids go through the join, so the big side keeps its layout.
    """
    repeated = records.groupBy("xref").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
    later = records.join(repeated.where("n > 1"), "xref").where("seq <> first_seq")
    message = F.concat(F.lit("xref "), _quoted(F.col("xref")), F.lit(" repetit al document"))
    return _issue(later, "error", "duplicate_xref", F.col("xref"), message)


def missing_family_members(families: DataFrame, persons: DataFrame) -> DataFrame:
    """Husbands and wives that point to no person."""
    roles = families.selectExpr(
        "xref", "stack(2, 'HUSB', husband_xref, 'WIFE', wife_xref) as (role, target)"
    ).where(has_text(F.col("target")))
    known = persons.select(F.col("xref").alias("target"))
    message = F.concat(
        F.lit("La familia "), _quoted(F.col("xref")), F.lit(" apunta a la persona inexistent "),
        _quoted(F.col("target")), F.lit(" com a "), F.col("role"),
    )
    return _issue(
        roles.join(known, "target", "left_anti"), "error", "missing_family_member", F.col("xref"), message
    )


def missing_children(children: DataFrame, persons: DataFrame) -> DataFrame:
    """Children that point to no person."""
    known = persons.select(F.col("xref").alias("child_xref"))
    message = F.concat(
        F.lit("El fill "), _quoted(F.col("child_xref")), F.lit(" de "), _quoted(F.col("family_xref")),
        F.lit(" no està definit"),
    )
    lost = children.join(known, "child_xref", "left_anti")
    return _issue(lost, "error", "missing_child", F.col("family_xref"), message)


def _lost_links(links: DataFrame, tags: tuple[str, ...], known: DataFrame) -> DataFrame:
    targets = known.select(F.col("xref").alias("target"))
    return links.where(F.col("tag").isin(*tags)).join(targets, "target", "left_anti")


def missing_families(links: DataFrame, families: DataFrame) -> DataFrame:
    """Family pointers of persons that lead nowhere."""
    message = F.concat(
        F.lit("La persona "), _quoted(F.col("owner_xref")), F.lit(" referencia la família inexistent "),
        _quoted(F.col("target")),
    )
    lost = _lost_links(links, ("FAMC", "FAMS"), families)
    return _issue(lost, "error", "missing_family", F.col("owner_xref"), message)


def missing_sources(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Source pointers of persons that lead nowhere."""
    message = F.concat(F.lit("La font "), _quoted(F.col("target")), F.lit(" no està definida"))
    return _issue(_lost_links(links, ("SOUR",), sources), "warning", "missing_source", F.col("owner_xref"), message)


def missing_media(links: DataFrame, media: DataFrame) -> DataFrame:
    """Media pointers of persons that lead nowhere."""
    message = F.concat(F.lit("L'OBJE "), _quoted(F.col("target")), F.lit(" no està definit"))
    return _issue(_lost_links(links, ("OBJE",), media), "warning", "missing_media", F.col("owner_xref"), message)


def missing_notes(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Note pointers of persons that lead nowhere."""
    message = F.concat(F.lit("La nota "), _quoted(F.col("target")), F.lit(" no està definida"))
    return _issue(_lost_links(links, ("NOTE",), notes), "warning", "missing_note", F.col("owner_xref"), message)


def bad_dates(events: DataFrame) -> DataFrame:
    """Person events whose date text the import flavour cannot read.

    ``events`` holds ``(owner_xref, date_text)`` of person records.
    """
    unread = events.where(
        F.col("date_text").isNotNull()
        & (strip(F.col("date_text")) != "")
        & ~normalize_date(F.col("date_text"))["valid"]
    )
    message = F.concat(F.lit("Data no reconeguda: "), _quoted(F.col("date_text")))
    return _issue(unread, "warning", "bad_date", F.col("owner_xref"), message)


def unnamed_persons(persons: DataFrame, names: DataFrame) -> DataFrame:
    """Persons none of whose name variants has a given name or a surname."""
    usable = names.where(has_text(F.col("given")) | has_text(F.col("surname"))).select(
        F.col("owner_xref").alias("xref")
    )
    lost = persons.select("xref").join(usable, "xref", "left_anti")
    return _issue(lost, "warning", "no_name", F.col("xref"), F.lit("Persona sense nom"))


def all_issues(
    record_xrefs: DataFrame,
    persons: DataFrame,
    families: DataFrame,
    children: DataFrame,
    links: DataFrame,
    sources: DataFrame,
    media: DataFrame,
    notes: DataFrame,
    events: DataFrame,
    names: DataFrame,
) -> DataFrame:
    """All checks in one issue table."""
    return reduce(
        DataFrame.unionByName,
        [
            duplicate_xrefs(record_xrefs),
            missing_family_members(families, persons),
            missing_children(children, persons),
            missing_families(links, families),
            missing_sources(links, sources),
            missing_media(links, media),
            missing_notes(links, notes),
            bad_dates(events),
            unnamed_persons(persons, names),
        ],
    )
