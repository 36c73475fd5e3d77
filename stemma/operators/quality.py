"""Explainable quality scores per person."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.numeric import exact_round
from stemma.functions.text import has_text

# Contribution of each factor.
GIVEN, SURNAME = 0.15, 0.1
NAME_WEIGHT = 0.25
SEX, PARENTS, CHILDREN, SOURCES, EVENTS, PLACES = 0.05, 0.15, 0.15, 0.15, 0.1, 0.05
BIRTH, DEATH, CHRONOLOGY = 0.1, 0.05, 0.2

# Names and lower bounds of the quality classes, in hundredths.
CLASSES = (("excellent", 80), ("good", 60), ("regular", 40), ("low", 0))

# Reasons given with a factor.
REASONS = {
    "name_full": "nom complet present",
    "name_part": "nom incomplet",
    "sex": "sexe registrat",
    "parents": "pares identificats",
    "children": "fills identificats",
    "sources": "fonts citades",
    "events": " esdeveniments",
    "places": " llocs",
    "birth": "naixement datat",
    "no_birth": "sense naixement datat",
    "death": "defunció datada",
    "no_death": "sense defunció datada",
    "chronology": "defunció abans de naixement",
    "chronology_flag": "error cronològic",
    "chronology_issue": "error cronològic (mort abans de naixement)",
}


def quality_inputs(persons: DataFrame, source_signal: str = "events", citations: DataFrame | None = None) -> DataFrame:
    """Add ``has_sources`` and ``place_count`` to enriched persons.

    By default a person counts as sourced when it has any event;
    ``source_signal="citations"`` asks for a row in ``citations`` instead.
    """
    place_count = has_text(F.col("birth_date")).cast("int").alias("place_count")
    if source_signal == "events":
        return persons.select("*", (F.col("event_count") > 0).alias("has_sources"), place_count)
    if source_signal != "citations" or citations is None:
        raise ValueError("source_signal is 'events', or 'citations' with a citations table")
    cited = citations.select("person_id").dropDuplicates().withColumn("_cited", F.lit(True))
    joined = persons.join(cited, "person_id", "left")
    return joined.select("*", F.coalesce("_cited", F.lit(False)).alias("has_sources"), place_count).drop("_cited")


def _chronology_broken() -> Column:
    dated = has_text(F.col("birth_date")) & has_text(F.col("death_date"))
    return dated & F.coalesce(F.col("death.year") < F.col("birth.year"), F.lit(False))


def _factors(penalise_partial_name: bool, flag: Column | None) -> list[tuple]:
    """``(name, condition, contribution, weight, reason, sign)`` of every factor, in order."""
    given, surname = has_text(F.col("given_name")), has_text(F.col("surname"))
    part = F.when(given, F.lit(GIVEN)).otherwise(F.lit(0.0)) + F.when(surname, F.lit(SURNAME)).otherwise(F.lit(0.0))
    birth, death = has_text(F.col("birth_date")), has_text(F.col("death_date"))
    counted = lambda column, unit: F.concat(F.col(column).cast("string"), F.lit(REASONS[unit]))
    text = {k: F.lit(v) for k, v in REASONS.items()}
    flagged = F.lit(False) if flag is None else flag
    return [
        ("name", given & surname, F.lit(GIVEN + SURNAME), NAME_WEIGHT, text["name_full"], 1),
        ("name", ~(given & surname), part, NAME_WEIGHT, text["name_part"], -1 if penalise_partial_name else 1),
        ("sex", has_text(F.col("sex")), F.lit(SEX), SEX, text["sex"], 1),
        ("parents", F.col("has_parents"), F.lit(PARENTS), PARENTS, text["parents"], 1),
        ("children", F.col("has_children"), F.lit(CHILDREN), CHILDREN, text["children"], 1),
        ("sources", F.col("has_sources"), F.lit(SOURCES), SOURCES, text["sources"], 1),
        ("events", F.col("event_count") > 0, F.lit(EVENTS), EVENTS, counted("event_count", "events"), 1),
        ("places", F.col("place_count") > 0, F.lit(PLACES), PLACES, counted("place_count", "places"), 1),
        ("birth", birth, F.lit(BIRTH), BIRTH, text["birth"], 1),
        ("birth", ~birth, F.lit(0.0), BIRTH, text["no_birth"], 1),
        ("death", death, F.lit(DEATH), DEATH, text["death"], 1),
        ("death", ~death, F.lit(0.0), DEATH, text["no_death"], 1),
        ("chronology", flagged, F.lit(CHRONOLOGY), CHRONOLOGY, text["chronology_flag"], -1),
        ("chronology", ~flagged & _chronology_broken(), F.lit(CHRONOLOGY), CHRONOLOGY, text["chronology"], -1),
    ]


def _score(factors: list[tuple]) -> Column:
    signed = [F.when(c, v * sign).otherwise(F.lit(0.0)) for _, c, v, _, _, sign in factors]
    total = reduce(lambda a, b: a + b, signed, F.lit(0.0))
    return exact_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2)


def quality_scores(
    inputs: DataFrame, penalise_partial_name: bool = True, chronology_flag: Column | None = None
) -> DataFrame:
    """Quality score per person; a narrow projection over :func:`quality_inputs`.

    An incomplete name subtracts the part that is there; ask for
    ``penalise_partial_name=False`` to add it instead.
    """
    factors = _factors(penalise_partial_name, chronology_flag)
    return inputs.select("person_id", "xref", _score(factors).alias("score"))


def quality_details(
    inputs: DataFrame, penalise_partial_name: bool = True, chronology_flag: Column | None = None
) -> DataFrame:
    """Score, factors, missing attributes and issues per person."""
    factors = _factors(penalise_partial_name, chronology_flag)
    rows = F.array_compact(
        F.array(
            *[
                F.when(
                    c,
                    F.struct(
                        F.lit(name).alias("name"),
                        v.alias("contribution"),
                        F.lit(weight).alias("weight"),
                        reason.alias("reason"),
                        F.lit("add" if sign > 0 else "subtract").alias("direction"),
                    ),
                )
                for name, c, v, weight, reason, sign in factors
            ]
        )
    )
    wanted = [
        ("given_name", has_text(F.col("given_name"))),
        ("surname", has_text(F.col("surname"))),
        ("sex", has_text(F.col("sex"))),
        ("parents", F.col("has_parents")),
        ("children", F.col("has_children")),
        ("sources", F.col("has_sources")),
        ("events", F.col("event_count") > 0),
        ("places", F.col("place_count") > 0),
    ]
    missing = F.array_compact(F.array(*[F.when(~there, F.lit(name)) for name, there in wanted]))
    found = F.concat(
        F.lit("mort ("), F.col("death.year"), F.lit(") abans de naixement ("), F.col("birth.year"), F.lit(")")
    )
    flagged = F.lit(False) if chronology_flag is None else chronology_flag
    issue = F.when(flagged, F.lit(REASONS["chronology_issue"])).when(_chronology_broken(), found)
    return inputs.select(
        "person_id",
        "xref",
        _score(factors).alias("score"),
        missing.alias("missing"),
        rows.alias("factors"),
        F.array_compact(F.array(issue)).alias("issues"),
    )


def factor_rows(details: DataFrame) -> DataFrame:
    """One row per person and factor."""
    return details.select("person_id", F.explode("factors").alias("f")).select("person_id", "f.*")


def factor(details: DataFrame, name: str) -> DataFrame:
    """A single factor of every person that has it."""
    return factor_rows(details).where(F.col("name") == name)


def _hundredths(score: Column) -> Column:
    return F.round(score * 100).cast("bigint")


def quality_summary(scores: DataFrame) -> DataFrame:
    """Average score (two decimals) and the best person, the lowest id winning a tie."""
    best = F.max_by(
        F.struct("person_id", "xref", "score"), F.struct(_hundredths(F.col("score")), -F.col("person_id"))
    )
    mean = F.sum(_hundredths(F.col("score"))) / (F.count(F.lit(1)) * 100)
    return scores.agg(
        F.coalesce(exact_round(mean, 2), F.lit(0.0)).alias("average_score"), best.alias("best")
    ).select("average_score", *[F.col(f"best.{c}").alias(f"best_{c}") for c in ("person_id", "xref", "score")])


def quality_distribution(scores: DataFrame) -> DataFrame:
    """Persons per quality class, empty classes included."""
    points = _hundredths(F.col("score"))
    bounds = [above for _, above in CLASSES]
    ceilings = [None, *bounds[:-1]]
    counts = [
        F.count_if((points >= low) if top is None else (points >= low) & (points < top)).alias(name)
        for (name, low), top in zip(CLASSES, ceilings)
    ]
    columns = ", ".join(f"'{name}', {name}" for name, _ in CLASSES)
    return scores.agg(*counts).selectExpr(f"stack({len(CLASSES)}, {columns}) as (class, n)")
