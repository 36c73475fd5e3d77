"""Presentation columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels shown for sex codes.
SEX_LABELS = {"M": "Home", "F": "Dona", "U": "Desconegut"}

# Labels shown for event types.
EVENT_LABELS = {
    "birth": "Naixement",
    "christening": "Bateig",
    "baptism": "Baptisme",
    "death": "Defunció",
    "burial": "Enterrament",
    "marriage": "Matrimoni",
    "divorce": "Divorci",
    "census": "Padró",
    "residence": "Residència",
    "occupation": "Ocupació",
    "immigration": "Immigració",
    "emigration": "Emigració",
}

# Lower bounds and labels of the quality classes.
QUALITY_LABELS = ((0.8, "Excel·lent"), (0.6, "Bona"), (0.4, "Regular"))
LOWEST_QUALITY_LABEL = "Baixa"

DASH = "—"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(labels, key)


def life_span(birth: Column, death: Column) -> Column:
    """``1880 – 1950`` with a question mark for an unknown end."""
    unknown = F.lit("?")
    return F.concat(
        F.coalesce(birth.cast("string"), unknown), F.lit(" – "), F.coalesce(death.cast("string"), unknown)
    )


def percent(value: Column) -> Column:
    """Whole percent, half up, or a dash."""
    whole = F.floor(value * 100 + 0.5).cast("string")
    return F.coalesce(F.concat(whole, F.lit("%")), F.lit(DASH))


def sex_label(sex: Column) -> Column:
    """Label of a sex code; unlisted codes stay as they are."""
    code = F.nullif(sex, F.lit(""))
    return F.coalesce(_lookup(F.coalesce(code, F.lit("U")), SEX_LABELS), code)


def event_label(event_type: Column) -> Column:
    """Label of an event type; unlisted types lose their first underscore."""
    kind = F.nullif(event_type, F.lit(""))
    spaced = F.regexp_replace(kind, "^([^_]*)_", "$1 ")
    found = _lookup(F.coalesce(kind, F.lit("")), EVENT_LABELS)
    return F.coalesce(found, spaced, F.lit("Esdeveniment"))


def quality_label(score: Column) -> Column:
    """Class label of a quality score."""
    label = F.when(score.isNull(), F.lit(DASH))
    for bound, text in QUALITY_LABELS:
        label = label.when(score >= bound, F.lit(text))
    return label.otherwise(F.lit(LOWEST_QUALITY_LABEL))
