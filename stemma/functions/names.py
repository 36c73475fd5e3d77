"""Person-name columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.numeric import exact_round
from stemma.functions.text import blank_to_null, dashed, fold, remove_accents, strip

# Fixed value: similarity granted when only the phonetic keys agree.
PHONETIC_SIMILARITY = 0.55


def full_name(
    given: Column,
    surname: Column,
    prefix: Column | None = None,
    middle: Column | None = None,
    suffix: Column | None = None,
) -> Column:
    """Prefix, given, middle, surname and suffix, joined by single spaces."""
    parts = [p for p in (prefix, given, middle, surname, suffix) if p is not None]
    return strip(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))


def display_name(given: Column, surname: Column, xref: Column) -> Column:
    """Given name and surname, or the record id when both are missing."""
    name = F.concat_ws(" ", blank_to_null(given), blank_to_null(surname))
    return F.coalesce(blank_to_null(name), xref, F.lit(""))


def initials(given: Column, surname: Column, middle: Column | None = None) -> Column:
    """First letters of the name parts, such as ``J. M.``."""
    parts = [given, surname] if middle is None else [given, middle, surname]
    letters = F.transform(F.array(*parts), lambda p: F.upper(F.substring(p, 1, 1)))
    lettered = F.filter(letters, lambda c: c.rlike("^\\p{L}"))
    return F.array_join(F.transform(lettered, lambda c: F.concat(c, F.lit("."))), " ")


def name_slug(given: Column, surname: Column) -> Column:
    """Slug of the full name; empty when there is no name."""
    return F.coalesce(dashed(F.lower(remove_accents(full_name(given, surname)))), F.lit(""))


def folded_name(given: Column, surname: Column) -> Column:
    """Folded full name."""
    return fold(full_name(given, surname))


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.lit(1.0) - F.levenshtein(a, b) / longest


def name_similarity(a_fold: Column, b_fold: Column, a_key: Column, b_key: Column) -> Column:
    """Similarity (0..1, two decimals) of two folded names with phonetic keys."""
    return exact_round(raw_similarity(a_fold, b_fold, a_key, b_key), 2)


def raw_similarity(a_fold: Column, b_fold: Column, a_key: Column, b_key: Column) -> Column:
    """The same before it is rounded."""
    either = F.greatest(
        edit_similarity(a_fold, b_fold),
        F.when(a_key == b_key, F.lit(PHONETIC_SIMILARITY)).otherwise(F.lit(0.0)),
    )
    return (
        F.when(~_present(a_fold) | ~_present(b_fold), F.lit(0.0))
        .when(a_fold == b_fold, F.lit(1.0))
        .otherwise(either)
    )


def _present(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))
