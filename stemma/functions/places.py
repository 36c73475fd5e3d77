"""Place-name columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.numeric import exact_round
from stemma.functions.text import SPACES, blank_to_null, dashed, fold

# Words left out of place tokens.
STOPWORDS = ("la", "el", "els", "les", "de", "del", "dels", "l", "san", "santa", "st")


def place_tokens(name: Column) -> Column:
    """Significant words of a place, in order."""
    words = F.split(fold(name), SPACES)
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))


def place_canonical(name: Column) -> Column:
    """Folded name with spaces as dashes."""
    return F.replace(fold(name), F.lit(" "), F.lit("-"))


def place_slug(name: Column) -> Column:
    """Slug of the folded name; empty when nothing is left."""
    return dashed(fold(name))


def place_display(name: Column, display: Column) -> Column:
    """Stored name, else its display form."""
    return F.coalesce(blank_to_null(name), blank_to_null(display))


def token_jaccard(shared: Column, size_a: Column, size_b: Column) -> Column:
    """Jaccard index (two decimals) from the sizes of two token sets."""
    return exact_round(shared / (size_a + size_b - shared), 2)
