"""Genealogical dates as Column expressions.

Two flavours exist side by side. The *import* flavour keeps the last year of
an interval and fills ``date_iso``/``date_year`` of events. The *analytic*
flavour yields a struct with both ends of an interval and a precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.functions.numeric import let
from stemma.functions.text import strip

# Month abbreviations, January first.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")

# Qualifier words of the import flavour.
IMPORT_QUALIFIERS = {
    "ABT": "about",
    "ABOUT": "about",
    "BEF": "before",
    "BEFORE": "before",
    "AFT": "after",
    "AFTER": "after",
    "BET": "between",
    "BETWEEN": "between",
    "FROM": "from",
    "TO": "to",
    "EST": "estimated",
    "CIR": "estimated",
}

# Modifier words of the analytic flavour.
MODIFIERS = {
    "ABT": "about",
    "ABOUT": "about",
    "AFT": "after",
    "AFTER": "after",
    "BEF": "before",
    "BEFORE": "before",
    "BET": "between",
    "BETWEEN": "between",
    "FROM": "from",
    "TO": "to",
    "EST": "estimated",
    "CAL": "calculated",
    "INT": "interpreted",
    "PHRASE": "interpreted",
}

# Precision levels.
UNKNOWN, YEAR, MONTH, DAY = 0, 1, 2, 3

# Reasons given for a date the import flavour cannot read.
NO_VALUE, EMPTY_DATE, BAD_FORMAT = "sense valor", "data buida", "format_de_data_no_reconegut"

DATE_STRUCT = (
    "struct<original:string,iso:string,year:int,month:int,day:int,precision:int,"
    "modifier:string,start_iso:string,end_iso:string,start_sort:bigint,end_sort:bigint>"
)

_MONTH_WORDS = "|".join(MONTHS)
_YEAR_DIGITS = "0*[1-9]\\d{3,8}"
_DAY_DIGITS = "0*(?:[1-9]|[12]\\d|3[01])"
_SLASHED_DAY = "\\d{1,2}[./-]\\d{1,2}[./-]?\\d{4}"
_SLASHED = "(?:\\d{1,2}[./-])?\\d{1,2}[./-]\\d{4}|" + _SLASHED_DAY


def _spaced(text: Column) -> Column:
    """Upper-case tokens separated and enclosed by single spaces."""
    tokens = strip(F.regexp_replace(F.upper(text), "(?U)[\\s\\x1c-\\x1f,]+", " "))
    return F.concat(F.lit(" "), tokens, F.lit(" "))


def _last_token(spaced: Column, pattern: str) -> Column:
    """The last token that matches ``pattern``, quotes and dots around it dropped."""
    found = F.regexp_extract(spaced, f"^.* [.']*({pattern})[.']* (?:.*)$", 1)
    return F.nullif(found, F.lit(""))


def _last_month_token(spaced: Column) -> Column:
    """The last month word, or the last complete day/month/year token."""
    pattern = f"^.* (?:({_MONTH_WORDS})|[.']*({_SLASHED_DAY})[.']*) (?:.*)$"
    groups = [F.nullif(F.regexp_extract(spaced, pattern, g), F.lit("")) for g in (1, 2)]
    return F.coalesce(*groups)


def _iso(year: Column, month: Column, day: Column) -> Column:
    """``YYYY-MM-DD`` with 01 for an unknown month or day."""
    two = lambda part: F.lpad(F.greatest(F.coalesce(part, F.lit(1)), F.lit(1)).cast("string"), 2, "0")
    digits = year.cast("string")
    padded = F.when(year < 1000, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat_ws("-", padded, two(month), two(day))


def _month_number(word: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word)
    return F.nullif(position.cast("int"), F.lit(0))


def _import_struct(spaced: Column) -> Column:
    """Year, month, day of the import flavour from spaced tokens."""
    return F.struct(
        _last_token(spaced, _YEAR_DIGITS).cast("int").alias("year"),
        _month_number(F.nullif(F.regexp_extract(spaced, f"^.* ({_MONTH_WORDS}) ", 1), F.lit(""))).alias("month"),
        _last_token(spaced, _DAY_DIGITS).cast("int").alias("day"),
    )


def normalize_date(text: Column) -> Column:
    """Import flavour: struct of qualifier, year, month, day, iso, valid and reason."""
    original = strip(text)

    def build(spaced: Column) -> Column:
        first_word = F.regexp_extract(spaced, f" ({'|'.join(IMPORT_QUALIFIERS)}) ", 1)
        table = F.create_map(*[F.lit(x) for pair in IMPORT_QUALIFIERS.items() for x in pair])
        qualifier = F.coalesce(F.try_element_at(table, first_word), F.lit("exact"))
        return let(
            _import_struct(spaced),
            lambda p: F.struct(
                qualifier.alias("qualifier"),
                p["year"].alias("year"),
                p["month"].alias("month"),
                p["day"].alias("day"),
                F.when(p["year"].isNotNull(), _iso(p["year"], p["month"], p["day"])).alias("iso"),
                p["year"].isNotNull().alias("valid"),
                F.when(text.isNull(), F.lit(NO_VALUE))
                .when(original == "", F.lit(EMPTY_DATE))
                .when(p["year"].isNull(), F.lit(BAD_FORMAT))
                .otherwise(F.lit(""))
                .alias("reason"),
            ),
        )

    return let(_spaced(F.coalesce(original, F.lit(""))), build)


def _components(spaced: Column) -> Column:
    """Year, month, day of the analytic flavour; all NULL without a year.

    A complete ``day/month/year`` token sets all three parts, so the last
    token that speaks of a part decides it.
    """

    def build(t: Column) -> Column:
        year = F.regexp_extract(t["y"], "(\\d+)$", 1)
        year = F.when(t["y"].rlike("[./-]"), F.substring(t["y"], -4, 4)).otherwise(year)
        month_slash = F.regexp_extract(t["m"], "^\\d{1,2}[./-](\\d{1,2})", 1)
        month = F.coalesce(_month_number(t["m"]), F.nullif(month_slash, F.lit("")).cast("int"))
        day = F.regexp_extract(t["d"], "^(\\d+)", 1)
        return F.when(
            t["y"].isNotNull(),
            F.struct(
                year.cast("int").alias("year"),
                F.when(t["m"].isNotNull(), month).alias("month"),
                F.when(t["d"].isNotNull(), day.cast("int")).alias("day"),
            ),
        )

    return let(
        F.struct(
            _last_token(spaced, f"{_YEAR_DIGITS}|{_SLASHED}").alias("y"),
            _last_month_token(spaced).alias("m"),
            _last_token(spaced, f"{_DAY_DIGITS}|{_SLASHED_DAY}").alias("d"),
        ),
        build,
    )


def _sort_key(year: Column, month: Column, day: Column) -> Column:
    one = F.lit(1)
    filled = lambda part: F.greatest(F.coalesce(part, one), one).cast("long")
    key = year.cast("long") * 10000 + filled(month) * 100 + filled(day)
    return F.coalesce(key, F.lit(0).cast("long"))


def _precision(year: Column, month: Column, day: Column) -> Column:
    has_month, has_day = F.coalesce(month > 0, F.lit(False)), F.coalesce(day > 0, F.lit(False))
    return (
        F.when(year.isNull(), F.lit(UNKNOWN))
        .when(has_month & has_day, F.lit(DAY))
        .when(has_month, F.lit(MONTH))
        .otherwise(F.lit(YEAR))
    )


_INTERVAL = "^ (?:BET|BETWEEN|FROM)((?: (?!AND |TO )\\S+)*) (?:AND|TO) (.+) $"


def parse_date(text: Column) -> Column:
    """Analytic flavour: the date struct with sort keys of both ends."""
    original = strip(text)

    def build(spaced: Column) -> Column:
        is_iso = original.rlike("^\\d{4}-\\d{2}-\\d{2}$")
        is_interval = spaced.rlike("^(?: \\S+){4,} $") & spaced.rlike(_INTERVAL)
        first_word = F.regexp_extract(spaced, "^ (\\S+) ", 1)
        table = F.create_map(*[F.lit(x) for pair in MODIFIERS.items() for x in pair])
        modifier = F.coalesce(F.try_element_at(table, first_word), F.lit("exact"))
        start_text = F.when(
            is_interval, F.concat(F.regexp_extract(spaced, _INTERVAL, 1), F.lit(" "))
        ).otherwise(spaced)
        end_text = F.when(
            is_interval, F.concat(F.lit(" "), F.regexp_extract(spaced, _INTERVAL, 2), F.lit(" "))
        )
        iso_parts = F.struct(
            F.substring(original, 1, 4).cast("int").alias("year"),
            F.substring(original, 6, 2).cast("int").alias("month"),
            F.substring(original, 9, 2).cast("int").alias("day"),
        )
        gathered = F.struct(
            is_iso.alias("is_iso"),
            (is_interval & ~is_iso).alias("is_interval"),
            F.when(is_iso, F.lit("exact")).otherwise(modifier).alias("modifier"),
            F.when(is_iso, iso_parts).otherwise(_components(start_text)).alias("a"),
            F.when(~is_iso, _components(end_text)).alias("b"),
        )
        return let(gathered, finish)

    def finish(g: Column) -> Column:
        a, b = g["a"], g["b"]
        precision = F.when(g["is_iso"], F.lit(DAY)).otherwise(
            _precision(a["year"], a["month"], a["day"])
        )
        start_iso = (
            F.when(g["is_iso"], original)
            .when(a["year"].isNull(), F.lit(None))
            .when(g["is_interval"] | (precision == DAY), _iso(a["year"], a["month"], a["day"]))
        )
        end_iso = F.when(
            g["is_interval"],
            F.when(b["year"].isNotNull(), _iso(b["year"], b["month"], b["day"])),
        ).otherwise(start_iso)
        start_sort = _sort_key(a["year"], a["month"], a["day"])
        end_sort = F.when(
            g["is_interval"] & b["year"].isNotNull(), _sort_key(b["year"], b["month"], b["day"])
        ).otherwise(start_sort)
        return F.struct(
            original.alias("original"),
            start_iso.alias("iso"),
            a["year"].alias("year"),
            a["month"].alias("month"),
            a["day"].alias("day"),
            precision.alias("precision"),
            g["modifier"].alias("modifier"),
            start_iso.alias("start_iso"),
            end_iso.alias("end_iso"),
            start_sort.alias("start_sort"),
            end_sort.alias("end_sort"),
        )

    unknown = F.struct(
        *[F.lit(None).cast("string").alias(n) for n in ("original", "iso")],
        *[F.lit(None).cast("int").alias(n) for n in ("year", "month", "day")],
        F.lit(UNKNOWN).alias("precision"),
        F.lit("exact").alias("modifier"),
        *[F.lit(None).cast("string").alias(n) for n in ("start_iso", "end_iso")],
        *[F.lit(0).cast("long").alias(n) for n in ("start_sort", "end_sort")],
    ).cast(DATE_STRUCT)
    parsed = let(_spaced(original), build).cast(DATE_STRUCT)
    return F.when(F.coalesce(original != "", F.lit(False)), parsed).otherwise(unknown)


def date_from_iso(iso: Column, date_text: Column | None = None, date_year: Column | None = None) -> Column:
    """Date struct of a stored ISO text, falling back to the text and year of its event."""
    digits = lambda part: F.when(part.rlike("^\\d+$"), part.cast("int"))
    year = digits(F.substring(iso, 1, 4))
    month = F.when(year.isNotNull() & (F.length(iso) >= 7), digits(F.substring(iso, 6, 2)))
    day = F.when(year.isNotNull() & (F.length(iso) >= 10), digits(F.substring(iso, 9, 2)))
    precision = F.when(year.isNull(), F.lit(UNKNOWN)).otherwise(
        F.when(F.coalesce(day > 0, F.lit(False)), F.lit(DAY))
        .when(F.coalesce(month > 0, F.lit(False)), F.lit(MONTH))
        .otherwise(F.lit(YEAR))
    )
    stored = F.when(precision == DAY, iso)
    sort = _sort_key(year, month, day)
    filled = F.coalesce(F.nullif(date_text, F.lit("")), iso) if date_text is not None else iso
    from_iso = F.struct(
        filled.alias("original"),
        stored.alias("iso"),
        year.alias("year"),
        month.alias("month"),
        day.alias("day"),
        precision.alias("precision"),
        F.lit("exact").alias("modifier"),
        stored.alias("start_iso"),
        stored.alias("end_iso"),
        sort.alias("start_sort"),
        sort.alias("end_sort"),
    ).cast(DATE_STRUCT)
    text_only = date_text if date_text is not None else F.lit(None).cast("string")
    year_only = date_year if date_year is not None else F.lit(None).cast("int")
    null_text, null_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    year_sort = _sort_key(year_only, null_int, null_int)
    fallback = F.struct(
        text_only, null_text, year_only, null_int, null_int, F.lit(UNKNOWN), F.lit("exact"),
        null_text, null_text, year_sort, year_sort,
    ).cast(DATE_STRUCT)
    return F.when(F.coalesce(iso != "", F.lit(False)), from_iso).otherwise(fallback)


def is_valid(d: Column) -> Column:
    """A year or an ISO text is known."""
    return d["year"].isNotNull() | d["iso"].isNotNull()


def is_exact(d: Column) -> Column:
    """Unmodified and precise to the day."""
    return (d["modifier"] == "exact") & (d["precision"] == DAY)


def is_range(d: Column) -> Column:
    """An interval whose end is known."""
    return d["modifier"].isin("between", "from") & d["end_iso"].isNotNull()


def as_date(d: Column) -> Column:
    """Calendar date of the start; NULL when the day does not exist."""
    built = F.concat_ws(
        "-",
        F.lpad(d["year"].cast("string"), 4, "0"),
        F.lpad(F.greatest(F.coalesce(d["month"], F.lit(1)), F.lit(1)).cast("string"), 2, "0"),
        F.lpad(F.greatest(F.coalesce(d["day"], F.lit(1)), F.lit(1)).cast("string"), 2, "0"),
    )
    return F.coalesce(F.try_to_date(d["iso"], "yyyy-MM-dd"), F.when(d["year"].isNotNull(), F.try_to_date(built, "yyyy-MM-dd")))


def compare_dates(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by start."""
    return F.signum(a["start_sort"] - b["start_sort"]).cast("int")


def same_date(a: Column, b: Column) -> Column:
    """Equality on ISO text, year, precision and modifier."""
    key = lambda d: F.struct(d["iso"], d["year"], d["precision"], d["modifier"])
    return key(a).eqNullSafe(key(b))


def contains(a: Column, b: Column) -> Column:
    """``b`` lies within ``a``."""
    return (a["start_sort"] <= b["start_sort"]) & (b["end_sort"] <= a["end_sort"])


def overlaps(a: Column, b: Column) -> Column:
    """The two periods share a moment."""
    return (a["start_sort"] <= b["end_sort"]) & (b["start_sort"] <= a["end_sort"])
