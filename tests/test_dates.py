import pytest
from pyspark.sql import functions as F

from stemma.functions import dates
from stemma.operators.periods import period_matches

IMPORT = [
    ("10 FEB 1890", "exact", "1890-02-10", True),
    ("BET 1800 AND 1820", "between", "1820-01-01", True),
    ("CAL 1500", "exact", "1500-01-01", True),
    ("ABT 1890", "about", "1890-01-01", True),
    ("BEF 1900", "before", "1900-01-01", True),
    ("AFT JAN 1890", "after", "1890-01-01", True),
    ("FEB, 1890", "exact", "1890-02-01", True),
    ("1893-04-20", "exact", None, False),
    ("12/10/1880", "exact", None, False),
    ("12 JAN. 1880", "exact", "1880-01-12", True),
    ("unknown", "exact", None, False),
    ("", "exact", None, False),
    (None, "exact", None, False),
]

ANALYTIC = [
    # text, year, precision, modifier, iso, start_sort, end_sort
    ("BET 1880 AND 1900", 1880, 1, "between", "1880-01-01", 18800101, 19000101),
    ("FROM JAN 1880 TO 3 MAR 1881", 1880, 2, "from", "1880-01-01", 18800101, 18810303),
    ("1893-04-20", 1893, 3, "exact", "1893-04-20", 18930420, 18930420),
    ("12/10/1880", 1880, 3, "exact", "1880-10-12", 18801012, 18801012),
    ("12.10.1880", 1880, 3, "exact", "1880-10-12", 18801012, 18801012),
    ("10/1880", 1880, 1, "exact", None, 18800101, 18800101),
    ("ABT 1880", 1880, 1, "about", None, 18800101, 18800101),
    ("CAL 1880", 1880, 1, "calculated", None, 18800101, 18800101),
    ("31 FEB 1900", 1900, 3, "exact", "1900-02-31", 19000231, 19000231),
    ("BET 1880 AND", 1880, 1, "between", None, 18800101, 18800101),
    ("BET AND 1880 1890", None, 0, "between", None, 0, 18900101),
    ("unknown", None, 0, "exact", None, 0, 0),
    ("", None, 0, "exact", None, 0, 0),
    (None, None, 0, "exact", None, 0, 0),
]


def test_import_flavour(spark):
    df = spark.createDataFrame([(t,) for t, *_ in IMPORT], "t string")
    rows = df.select("t", dates.normalize_date(F.col("t")).alias("d")).select("t", "d.*").collect()
    got = [(r.t, r.qualifier, r.iso, r.valid) for r in rows]
    assert got == IMPORT


def test_analytic_flavour(spark):
    df = spark.createDataFrame([(t,) for t, *_ in ANALYTIC], "t string")
    rows = df.select("t", dates.parse_date(F.col("t")).alias("d")).select("t", "d.*").collect()
    got = [(r.t, r.year, r.precision, r.modifier, r.iso, r.start_sort, r.end_sort) for r in rows]
    assert got == ANALYTIC


def test_impossible_day_has_no_calendar_date(spark):
    df = spark.createDataFrame([("31 FEB 1900",), ("28 FEB 1900",), ("1900",)], "t string")
    got = df.select(dates.as_date(dates.parse_date(F.col("t"))).cast("string").alias("d")).collect()
    assert [r.d for r in got] == [None, "1900-02-28", "1900-01-01"]


def test_relations_between_dates(spark):
    df = spark.createDataFrame([("BET 1880 AND 1900", "1890"), ("1890", "1891"), ("1890", "1890")], "a string, b string")
    parsed = df.select(dates.parse_date(F.col("a")).alias("a"), dates.parse_date(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    rows = parsed.select(
        dates.contains(a, b).alias("c"), dates.overlaps(a, b).alias("o"), dates.compare_dates(a, b).alias("k"),
        dates.same_date(a, b).alias("s"), dates.is_range(a).alias("r"),
    ).collect()
    assert [tuple(r) for r in rows] == [(True, True, -1, False, True), (False, False, -1, False, False), (True, True, 0, True, False)]


def test_date_from_stored_iso(spark):
    df = spark.createDataFrame([("1890-02-10", "x", 1890), ("1890-02", None, None), (None, "ABT 1880", 1880)], "i string, t string, y int")
    d = dates.date_from_iso(F.col("i"), F.col("t"), F.col("y"))
    rows = df.select(d.alias("d")).select("d.original", "d.iso", "d.year", "d.precision").collect()
    assert [tuple(r) for r in rows] == [("x", "1890-02-10", 1890, 3), ("1890-02", None, 1890, 2), ("ABT 1880", None, 1880, 0)]


@pytest.mark.parametrize("contained", [False, True])
def test_period_matches_equal_all_pairs(spark, contained):
    import random

    rng = random.Random(5)
    periods = set()
    while len(periods) < 150:
        start = rng.randrange(1500, 2000)
        length = rng.choice([0, 0, 0, 1, 3, 40, 400, 900000])
        periods.add((start * 10000 + 101, (start + length) * 10000 + 101))
    rows = [(a, b, rng.randrange(1, 5)) for a, b in sorted(periods)]
    got = period_matches(spark.createDataFrame(rows, "start_sort long, end_sort long, n long"), contained).collect()
    expected = {}
    for a, b, _ in rows:
        hits = [n for c, d, n in rows if ((a <= c and d <= b) if contained else (a <= d and c <= b))]
        expected[(a, b)] = sum(hits)
    assert {(r.start_sort, r.end_sort): r.matches for r in got} == expected
