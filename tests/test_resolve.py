import re

from pyspark.sql import functions as F

from stemma.operators import resolve
from stemma.sources import gedcom

EVENT = "event_id long, person_id long, family_id long, event_type string, date_text string, place string"


def events(spark):
    rows = [
        (1, 1, None, "BIRTH", "3 MAR 1890", "Vic ,"), (2, 1, None, "death", None, "VIC"), (3, 2, None, "birth", "3 MAR 1890", None),
        (3, 2, None, "birth", "3 MAR 1890", None), (4, None, 7, "marriage", "soon", " "), (5, 3, None, "birth", "ABT 1900", "Olot"),
    ]
    return spark.createDataFrame(rows, EVENT)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_places_are_keyed_after_they_are_counted_down(spark):
    found = resolve.place_dimension(events(spark).select("place", F.col("event_id").alias("seq")))
    assert sorted((r.place_key, r.name, r.first_seq) for r in found.collect()) == [("olot", "Olot", 5), ("vic", "Vic ,", 1)]
    nodes = re.split(r"\n[ :]*[+:]- ", optimized(found))
    assert any("regexp_replace" in n for n in nodes) and not any(n.startswith("Filter") and "regexp_replace" in n for n in nodes)


def test_dates_and_places_are_read_once_per_text(spark):
    places = spark.createDataFrame([("vic", "Vic"), ("olot", "Olot")], "place_key string, name string")
    found = resolve.event_rows(events(spark), places)
    rows = [tuple(r) for r in found.orderBy("event_id").collect()]
    assert rows == [
        (1, 1, None, "birth", "3 MAR 1890", "1890-03-03", 1890, "vic", "Vic"),
        (2, 1, None, "death", None, None, None, "vic", "Vic"),
        (3, 2, None, "birth", "3 MAR 1890", "1890-03-03", 1890, None, None),
        (3, 2, None, "birth", "3 MAR 1890", "1890-03-03", 1890, None, None),
        (4, None, 7, "marriage", "soon", None, None, None, None),
        (5, 3, None, "birth", "ABT 1900", "1900-01-01", 1900, "olot", "Olot"),
    ]
    assert "regexp" not in optimized(found)


def test_lines_know_the_tag_above_and_carry_no_other_lines(spark):
    text = "0 HEAD\n1 CHAR UTF-8\n0 @I1@ INDI\n1 NAME A\n2 GIVN B\n1 BIRT\n2 DATE 1890"
    whole = spark.createDataFrame([("a", text)], "path string, text string")
    lines = gedcom.line_table(gedcom.parse_records(gedcom.records_from_text(whole)))
    above = [(r.tag, r.parent_line, r.parent_tag) for r in lines.orderBy("line_no").collect()]
    assert above == [
        ("HEAD", None, None), ("CHAR", 1, "HEAD"), ("INDI", None, None), ("NAME", 3, "INDI"), ("GIVN", 4, "NAME"),
        ("BIRT", 3, "INDI"), ("DATE", 6, "BIRT"),
    ]
