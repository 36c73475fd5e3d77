import pytest
from pyspark.sql import functions as F

from stemma.sources import gedcom

SAMPLE = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Joan /Garcia/ Jr
2 GIVN Joan Pere
1 NAME Pep /x
1 SEX M
1 BIRT
2 DATE 10 FEB 1890
2 PLAC Barcelona
2 SOUR @S1@
2 NOTE nota
1 DEAT
2 DATE 1950
1 NOTE dins
2 CONT mes
1 NOTE @N1@
1 SOUR @S1@
1 FAMS @F1@
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 CHIL @I3@
1 CHIL @I4@
1 MARR
2 DATE 1920
0 @S1@ SOUR
1 TITL Registre
2 CONC  parroquial
1 AUTH Bisbat
0 @O1@ OBJE
1 FILE foto.jpg
1 TITL Foto
0 @N1@ NOTE Primera linia
1 CONC i segona
1 CONC  amb espai
1 CONT tercera linia
0 TRLR"""


def parse(spark, text):
    df = spark.createDataFrame([("f", text)], "path string, text string")
    return gedcom.parse_records(gedcom.records_from_text(df))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_entities(spark):
    roots = gedcom.entities(parse(spark, SAMPLE))
    assert rows(gedcom.persons(roots).drop("seq")) == [("I1", "M", "Joan Pere", "Garcia", "Jr", "dins\nmes")]
    assert rows(gedcom.person_names(roots).select("given", "surname", "suffix")) == [("Joan Pere", "Garcia", "Jr"), ("Pep", "", "x")]
    assert rows(gedcom.families(roots).drop("seq")) == [("F1", "I1", "I2")]
    assert rows(gedcom.family_children(roots).drop("seq")) == [("F1", "I3", 1), ("F1", "I4", 2)]
    events = gedcom.events(roots)
    assert rows(events.drop("seq")) == [
        ("I1", "person", "birth", "10 FEB 1890", "Barcelona", ["nota"]),
        ("I1", "person", "death", "1950", None, []),
        ("F1", "family", "marriage", "1920", None, []),
    ]
    assert rows(gedcom.first_events(events, "birth")) == [("person", "I1", "10 FEB 1890", "Barcelona")]
    assert rows(gedcom.sources(roots).drop("seq")) == [("S1", "Registre parroquial", "Bisbat", "", "")]
    assert rows(gedcom.media(roots).drop("seq")) == [("O1", "foto.jpg", "Foto")]
    assert rows(gedcom.notes(roots).drop("seq")) == [("N1", "Primera liniai segona amb espai\ntercera linia")]
    assert rows(gedcom.note_texts(roots)) == [("I1", 1, "dins\nmes")]
    assert rows(gedcom.links(roots).select("tag", "target")) == [("NOTE", "N1"), ("SOUR", "S1"), ("FAMS", "F1")]
    assert rows(gedcom.event_links(roots)) == [("I1", 1, "SOUR", "S1")]


def test_hierarchy_of_irregular_levels(spark):
    text = "0 HEAD\n2 DATE a\n1 BIRT\n3 PLAC b\n2 DATE c\n2 NOTE d\n3 CONT e\n1 DEAT\n0 TRLR"
    got = gedcom.line_table(parse(spark, text)).orderBy("line_no").collect()
    levels = [int(line[0]) for line in text.split("\n")]
    expected = []
    for i, level in enumerate(levels):
        above = [j for j in range(i) if levels[j] < level]
        expected.append(above[-1] + 1 if above else None)
    assert [r.parent_line for r in got] == expected


def test_malformed_lines(spark):
    parsed = parse(spark, "0 HEAD\nX bad\n1\n\n0 @I9@\n0 TRLR")
    bad = gedcom.rejected_lines(parsed).orderBy("line_no").select("line_no", "reason")
    assert rows(bad) == [(2, "nivell no numèric"), (3, "falta el tag"), (5, "punter sense tag")]
    with pytest.raises(gedcom.GedcomError, match="Línia 2"):
        gedcom.fail_on_rejected(parsed)
    gedcom.fail_on_rejected(parse(spark, SAMPLE))


def test_file_without_head_line(spark, tmp_path):
    (tmp_path / "a.ged").write_text("HEAD\n0 @I1@ INDI\n")
    bad = gedcom.rejected_lines(gedcom.parse_records(gedcom.read_records(spark, str(tmp_path))))
    assert rows(bad.select("line_no", "reason")) == [(1, "nivell no numèric")]


def test_files_split_anywhere_give_the_same_lines(spark, tmp_path):
    """BOM, CRLF and any split size: the scan yields every line once, numbered as in the file."""
    records = ["0 HEAD", "1 CHAR UTF-8", ""] + [
        line for i in range(60) for line in (f"0 @I{i}@ INDI", f"1 NAME Ànna{i} /Ñu/", "1 BIRT", "2 DATE 1900")
    ] + ["0 TRLR"]
    (tmp_path / "a.ged").write_bytes(b"\xef\xbb\xbf" + "\r\n".join(records).encode())
    (tmp_path / "b.ged").write_bytes(("\n".join(records) + "\n").encode())
    expected = [(i, *line.split(" ", 1)) for i, line in enumerate(records, 1) if line]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "1024", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            parsed = gedcom.parse_records(gedcom.read_records(spark, str(tmp_path)))
            lines = gedcom.line_table(parsed)
            for name in ("a.ged", "b.ged"):
                part = lines.where(F.col("path").endswith(name)).orderBy("line_no").collect()
                got = []
                for r in part:
                    pointer = f"@{r.xref}@ " if r.xref else ""
                    got.append((r.line_no, str(r.level), (pointer + r.tag + (f" {r.value}" if r.value else ""))))
                assert got == expected
            assert gedcom.rejected_lines(parsed).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parsing_needs_no_shuffle(spark, tmp_path):
    (tmp_path / "a.ged").write_text(SAMPLE)
    roots = gedcom.entities(gedcom.parse_records(gedcom.read_records(spark, str(tmp_path))))
    for table in (gedcom.persons, gedcom.events, gedcom.links, gedcom.family_children):
        plan = table(roots)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


def test_long_records_are_walked_in_runs(spark):
    levels = [1 + (i * 7) % 5 for i in range(1000)]
    text = "0 HEAD\n0 @N1@ NOTE x\n" + "\n".join(f"{k} T{i} v" for i, k in enumerate(levels))
    df = spark.createDataFrame([("a", text)], "path string, text string")
    lines = {r.line_no: (r.level, r.parent_line) for r in gedcom.line_table(gedcom.parse_records(gedcom.records_from_text(df))).collect()}
    known = [(2, 0)] + [(i + 3, k) for i, k in enumerate(levels)]
    for at, (number, level) in enumerate(known):
        before = [n for n, k in known[:at] if k < level]
        assert lines[number] == (level, before[-1] if before else None)


def test_events_keep_to_their_own_lines(spark):
    text = (
        "0 HEAD\n0 @I1@ INDI\n2 BIRT\n3 DATE 1900\n2 DEAT\n1 BURI\n2 PLAC A\n3 CONC b\n2 PLAC z\n2 SOUR @S1@\n1 NAME x\n2 DATE no\n"
        "1 RESI\n1 CENS\n2 NOTE n\n2 NOTE @N1@\n2 DATE d\n2 OBJE @O1@\n0 TRLR"
    )
    df = spark.createDataFrame([("a", text)], "path string, text string")
    roots = gedcom.entities(gedcom.parse_records(gedcom.records_from_text(df)))
    rows = [(r.event_type, r.date_text, r.place, r.notes) for r in gedcom.events(roots).orderBy("seq").collect()]
    assert rows == [
        ("birth", "1900", None, []), ("death", None, None, []), ("burial", None, "Ab", []), ("residence", None, None, []), ("census", "d", None, ["n"])
    ]
    assert {(r.position, r.tag, r.target) for r in gedcom.event_links(roots).collect()} == {(3, "SOUR", "S1"), (5, "OBJE", "O1")}
