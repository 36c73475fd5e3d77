"""GEDCOM 5.5.1 text files to tables.

Files are split at every level-0 line by the text source itself, so even one
huge file is read by many tasks. A record is then parsed in place, without a
shuffle: lines, hierarchy and entities are array expressions on its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from stemma.functions.numeric import let
from stemma.functions.text import WHITESPACE, strip

# Event tags and the event type each stands for.
EVENT_TYPES = {
    "BIRT": "birth",
    "DEAT": "death",
    "MARR": "marriage",
    "DIV": "divorce",
    "BAPM": "baptism",
    "CHR": "christening",
    "BURI": "burial",
    "CENS": "census",
    "EDUC": "education",
    "EMIG": "emigration",
    "GRAD": "graduation",
    "IMMI": "immigration",
    "NATU": "naturalization",
    "OCCU": "occupation",
    "PROB": "probate",
    "RESI": "residence",
    "RETI": "retirement",
    "WILL": "will",
    "ADOP": "adoption",
    "EVEN": "event",
}

# Why a line is malformed.
BAD_LEVEL, NO_TAG, BARE_POINTER = "nivell no numèric", "falta el tag", "punter sense tag"

RECORD_SEPARATOR = "\n0 "
_LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_LEVELS = 10
# Lines in a run of the walk through a record.
_RUN = 256


# -------------------------------------------------------------------- lines


def scan_files(reader: DataFrameReader | DataStreamReader, paths: str | list[str], record_separator: str = RECORD_SEPARATOR) -> DataFrame:
    """``(value, path, block)``: one row per level-0 record, read in batch or as a stream."""
    return reader.option("lineSep", record_separator).text(paths).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def number_records(scanned: DataFrame) -> DataFrame:
    """``(path, block, rec, head, text)``: records in file order by ``block, rec``.

    ``block`` is the start of the file split, ``rec`` rises within a split.
    The separator swallowed ``0 ``, which is put back on all but the file's
    head.
    """
    raw = scanned.withColumn("rec", F.monotonically_increasing_id())
    looks_like_head = (F.col("block") == 0) & F.col("value").rlike("^\ufeff*\\s*\\d")
    blank = strip(F.btrim("value", F.lit("\ufeff"))) == ""
    return _put_back(raw.where(~(blank & (F.col("block") == 0))), looks_like_head)


def read_records(spark: SparkSession, paths: str | list[str], record_separator: str = RECORD_SEPARATOR) -> DataFrame:
    """Records of GEDCOM files; those with bare carriage returns need ``record_separator="\\r0 "``."""
    return number_records(scan_files(spark.read, paths, record_separator))


def records_from_text(df: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """The same rows from whole texts held in a table, one text per row."""
    parts = df.select(F.col(path).alias("path"), F.posexplode(F.split(text, RECORD_SEPARATOR)).alias("rec", "value"))
    rows = parts.select("value", "path", F.lit(0).cast("bigint").alias("block"), F.col("rec").cast("bigint").alias("rec"))
    return _put_back(rows, F.col("rec") == 0)


def _put_back(raw: DataFrame, head: Column) -> DataFrame:
    # In files with CRLF the separator leaves its carriage return behind.
    value = F.regexp_replace("value", "\r\\z", "")
    text = F.when(head, value).otherwise(F.concat(F.lit("0 "), value))
    return raw.select("path", "block", "rec", head.alias("head"), text.alias("text"))


def _read_line(raw: Column, position: Column) -> Column:
    """Level, pointer, tag and value of one physical line, or why it is malformed."""
    line = F.regexp_replace(F.ltrim(raw, F.lit("﻿")), "[\r\n ]+$", "")

    def split_level(bare: Column) -> Column:
        rest = strip(F.substr(bare, F.lit(2)))
        return let(F.struct(bare.alias("bare"), rest.alias("rest")), build)

    def build(x: Column) -> Column:
        bare, rest = x["bare"], x["rest"]
        pointer = rest.startswith("@")
        spaced = F.contains(rest, F.lit(" "))
        body = F.when(pointer, F.regexp_replace(rest, "(?s)^[^ ]* ", "")).otherwise(rest)
        reason = (
            F.when(~bare.rlike("^\\d"), F.lit(BAD_LEVEL))
            .when(rest == "", F.lit(NO_TAG))
            .when(pointer & ~spaced, F.lit(BARE_POINTER))
        )
        first_word = F.regexp_extract(body, "^([^ ]*)", 1)
        return F.struct(
            position.alias("line"),
            F.when(reason.isNull(), F.substring(bare, 1, 1).cast("int")).alias("level"),
            F.when(pointer, strip(F.btrim(F.regexp_extract(rest, "^([^ ]*)", 1), F.lit("@"))))
            .otherwise(F.lit(""))
            .alias("xref"),
            F.upper(first_word).alias("tag"),
            F.substr(body, F.length(first_word) + 2).alias("value"),
            reason.alias("reason"),
            bare.alias("raw"),
        )

    return let(F.ltrim(line, F.lit(WHITESPACE)), split_level)


def parse_records(records: DataFrame) -> DataFrame:
    """Add ``n_lines``, ``lines`` (with ``idx`` and ``parent``) and ``rejected`` to record rows.

    The parent of a line is the nearest line before it with a smaller level.
    Walking the lines once, the last line of each of the ten levels is kept;
    the parent is the latest of those below the own level. The walk goes in
    runs: a step copies what it has gathered, so what is gathered starts anew
    with each run.
    """
    split = records.select("path", "block", "rec", "head", F.split("text", _LINE_BREAKS).alias("raws"))
    read = F.filter(F.transform("raws", _read_line), lambda x: strip(x["raw"]) != "")
    both = split.select("path", "block", "rec", "head", F.size("raws").alias("n_lines"), read.alias("read"))
    kept = both.select(
        "path", "block", "rec", "head", "n_lines",
        F.filter("read", lambda x: x["reason"].isNull()).alias("good"),
        F.filter("read", lambda x: x["reason"].isNotNull()).alias("rejected"),
    )
    no_parents = F.array().cast("array<int>")
    nothing = F.struct(F.array_repeat(F.lit(-1), _LEVELS).alias("last"), no_parents.alias("parents"))
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size("good") / _RUN) - 1, F.lit(0)).cast("int")),
        lambda i: F.slice("good", i * _RUN + 1, F.lit(_RUN)),
    )

    def walk(before: Column, run: Column) -> Column:
        def step(acc: Column, line: Column) -> Column:
            here = F.size(before["parents"]) + F.size(acc["parents"])
            parent = F.coalesce(F.array_max(F.slice(acc["last"], F.lit(1), line["level"])), F.lit(-1))
            last = F.transform(acc["last"], lambda v, k: F.when(k == line["level"], here).otherwise(v))
            return F.struct(last.alias("last"), F.concat(acc["parents"], F.array(parent)).alias("parents"))

        own = F.aggregate(run, F.struct(before["last"].alias("last"), no_parents.alias("parents")), step)
        return let(
            own, lambda x: F.struct(x["last"].alias("last"), F.concat(before["parents"], x["parents"]).alias("parents"))
        )

    walked = kept.withColumn("parents", F.aggregate(runs, nothing, walk, lambda acc: acc["parents"]))
    # Zipped, not looked up by position: a lookup inside the lambda would walk the record once per line.
    lines = F.transform(
        F.arrays_zip("good", "parents"),
        lambda z, i: F.struct(
            i.alias("idx"), z["good"]["line"].alias("line"), z["good"]["level"].alias("level"),
            z["good"]["xref"].alias("xref"), z["good"]["tag"].alias("tag"), z["good"]["value"].alias("value"),
            z["parents"].alias("parent"),
        ),
    )
    return walked.select("path", "block", "rec", "head", "n_lines", lines.alias("lines"), "rejected")


def _line_offsets(parsed: DataFrame) -> DataFrame:
    """First line number of every record.

    Lines are counted per split first, so the running count over a whole file
    touches one row per split, and the one over records stays within a split.
    """
    per_record = parsed.select("path", "block", "rec", "n_lines")
    splits = per_record.groupBy("path", "block").agg(F.sum("n_lines").alias("n"))
    file_order = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = splits.select("path", "block", F.coalesce(F.sum("n").over(file_order), F.lit(0)).alias("before"))
    split_order = W.partitionBy("path", "block").orderBy("rec").rowsBetween(W.unboundedPreceding, -1)
    within = per_record.select(
        "path", "block", "rec", F.coalesce(F.sum("n_lines").over(split_order), F.lit(0)).alias("within")
    )
    return within.join(before, ["path", "block"]).select("path", "block", "rec", (F.col("before") + F.col("within")).alias("offset"))


def line_table(parsed: DataFrame) -> DataFrame:
    """``(path, line_no, level, xref, tag, value, parent_line, parent_tag)``, numbered as in the file.

    A parent is in the same record, so it is looked up there and no line
    carries the others of its record along.
    """
    numbered = parsed.select("path", "block", "rec", "lines").join(_line_offsets(parsed), ["path", "block", "rec"])

    def with_parent(x: Column) -> Column:
        parent = F.when(x["parent"] >= 0, F.get("lines", x["parent"]))
        return F.struct(
            x["line"].alias("line"), x["level"].alias("level"), x["xref"].alias("xref"), x["tag"].alias("tag"),
            x["value"].alias("value"), parent["line"].alias("above"), parent["tag"].alias("parent_tag"),
        )

    rows = numbered.select("path", "offset", F.explode(F.transform("lines", with_parent)).alias("x"))
    number = lambda line: F.col("offset") + F.col(line) + 1
    return rows.select(
        "path", number("x.line").alias("line_no"), "x.level", "x.xref", "x.tag", "x.value",
        number("x.above").alias("parent_line"), "x.parent_tag",
    )


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """``(path, line_no, reason, raw, message)`` of malformed lines.

    A file none of whose records looks like its head starts with a line
    without a level.
    """
    bad = parsed.where(F.size("rejected") > 0).select("path", "block", "rec", F.explode("rejected").alias("x"))
    number = F.col("offset") + F.col("x.line") + 1
    found = bad.join(_line_offsets(parsed), ["path", "block", "rec"]).select(
        "path", number.alias("line_no"), "x.reason", "x.raw"
    )
    headless = parsed.groupBy("path").agg(F.bool_or("head").alias("head")).where("not head")
    first = headless.select(
        "path", F.lit(1).cast("bigint").alias("line_no"), F.lit(BAD_LEVEL).alias("reason"), F.lit("").alias("raw")
    )
    message = F.concat(F.lit("Línia "), "line_no", F.lit(": "), "reason", F.lit(": '"), "raw", F.lit("'"))
    return found.unionByName(first).withColumn("message", message)


class GedcomError(ValueError):
    """A file holds malformed lines."""


def fail_on_rejected(parsed: DataFrame) -> None:
    """Raise with the first malformed line, if there is one."""
    first = rejected_lines(parsed).orderBy("path", "line_no").first()
    if first is not None:
        raise GedcomError(f"{first['path']}: {first['message']}")


# ----------------------------------------------------------------- entities


def _children(lines: Column, idx: Column, *tags: str) -> Column:
    return F.filter(lines, lambda x: (x["parent"] == idx) & x["tag"].isin(*tags))


def _first(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(1))


def _last(lines: Column) -> Column:
    return F.try_element_at(lines, F.lit(-1))


def _folded(lines: Column, node: Column) -> Column:
    """Value of a line with its CONT and CONC lines."""
    more = F.transform(
        _children(lines, node["idx"], "CONT", "CONC"),
        lambda c: F.when(c["tag"] == "CONT", F.concat(F.lit("\n"), c["value"])).otherwise(c["value"]),
    )
    return F.concat(node["value"], F.array_join(more, ""))


def _bare(value: Column) -> Column:
    return strip(F.btrim(strip(value), F.lit("@")))


def _is_pointer(value: Column) -> Column:
    return strip(value).startswith("@")


def entities(parsed: DataFrame) -> DataFrame:
    """``(seq, xref, tag, root, lines)``: one row per root line."""
    rows = parsed.select("path", "block", "rec", "lines", F.explode(F.filter("lines", lambda x: x["parent"] < 0)).alias("root"))
    seq = F.struct("path", "block", "rec", F.col("root.idx").alias("idx"))
    return rows.select(seq.alias("seq"), F.col("root.xref").alias("xref"), F.col("root.tag").alias("tag"), "root", "lines")


def _of(roots: DataFrame, tag: str) -> DataFrame:
    return roots.where(F.col("tag") == tag)


def _kids(*tags: str) -> Column:
    return _children(F.col("lines"), F.col("root.idx"), *tags)


def _name(lines: Column, node: Column) -> Column:
    """Name parts of a NAME line; GIVN, SURN and NICK lines override."""
    both, single = "(?s)^([^/]*)/(.*)/([^/]*)$", "(?s)^([^/]*)/([^/]*)$"

    def build(value: Column) -> Column:
        enclosed, open_ended = value.rlike(both), value.rlike(single)
        part = lambda group: strip(F.regexp_extract(value, both, group))
        given = F.when(enclosed, part(1)).when(open_ended, strip(F.regexp_extract(value, single, 1))).otherwise(strip(value))
        suffix = F.when(enclosed, part(3)).when(open_ended, strip(F.regexp_extract(value, single, 2))).otherwise(F.lit(""))
        override = lambda tag: F.nullif(_first(_children(lines, node["idx"], tag))["value"], F.lit(""))
        return F.struct(
            value.alias("value"),
            F.coalesce(strip(override("GIVN")), given).alias("given"),
            F.coalesce(strip(override("SURN")), F.when(enclosed, part(2)).otherwise(F.lit(""))).alias("surname"),
            F.coalesce(strip(override("NICK")), suffix).alias("suffix"),
        )

    return let(_folded(lines, node), build)


def _names() -> Column:
    return F.transform(_kids("NAME"), lambda n: _name(F.col("lines"), n))


def _inline_notes() -> Column:
    inline = F.filter(_kids("NOTE"), lambda n: ~_is_pointer(n["value"]))
    return F.transform(inline, lambda n: _folded(F.col("lines"), n))


def persons(roots: DataFrame) -> DataFrame:
    """``(xref, seq, sex, given, surname, suffix, notes)`` with the primary name."""
    sexes = F.filter(_kids("SEX"), lambda s: s["value"] != "")
    rows = _of(roots, "INDI").select(
        "xref",
        "seq",
        strip(_last(sexes)["value"]).alias("sex"),
        _first(_names()).alias("n"),
        F.nullif(F.array_join(_inline_notes(), "\n"), F.lit("")).alias("notes"),
    )
    return rows.select("xref", "seq", "sex", "n.given", "n.surname", "n.suffix", "notes")


def person_names(roots: DataFrame) -> DataFrame:
    """``(owner_xref, position, value, given, surname, suffix)`` of all name variants."""
    rows = _of(roots, "INDI").select(F.col("xref").alias("owner_xref"), F.posexplode(_names()).alias("position", "n"))
    return rows.select("owner_xref", (F.col("position") + 1).alias("position"), "n.*")


def families(roots: DataFrame) -> DataFrame:
    """``(xref, seq, husband_xref, wife_xref)``; the last of several wins."""
    role = lambda tag: _bare(_last(_kids(tag))["value"])
    return _of(roots, "FAM").select("xref", "seq", role("HUSB").alias("husband_xref"), role("WIFE").alias("wife_xref"))


def family_children(roots: DataFrame) -> DataFrame:
    """``(family_xref, child_xref, sibling_order)`` in the order of the record."""
    rows = _of(roots, "FAM").select(F.col("xref").alias("family_xref"), "seq", F.posexplode(_kids("CHIL")).alias("p", "c"))
    return rows.select("family_xref", _bare(F.col("c.value")).alias("child_xref"), (F.col("p") + 1).alias("sibling_order"), "seq")


def _event_bodies() -> Column:
    """Each event line of the root with the lines below it, ``(e, body)``.

    These reach to the next line below the root itself, so an event looks at
    its own lines only, and only they travel with it.
    """
    lines, root = F.col("lines"), F.col("root.idx")
    tops = F.filter(lines, lambda x: (x["parent"] == root) | ((x["parent"] < 0) & (x["idx"] > root)))
    starts = F.transform(tops, lambda x: x["idx"])
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(tops), F.lit(1))), F.array(F.size(lines)))
    pairs = F.arrays_zip(tops.alias("e"), ends.alias("end"))
    told = F.filter(pairs, lambda z: (z["e"]["parent"] == root) & z["e"]["tag"].isin(*EVENT_TYPES))
    return F.transform(
        told,
        lambda z: F.struct(
            z["e"].alias("e"), F.slice("lines", z["e"]["idx"] + 2, z["end"] - z["e"]["idx"] - 1).alias("body")
        ),
    )


def events(roots: DataFrame) -> DataFrame:
    """Life events of persons and families: type, first date and place, inline notes."""
    owners = roots.where(F.col("tag").isin("INDI", "FAM"))
    rows = owners.select(
        F.col("xref").alias("owner_xref"),
        F.when(F.col("tag") == "INDI", F.lit("person")).otherwise(F.lit("family")).alias("owner_kind"),
        "seq",
        F.posexplode(_event_bodies()).alias("position", "x"),
    ).select("owner_xref", "owner_kind", "seq", "position", "x.*")
    lines, idx = F.col("body"), F.col("e.idx")
    first = lambda tag: let(
        _first(_children(lines, idx, tag)), lambda n: F.nullif(_folded(lines, n), F.lit(""))
    )
    types = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    inline = F.filter(_children(lines, idx, "NOTE"), lambda n: ~_is_pointer(n["value"]))
    return rows.select(
        "owner_xref",
        "owner_kind",
        F.struct("seq", F.col("position").alias("position")).alias("seq"),
        F.try_element_at(types, F.col("e.tag")).alias("event_type"),
        first("DATE").alias("date_text"),
        first("PLAC").alias("place"),
        F.transform(inline, lambda n: n["value"]).alias("notes"),
    )


def first_events(all_events: DataFrame, event_type: str) -> DataFrame:
    """The first event of a type per owner."""
    return all_events.where(F.col("event_type") == event_type).groupBy("owner_kind", "owner_xref").agg(
        F.min_by(F.struct("date_text", "place"), "seq").alias("e")
    ).select("owner_kind", "owner_xref", "e.date_text", "e.place")


def sources(roots: DataFrame) -> DataFrame:
    """``(xref, seq, title, author, publication, page)``; the last line of a tag wins."""
    raw = lambda tag: F.coalesce(_last(_kids(tag))["value"], F.lit(""))
    title = F.coalesce(let(_last(_kids("TITL")), lambda n: _folded(F.col("lines"), n)), F.lit(""))
    return _of(roots, "SOUR").select(
        "xref", "seq", title.alias("title"), raw("AUTH").alias("author"), raw("PUBL").alias("publication"), raw("PAGE").alias("page")
    )


def media(roots: DataFrame) -> DataFrame:
    """``(xref, seq, file, title)``; the first line of a tag wins."""
    first = lambda tag: F.coalesce(
        let(_first(_kids(tag)), lambda n: _folded(F.col("lines"), n)), F.lit("")
    )
    return _of(roots, "OBJE").select("xref", "seq", first("FILE").alias("file"), first("TITL").alias("title"))


def notes(roots: DataFrame) -> DataFrame:
    """``(xref, seq, text)`` of note records."""
    return _of(roots, "NOTE").select("xref", "seq", _folded(F.col("lines"), F.col("root")).alias("text"))


def note_texts(roots: DataFrame) -> DataFrame:
    """Inline notes of persons and families."""
    owners = roots.where(F.col("tag").isin("INDI", "FAM"))
    rows = owners.select(F.col("xref").alias("owner_xref"), F.posexplode(_inline_notes()).alias("position", "text"))
    return rows.select("owner_xref", (F.col("position") + 1).alias("position"), "text")


def links(roots: DataFrame) -> DataFrame:
    """``(owner_xref, owner_kind, tag, target, seq)`` of persons and families.

    SOUR, OBJE and NOTE count only when they point somewhere; FAMC and FAMS
    always do.
    """
    owners = roots.where(F.col("tag").isin("INDI", "FAM"))
    rows = owners.select(
        F.col("xref").alias("owner_xref"),
        F.when(F.col("tag") == "INDI", F.lit("person")).otherwise(F.lit("family")).alias("owner_kind"),
        "seq",
        F.explode(_kids("SOUR", "OBJE", "NOTE", "FAMC", "FAMS")).alias("x"),
    )
    family_tag = F.col("x.tag").isin("FAMC", "FAMS")
    kept = rows.where((family_tag & (F.col("owner_kind") == "person")) | (~family_tag & _is_pointer(F.col("x.value"))))
    return kept.select(
        "owner_xref", "owner_kind", F.col("x.tag").alias("tag"), _bare(F.col("x.value")).alias("target"),
        F.struct("seq", F.col("x.idx").alias("line")).alias("seq"),
    )


def event_links(roots: DataFrame) -> DataFrame:
    """``(owner_xref, position, tag, target)`` of the source and media pointers of events."""
    return placed_event_links(roots).drop("seq")


def placed_event_links(roots: DataFrame) -> DataFrame:
    """The same with ``seq``, the place of the event's record."""
    rows = roots.where(F.col("tag").isin("INDI", "FAM")).select(
        "seq", F.col("xref").alias("owner_xref"), F.posexplode(_event_bodies()).alias("position", "x")
    )
    pointed = _children(F.col("x.body"), F.col("x.e.idx"), "SOUR", "OBJE")
    found = rows.select(
        "seq", "owner_xref", (F.col("position") + 1).alias("position"), F.explode(pointed).alias("x")
    )
    return found.where(_is_pointer(F.col("x.value"))).select(
        "seq", "owner_xref", "position", F.col("x.tag").alias("tag"), _bare(F.col("x.value")).alias("target")
    )
