"""The derived genealogy written out as GEDCOM files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.plans import fixtures
from stemma.session import staging_dir

# Tags of the event types that occur in the derived data.
EVENT_TAGS = {"birth": "BIRT", "death": "DEAT", "marriage": "MARR", "residence": "RESI", "baptism": "BAPM"}


def _line(level: int, tag: str, value: Column | None = None) -> Column:
    head = F.lit(f"{level} {tag}")
    return head if value is None else F.concat(F.lit(f"{level} {tag} "), value)


def _block(*lines: Column) -> Column:
    """Lines joined by line breaks; NULL lines are left out."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def person_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One INDI record text per person."""
    events = fixtures.life_events(spark, sf_dir)
    tags = F.create_map(*[F.lit(x) for pair in EVENT_TAGS.items() for x in pair])
    event_text = _block(
        F.concat(F.lit("1 "), F.try_element_at(tags, F.col("event_type"))),
        _line(2, "DATE", F.col("date_text")),
        _line(2, "PLAC", F.col("place")),
    )
    by_person = events.select("person_id", F.struct("event_id", event_text.alias("t")).alias("e")).groupBy("person_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["t"]), "\n").alias("event_text")
    )
    links = fixtures.person_links(spark, sf_dir).select(
        F.col("owner_xref").alias("xref"),
        F.struct("seq", F.concat(F.lit("1 "), "tag", F.lit(" @"), "target", F.lit("@")).alias("t")).alias("l"),
    )
    by_owner = links.groupBy("xref").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda e: e["t"]), "\n").alias("link_text")
    )
    people = fixtures.persons(spark, sf_dir).join(by_person, "person_id", "left").join(by_owner, "xref", "left")
    given, surname = F.coalesce("given_name", F.lit("")), F.coalesce("surname", F.lit(""))
    name = F.when(
        (given != "") | (surname != ""),
        F.concat(F.lit("1 NAME "), given, F.when(surname != "", F.concat(F.lit(" /"), surname, F.lit("/"))).otherwise(F.lit(""))),
    )
    text = _block(
        F.concat(F.lit("0 @"), "xref", F.lit("@ INDI")), name, _line(1, "SEX", F.col("sex")),
        F.col("event_text"), F.col("link_text"),
    )
    return people.select(text.alias("text"))


def family_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One FAM record text per family."""
    kids = fixtures.family_child_records(spark, sf_dir).select(
        F.col("family_xref").alias("xref"),
        F.struct("sibling_order", F.concat(F.lit("1 CHIL @"), "child_xref", F.lit("@")).alias("t")).alias("c"),
    )
    by_family = kids.groupBy("xref").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda e: e["t"]), "\n").alias("child_text")
    )
    rows = fixtures.family_records(spark, sf_dir).join(by_family, "xref", "left")
    text = _block(
        F.concat(F.lit("0 @"), "xref", F.lit("@ FAM")),
        F.concat(F.lit("1 HUSB @"), "husband_xref", F.lit("@")),
        F.concat(F.lit("1 WIFE @"), "wife_xref", F.lit("@")),
        F.col("child_text"),
    )
    return rows.select(text.alias("text"))


def other_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SOUR, OBJE and NOTE records; note texts are folded into CONT lines."""
    head = lambda tag: F.concat(F.lit("0 @"), "xref", F.lit(f"@ {tag}"))
    source = fixtures.source_records(spark, sf_dir).select(
        _block(
            head("SOUR"), _line(1, "TITL", F.nullif("title", F.lit(""))), _line(1, "AUTH", F.nullif("author", F.lit(""))),
            _line(1, "PUBL", F.col("publication")),
        ).alias("text")
    )
    item = fixtures.media_records(spark, sf_dir).select(
        _block(head("OBJE"), _line(1, "FILE", F.col("file")), _line(1, "TITL", F.col("title"))).alias("text")
    )
    lines = F.split("text", "\n")
    more = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.concat(F.lit("1 CONT "), x))
    note = fixtures.note_records(spark, sf_dir).select(
        F.array_join(F.concat(F.array(F.concat(head("NOTE"), F.lit(" "), F.element_at(lines, 1))), more), "\n").alias("text")
    )
    return source.unionByName(item).unionByName(note)


def nation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records ``(path, block, rec, head, text)`` of one document per nation, whose ids repeat from one to the other.

    Every document has a source S1 and a medium O1 of its own. Its family
    points to its first person and to the first of all, who is in one document
    only. A teller T<n> is in the documents n and, where n is divisible by 5,
    n + 1; a family G<n> is in n and, where the remainder is 1, in n + 1.
    """
    customer = fixtures.table(spark, sf_dir, "customer").select(F.expr("c_custkey + 1 as person_id"), F.col("c_nationkey").alias("n"))
    people = customer.join(fixtures.persons(spark, sf_dir), "person_id").select("n", "person_id", "given_name", "birth_date")
    born = F.concat(
        F.lit("1 BIRT\n2 DATE "), "birth_date", F.lit("\n2 SOUR @S1@\n2 OBJE @O1@\n2 SOUR @S2@"),
    )
    person = people.select(
        "n", F.col("person_id").alias("rec"),
        _block(
            F.concat(F.lit("0 @I"), "person_id", F.lit("@ INDI")), _line(1, "NAME", F.coalesce("given_name", F.lit("?"))), born,
            F.lit("1 SOUR @S1@"), F.when(F.col("person_id") % 3 == 0, F.lit("1 OBJE @O1@")),
        ).alias("text"),
    )
    least = people.agg(F.min("person_id")).first()[0]
    nations = people.groupBy("n").agg(F.min("person_id").alias("own")).withColumn("least", F.lit(least))
    texts = [
        "'0 HEAD'",
        "concat('0 @T', n - if(n % 5 = 1, 1, 0), '@ INDI\n1 NAME Teller ', n)",
        "concat('0 @G', n - if(n % 5 = 2, 1, 0), '@ FAM')",
        "concat('0 @F1N', n, '@ FAM\n1 HUSB @I', own, '@\n1 WIFE @I', least, '@\n1 CHIL @I', least, '@\n1 CHIL @I', own, '@"
        "\n1 DIV\n2 DATE ', 1850 + n, '\n1 MARR\n2 DATE 1 JAN ', 1810 + n, '\n2 PLAC Vic')",
        "concat('0 @S1@ SOUR\n1 TITL Register ', n)",
        "concat('0 @O1@ OBJE\n1 FILE ', n, '.jpg')",
    ]
    more = nations.select("n", F.posexplode(F.array(*[F.expr(t) for t in texts])).alias("k", "text"))
    whole = person.unionByName(more.select("n", (F.col("k") - 10).cast("bigint").alias("rec"), "text"))
    return whole.select(
        F.concat(F.lit("nation-"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("path"),
        F.lit(0).cast("bigint").alias("block"), "rec", F.lit(True).alias("head"), "text",
    )


_written: dict[tuple[str, str], str] = {}


def write_gedcom(spark: SparkSession, sf_dir: str) -> str:
    """Write the derived data set as GEDCOM files once per session and return their folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        name = hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        path = f"{staging_dir(spark)}/gedcom-{name}"
        # One header record, whatever the number of files.
        texts = spark.range(1).select(F.lit("0 HEAD\n1 CHAR UTF-8").alias("text"))
        for more in (person_texts, family_texts, other_texts):
            texts = texts.unionByName(more(spark, sf_dir))
        texts.write.mode("overwrite").text(path)
        _written[key] = path
    return _written[key]
