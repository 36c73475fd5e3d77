"""Genealogical tables derived by arithmetic from the commerce tables.

The driver's parquet holds no genealogy, so the registered queries run on
whole tables derived from it: a customer is a person, an order is a life
event, a part name gives the person's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MONTH = "substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', cast(({i}) * 3 + 1 as int), 3)"


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored persons: id, xref, names, sex and date texts of mixed formats."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = customer.join(part, F.col("k") == F.col("p_partkey")).selectExpr(
        "k",
        "split_part(p_name, ' ', 1) as g",
        "split_part(p_name, ' ', 2) as s",
        "1700 + (k * 7919) % 250 as yb",
        "1700 + (k * 7919) % 250 + (k * 31) % 95 - 3 as yd",
    )
    month = _MONTH.format(i="k % 12")
    day = "1 + k % 28"
    return named.selectExpr(
        "k + 1 as person_id",
        "concat('I', k + 1) as xref",
        "case when k % 13 = 0 then null when k % 5 = 0 then replace(g, 'e', 'é') else g end as given_name",
        "case when k % 17 = 0 then null when k % 7 = 0 then upper(s) else s end as surname",
        "case when k % 11 = 0 then null when k % 2 = 0 then 'M' else 'F' end as sex",
        f"""case k % 9
              when 0 then null
              when 1 then cast(yb as string)
              when 2 then concat({month}, ' ', yb)
              when 3 then concat({day}, ' ', {month}, ' ', yb)
              when 4 then concat('ABT ', yb)
              when 5 then concat('BET ', yb, ' AND ', yb + 3)
              when 6 then concat('BEF ', yb)
              when 7 then concat(yb, '-0', 1 + k % 9, '-1', k % 9)
              else case when k % 2 = 0 then 'unknown'
                        else concat({day}, '.', 1 + k % 12, '.', yb) end
            end as birth_date""",
        f"""case k % 4
              when 0 then null
              when 1 then cast(yd as string)
              when 2 then concat('AFT ', yd)
              else concat({day}, ' ', {month}, ' ', yd)
            end as death_date""",
    )


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One family per three neighbouring customers; the first of them is the husband."""
    grouped = table(spark, sf_dir, "customer").groupBy(
        F.expr("cast(floor(c_custkey / 3) as bigint) as t")
    ).agg(F.min("c_custkey").alias("k"))
    return grouped.selectExpr("k", "t + 1 as family_id", "t % 4 as n_children")


def family_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family records as read from a file: husband and wife are still pointers."""
    return _parents(spark, sf_dir).selectExpr(
        "family_id",
        "concat('F', family_id) as xref",
        "concat('I', k + 1) as husband_xref",
        "concat('I', case when k % 21 = 0 then k + 5000000 else k + 2 end) as wife_xref",
        "n_children",
    )


def family_child_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child pointers of the family records, in order; some point nowhere."""
    return (
        _parents(spark, sf_dir)
        .where("n_children > 0")
        .selectExpr("k", "family_id", "explode(sequence(0L, n_children - 1)) as j")
        .selectExpr(
            "family_id",
            "concat('F', family_id) as family_xref",
            "concat('I', 2 * k + 5 + j) as child_xref",
            "cast(j + 1 as int) as sibling_order",
        )
    )


def life_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life events with a date text and one of several spellings of a place."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    month = _MONTH.format(i="month(o_orderdate) - 1")
    return joined.selectExpr(
        "o_orderkey as event_id",
        "o_custkey + 1 as person_id",
        """case substr(o_orderpriority, 1, 1) when '1' then 'birth' when '2' then 'death'
             when '3' then 'marriage' when '4' then 'residence' else 'baptism' end as event_type""",
        f"concat(day(o_orderdate), ' ', {month}, ' ', year(o_orderdate)) as date_text",
        """case o_orderkey % 4 when 0 then n_name when 1 then lower(n_name)
             when 2 then concat(n_name, ' ,') else replace(n_name, 'A', 'Á') end as place""",
    )


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source records with repeated titles."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as seq",
        "concat('S', s_suppkey) as xref",
        "case when s_suppkey % 10 = 9 then '' else concat('Register ', s_nationkey) end as title",
        "case when s_suppkey % 4 = 0 then '' else s_name end as author",
        "concat('Vol. ', s_suppkey % 7) as publication",
    )


def media_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media records, some without a file."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as seq",
        "concat('O', p_partkey) as xref",
        "case when p_partkey % 3 = 0 then null else concat(replace(p_brand, '#', ''), '/', p_partkey, '.jpg') end as file",
        "p_name as title",
    )


def note_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note records over the whole document texts."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id as seq", "concat('N', doc_id) as xref", "text")


def person_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers of person records: ``(owner_xref, tag, target, seq)``.

    Tags are SOUR, OBJE, NOTE, FAMC and FAMS; some targets are undefined.
    """
    k = table(spark, sf_dir, "customer").selectExpr("c_custkey as k")
    own = k.selectExpr(
        "concat('I', k + 1) as owner_xref",
        """explode(array_compact(array(
             struct('SOUR' as tag, concat('S', k % 103) as target, 1 as seq),
             case when k % 3 = 1 then struct('SOUR' as tag, concat('S', k % 103) as target, 2 as seq) end,
             case when k % 3 = 2 then struct('SOUR' as tag, concat('S', (k + 25) % 103) as target, 2 as seq) end,
             struct('OBJE' as tag, concat('O', k - k % 10) as target, 3 as seq),
             case when k % 4 = 1 then struct('OBJE' as tag, concat('O', k * 5) as target, 4 as seq) end,
             struct('NOTE' as tag, concat('N', k % 1100) as target, 5 as seq),
             case when k % 97 = 0 then struct('FAMS' as tag, concat('F', k + 1000000) as target, 9 as seq) end
           ))) as link""",
    ).selectExpr("owner_xref", "link.tag as tag", "link.target as target", "link.seq as seq")
    spouse = family_records(spark, sf_dir).selectExpr(
        "stack(2, husband_xref, wife_xref) as owner_xref", "xref"
    ).selectExpr("owner_xref", "'FAMS' as tag", "xref as target", "7 as seq")
    child = family_child_records(spark, sf_dir).selectExpr(
        "child_xref as owner_xref", "'FAMC' as tag", "family_xref as target", "6 as seq"
    )
    known = persons(spark, sf_dir).select(F.col("xref").alias("owner_xref"))
    return own.unionByName(spouse.unionByName(child).join(known, "owner_xref", "left_semi"))


def record_xrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ids of persons and families in file order; every 211th person comes twice."""
    people = persons(spark, sf_dir).selectExpr(
        "xref", "explode(if(person_id % 211 = 0, array(person_id, person_id + 100000000), array(person_id))) as seq"
    )
    fams = family_records(spark, sf_dir).selectExpr("xref", "family_id + 1000000000 as seq")
    return people.unionByName(fams)


def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name variants of person records: the primary name and, for some, a second one."""
    given, surname = "coalesce(given_name, '')", "coalesce(surname, '')"
    return persons(spark, sf_dir).selectExpr(
        "xref as owner_xref",
        f"""inline(array_compact(array(
              case when {given} <> '' or {surname} <> ''
                   then struct(1 as seq, {given} as given, {surname} as surname) end,
              case when person_id % 4 = 0
                   then struct(2 as seq, {given} as given, coalesce(concat(initcap(surname), 's'), '') as surname) end
            )))""",
    )
