"""Registered queries against their DuckDB equivalents on the smallest data set."""

import pathlib

import duckdb
import pytest

from stemma.plans.oracle import ORACLE
from stemma.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# A cross-section; the whole registry is compared by the driver.
CHOSEN = (
    "gedcom_tree gedcom_links gedcom_notes date_normalize date_parse date_overlaps name_normalize fold_documents soundex "
    "place_dimension source_dedup surrogate_keys append_conflicts merge_conflicts derived_life_dates life_events "
    "issues_all import_statistics quality_score quality_factors dashboard findings_by_category duplicate_candidates "
    "duplicate_group_members place_similarity place_containment name_similarity person_search_catalog person_spouses "
    "family_detail ancestor_trees fulltext_documents tasks_per_kind findings_markdown"
).split()


@pytest.fixture(scope="module")
def duck():
    if not pathlib.Path(FOLDER).exists():
        pytest.skip("no test data")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_an_equivalent():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert [repr(r) for r in got] == [repr(r) for r in expected]
