import pytest
from pyspark.sql import functions as F

from stemma.operators import ancestors, enrich, findings, quality, relations, search, statistics, tasks
from stemma.plans.dataset import Dataset

PERSON = "person_id long, xref string, given_name string, surname string, sex string, birth_date string, death_date string"
EVENT = "event_id long, person_id long, family_id long, event_type string, date_text string, date_iso string, date_year int, place_key string, place string"


@pytest.fixture(scope="module")
def ds(spark):
    persons = [
        (1, "I1", "Joan", "Garcia", "M", None, "1960"),
        (2, "I2", "Maria", "Puig", "F", "1905", None),
        (3, "I3", "Pere", "García", "M", "10 MAR 1925", "1920"),
        (4, "I4", None, None, None, None, None),
        (5, "I5", "Anna", None, "F", "BET 1950 AND 1955", "2010"),
        (6, "I6", "joan", "garcia", "M", "1900", "1960"),
    ]
    families = [(1, "F1", 1, 2, None, None), (2, "F2", 3, None, None, None)]
    children = [(1, 3, 1, "father", 1), (1, 4, 1, "father", 2), (2, 5, 3, "father", 1)]
    events = [
        (1, 1, None, "residence", "1930", "1930-01-01", 1930, "vic", "Vic"),
        (2, 1, None, "baptism", "1900", "1900-01-01", 1900, "vic", "Vic"),
        (3, 1, None, "birth", "1901", "1901-01-01", 1901, "olot", "Olot"),
        (4, 3, None, "birth", None, None, None, "olot", "Olot"),
        (5, None, 1, "marriage", "1920", "1920-01-01", 1920, None, None),
    ]
    return Dataset(
        spark.createDataFrame(persons, PERSON),
        spark.createDataFrame(families, "family_id long, xref string, father_id long, mother_id long, marriage_date string, marriage_place string"),
        spark.createDataFrame(children, "family_id long, child_id long, parent_id long, role string, sibling_order int"),
        spark.createDataFrame(events, EVENT),
        spark.createDataFrame([("vic", "Vic"), ("olot", "Olot")], "place_key string, name string"),
    )


def by_id(df, *columns):
    return {r.person_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_enrichment(ds):
    got = by_id(ds.enriched, "birth_date", "birth_year", "birth_place", "event_count", "has_parents", "has_family", "has_children")
    assert got[1] == ("1900", 1900, "Vic", 3, False, True, True)
    assert got[3] == ("10 MAR 1925", None, "Olot", 1, True, True, True)
    assert got[4] == (None, None, None, 0, True, False, False)


def test_link_lists(ds):
    lists = by_id(enrich.id_lists(enrich.parent_edges(ds.families, ds.parent_children), "child_id", "ids"), "ids")
    assert lists == {1: ([3, 4],), 2: ([3, 4],), 3: ([5],)}


def test_quality(ds):
    got = by_id(ds.quality, "score")
    # given+surname .25, sex .05, children .15, sources .15, events .1, places .05, birth .1, death .05
    assert got[1] == (0.9,)
    # nothing but parents
    assert got[4] == (0.15,)
    # all factors but the death before birth costs .2
    assert got[3] == (0.85,)
    # given name alone is subtracted: .05 + .15 + .05 + .1 + .05 - .15
    assert got[5] == (0.25,)
    details = by_id(quality.quality_details(quality.quality_inputs(ds.enriched)), "missing", "issues")
    assert details[4] == (["given_name", "surname", "sex", "children", "sources", "events", "places"], [])
    assert details[3] == ([], ["mort (1920) abans de naixement (1925)"])
    summary = quality.quality_summary(ds.quality).first()
    assert (summary.best_person_id, summary.best_score) == (1, 0.9)
    spread = {r["class"]: r["n"] for r in quality.quality_distribution(ds.quality).collect()}
    assert spread == {"excellent": 2, "good": 1, "regular": 1, "low": 2}


def test_empty_person_scores_zero(spark):
    bare = spark.createDataFrame([(1, "I1", None, None, None, None, None)], PERSON)
    nobody = spark.createDataFrame([], "family_id long, father_id long, mother_id long")
    childless = spark.createDataFrame([], "family_id long, child_id long")
    people = enrich.enrich_persons(bare, nobody, childless, spark.createDataFrame([], EVENT))
    assert quality.quality_scores(quality.quality_inputs(people)).first().score == 0.0


def test_statistics(ds):
    ages = statistics.age_at_death(ds.enriched).first()
    assert (ages.average_age, ages.max_age) == (60.0, 60)
    sexes = {r.sex: r.n for r in statistics.sex_distribution(ds.persons).collect()}
    assert sexes == {"M": 3, "F": 2, "U": 1}
    years = statistics.birth_year_range(ds.enriched, ds.events).first()
    assert (years.min_year, years.max_year) == (1900, 1950)
    assert statistics.incomplete_persons(ds.enriched).first().persons_without_data == 1
    top = [(r.name, r.n) for r in statistics.top_places(ds.events).collect()]
    assert top == [("Olot", 2), ("Vic", 2)]
    branches = [(r.family_id, r.children) for r in statistics.largest_branches(ds.parent_children).collect()]
    assert branches == [(1, 2), (2, 1)]


def test_findings_and_tasks(ds):
    got = {(r.category, r.severity): r.n for r in ds.findings.groupBy("category", "severity").agg(F.count("*").alias("n")).collect()}
    assert got[("chronology", "error")] == 1
    assert got[("completeness", "warning")] == 1
    assert got[("completeness", "info")] == 1
    assert got[("relationships", "warning")] == 3
    assert got[("name", "info")] == 1
    pairs = [(r.a_id, r.b_id) for r in ds.candidates.collect()]
    assert pairs == [(1, 6)]
    totals = findings.severity_totals(ds.findings).first()
    assert totals.total == sum(got.values())
    kinds = {r.kind: r.n for r in tasks.task_kinds(ds.tasks).collect()}
    assert kinds == {"birth": 5, "death": 2, "duplicate": 1, "marriage": 2, "parents": 3}
    review = ds.tasks.where("kind = 'duplicate'").first()
    assert review.objective == "Revisar possible duplicat entre Joan Garcia i joan garcia"
    assert (review.priority, review.related_person_ids) == ("high", [6])
    first = tasks.first_per_kind(ds.tasks, 1).select("kind", "person_id").collect()
    assert {r.kind: r.person_id for r in first} == {"birth": 1, "death": 2, "duplicate": 1, "marriage": 5, "parents": 1}


def test_search(ds):
    found = search.search_catalog(ds.enriched, ds.events, q="N G", place="olo").collect()
    assert [(r.person_id, r.quality) for r in found] == [(1, 0.9)]
    assert [r.person_id for r in search.search_persons(ds.persons, q="gar").collect()] == [1, 3, 6]
    index = search.token_index(ds.persons, "person_id", "given_name", "surname")
    assert [r.person_id for r in search.search_index(index, "person_id", "garcía JOAN").collect()] == [1, 6]


def test_relations(ds):
    detail = relations.person_details(
        ds.enriched, ds.families, ds.parent_children, ds.events,
        ds.persons.select("person_id", F.lit("S1").alias("source_xref")).limit(0),
        ds.persons.select(F.lit("S1").alias("xref"), F.lit("t").alias("title"), F.lit("a").alias("author")).limit(0),
        ds.persons.where("person_id in (1, 3)").select("person_id"),
    )
    rows = {r.person_id: r for r in detail.collect()}
    assert [p.parent_display_name for p in rows[3].parents] == ["Joan Garcia", "Maria Puig"]
    assert [s.spouse_display_name for s in rows[3].spouses] == [None]
    assert [c.child_display_name for c in rows[1].children] == ["I4", "Pere García"]
    assert [e.event_id for e in rows[1].timeline] == [2, 3, 1]
    assert [d.b_id for d in rows[1].duplicates] == [6]
    assert [t.kind for t in rows[1].tasks] == ["birth", "parents", "duplicate"]
    family = relations.family_details(ds.families, ds.enriched, ds.parent_children, ds.events, True).where("family_id = 1").first()
    assert [c.child_person_id for c in family.children] == [3, 4]
    assert [e.event_type for e in family.events] == ["marriage"]


def test_ancestors_with_cycle_and_collapse(spark):
    pairs = [(5, 3), (5, 4), (3, 1), (4, 1), (1, 5), (4, 2)]
    edges = spark.createDataFrame(pairs, "child_id long, parent_id long")
    roots = spark.createDataFrame([(5,), (2,)], "person_id long")
    found = ancestors.ancestors(roots, edges, 6)
    assert {(r.root_id, r.person_id, r.depth) for r in found.collect()} == {
        (5, 5, 0), (5, 3, 1), (5, 4, 1), (5, 1, 2), (5, 2, 2), (2, 2, 0)
    }
    sizes = {r.root_id: r.person_count for r in ancestors.tree_sizes(found, edges, 6).collect()}
    assert sizes == {5: 7, 2: 1}
    assert {r.root_id: r.n for r in ancestors.tree_nodes(found, edges, 6).groupBy("root_id").agg(F.count("*").alias("n")).collect()} == {5: 6}
    with pytest.raises(ValueError):
        ancestors.ancestors(roots, edges, 7)


def test_events_of_a_folder_are_made_on_demand(spark, monkeypatch):
    from stemma.plans import dataset, fixtures

    rows = {
        "customer": ([(1, 0), (2, 0), (3, 0)], "c_custkey long, c_nationkey int"),
        "nation": ([(0, "ALBA")], "n_nationkey int, n_name string"),
        "part": ([(k, "blue bolt", "Brand#1") for k in (1, 2, 3)], "p_partkey long, p_name string, p_brand string"),
        "supplier": ([(1, 0, "Sup")], "s_suppkey long, s_nationkey int, s_name string"),
        "orders": ([(5, 2, "1995-03-07", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string"),
    }
    tables = {name: spark.createDataFrame(data, ddl) for name, (data, ddl) in rows.items()}
    tables["orders"] = tables["orders"].selectExpr("* except (o_orderdate)", "cast(o_orderdate as date) as o_orderdate")
    written = []
    cut = dataset.cut_lineage
    monkeypatch.setattr(fixtures, "table", lambda spark, folder, name: tables[name])
    monkeypatch.setattr(dataset, "cut_lineage", lambda df: written.append(df) or cut(df))
    ds = dataset.from_fixtures(spark, "nowhere")
    assert ds.persons.count() == 3 and ds.families.count() == 2 and not written
    assert [(e.person_id, e.date_year, e.place) for e in ds.events.collect()] == [(3, 1995, "alba")]
    assert ds.events.count() == 1 and ds.places.count() == 1 and len(written) == 2


def test_pairs_of_a_data_set_are_not_written_again(ds, monkeypatch):
    from stemma.plans import dataset

    found = ds.persons.select("person_id", F.array(F.lit("noms similars")).alias("reasons"))
    again = dataset.Dataset(ds.persons, ds.families, ds.parent_children, ds.events, ds.places)
    again.__dict__["enriched"] = ds.persons
    monkeypatch.setattr(dataset, "duplicate_candidates", lambda *tables: found)
    monkeypatch.setattr(dataset, "cut_lineage", lambda df: pytest.fail("written"))
    assert again.candidates is found
