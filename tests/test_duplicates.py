import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import duplicates, enrich
from stemma.operators.blocking import branches
from stemma.operators.pair_rules import CustomRule, Settings, person_features, with_scores
from stemma.session import cut_lineage

GIVEN = ["Joan", "Joana", "Maria", "María", "Josep", "Pere", "", None, "Anna Maria"]
SURNAME = ["Garcia", "García", "Garsia", "Puig", "Carbonell", "Carbonel", None]
PERSON = "person_id long, xref string, given_name string, surname string, sex string, birth_date string, death_date string"
EVENT = "event_id long, person_id long, event_type string, date_text string, date_year int, place string"


def sample(spark, seed, n=80):
    rng = random.Random(seed)
    births = lambda: rng.choice(
        [None, "unknown", str(rng.randrange(1890, 1894)), f"BET {rng.randrange(1885, 1895)} AND {rng.randrange(1885, 1899)}",
         f"BET {rng.randrange(1700, 1890)} AND 1900", f"{rng.randrange(1, 28)} MAR {rng.randrange(1890, 1893)}", "BET 1891 AND 999999"]
    )
    persons = [
        (i, f"I{i}", rng.choice(GIVEN), rng.choice(SURNAME), rng.choice(["M", "F", None]), births(), rng.choice([None, "1950", "1951", "AFT 1960"]))
        for i in range(1, n + 1)
    ]
    families = [(f, rng.choice([None, rng.randrange(1, n)]), rng.choice([None, rng.randrange(1, n)])) for f in range(1, 31)]
    kids = {(1, c) for c in rng.sample(range(1, n + 1), n // 3)}
    kids |= {(rng.randrange(2, 31), rng.randrange(1, n + 1)) for _ in range(n)}
    events = [
        (i, rng.randrange(1, n + 1), rng.choice(["birth", "death"]), None, 1890, rng.choice(["Vic", "Vic, Osona", "Osona", "so", "Olot"])) for i in range(60)
    ]
    families = spark.createDataFrame(families, "family_id long, father_id long, mother_id long")
    children = spark.createDataFrame([(f, c, 1) for f, c in sorted(kids)], "family_id long, child_id long, sibling_order int")
    people = enrich.enrich_persons(spark.createDataFrame(persons, PERSON), families, children, spark.createDataFrame(events, EVENT))
    return people.cache(), families, children


def all_pairs(people, families, children, settings):
    """Every pair scored, without any blocking."""
    features = person_features(people, settings)
    edges = duplicates.link_edges(families, children)
    member = F.struct("person_id", "xref", "name")
    a = features.select(F.col("person_id").alias("i"), member.alias("m1"), F.col("f").alias("a"))
    b = features.select(F.col("person_id").alias("j"), member.alias("m2"), F.col("f").alias("b"))
    pairs = a.crossJoin(b).where("i < j")
    shared = duplicates._shared_links(pairs.select("i", "j"), edges)
    sizes = edges.where("kind = 'c'").groupBy("person_id").agg(F.count("*").alias("n"))
    none = F.array().cast("array<bigint>")
    known = (
        pairs.join(shared, ["i", "j"], "left")
        .join(sizes.select(F.col("person_id").alias("i"), F.col("n").alias("n1")), "i", "left")
        .join(sizes.select(F.col("person_id").alias("j"), F.col("n").alias("n2")), "j", "left")
    )
    x = F.struct(
        F.coalesce("p", none).alias("p"), F.coalesce("m", none).alias("m"), F.coalesce("c", F.lit(0)).alias("c"),
        F.coalesce("n1", F.lit(0)).alias("n_first"), F.coalesce("n2", F.lit(0)).alias("n_second"),
    )
    scored = with_scores(known.select("i", "j", "a", "b", x.alias("x")), settings, shared="x")
    return scored.where(F.col("score") >= settings.threshold).select(
        F.col("i").alias("a_id"), F.col("j").alias("b_id"), "score", "confidence", "rules_used", "reasons"
    )


def as_set(df):
    columns = ("a_id", "b_id", "score", "confidence", "rules_used", "reasons")
    rows = df.select(*columns).collect()
    found = {(r.a_id, r.b_id, r.score, r.confidence, tuple(r.rules_used), tuple(r.reasons)) for r in rows}
    assert len(found) == len(rows)
    return found


SAME_SEX = CustomRule(
    "sex", 0.1, lambda a, b: (a["sex"] == b["sex"]).cast("double"), lambda a, b: F.lit(0.5), lambda a, b: F.lit("mateix sexe"), ("sex",)
)
CASES = [
    (1, Settings()),
    (2, Settings(threshold=0.47)),
    (3, Settings(use_place=True)),
    (4, Settings(threshold=0.62, weights=(("name", 0.5), ("death", 0.2)))),
    (5, Settings(custom=(SAME_SEX,))),
    (6, Settings(use_place=True, threshold=0.5, weights=(("place", 0.4), ("name", 0.6)))),
]


@pytest.mark.parametrize("seed,settings", CASES)
def test_search_equals_all_pairs(spark, seed, settings):
    people, families, children = sample(spark, seed)
    found = as_set(duplicates.duplicate_candidates(people, families, children, settings))
    expected = as_set(all_pairs(people, families, children, settings))
    assert expected and found == expected


def test_places_are_keys_where_names_need_not_agree():
    plan = [b for b in branches(Settings(use_place=True)) if b.links == 0]
    assert {b.place for b in plan} == {"same", "related", None}
    # By years alone no two persons meet: their places or a part of their names are in the key.
    assert all(b.place or b.by_token for b in plan)
    least = lambda place: min(b.least for b in plan if b.place == place and b.birth and b.death)
    assert (least("same"), least(None)) == (0.45, 0.59)


def test_focus_equals_filter(spark):
    people, families, children = sample(spark, 7)
    whole = as_set(duplicates.duplicate_candidates(people, families, children))
    wanted = {3, 8, 21, 40}
    focus = spark.createDataFrame([(i,) for i in wanted], "person_id long")
    part = as_set(duplicates.duplicate_candidates(people, families, children, focus=focus))
    assert part == {p for p in whole if p[0] in wanted or p[1] in wanted}


def test_refuses_weights_that_need_no_evidence():
    with pytest.raises(ValueError, match="no key finds them all"):
        branches(Settings(threshold=0.3))


def test_plan_has_no_product_and_no_python(spark):
    people, families, children = sample(spark, 9)
    features = person_features(people, Settings())
    plan = duplicates.profile_pairs(features)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "Python" not in plan


def test_pairs_of_profiles_are_numbers_only(spark):
    people, _, _ = sample(spark, 9)
    features = duplicates._numbered(person_features(people, Settings()))
    found = dict(duplicates.profile_pairs(features).dtypes)
    assert {"pa", "pb", "score", "score_ba"} <= set(found)
    assert set(found.values()) <= {"bigint", "int", "double"}


def test_profiles_meet_once_before_they_are_scored(spark, monkeypatch):
    people, _, _ = sample(spark, 9)
    features = cut_lineage(duplicates._numbered(cut_lineage(person_features(people, Settings()))))
    scored, score = [], duplicates.with_evidence
    monkeypatch.setattr(duplicates, "with_evidence", lambda pairs, *rest, **more: scored.append(pairs) or score(pairs, *rest, **more))
    found = duplicates.profile_pairs(features).select("pa", "pb").collect()
    assert found and len(set(found)) == len(found)
    met = scored[0].select("pa", "pb", F.col("by_surname").isNotNull().alias("by_surname")).collect()
    assert len(set(met)) == len(met)


def test_pair_search_runs_on_all_partitions(spark, monkeypatch):
    people, families, children = sample(spark, 5)

    class Found(Exception):
        pass

    def write(df):
        written = cut_lineage(df)
        if {"pa", "pb"} <= set(df.columns):
            raise Found(len(written.inputFiles()))
        return written

    monkeypatch.setattr(duplicates, "cut_lineage", write)
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(Found) as found:
        duplicates.duplicate_candidates(people, families, children)
    # Few rows would be merged into one task per branch.
    assert found.value.args[0] >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == merged


def test_profiles_in_focus_meet_once(spark, monkeypatch):
    people, _, _ = sample(spark, 9)
    features = cut_lineage(duplicates._numbered(cut_lineage(person_features(people, Settings()))))
    scored, score = [], duplicates.with_evidence
    monkeypatch.setattr(duplicates, "with_evidence", lambda pairs, *rest, **more: scored.append(pairs) or score(pairs, *rest, **more))
    some = features.where("person_id % 2 = 0")
    for focus in (features, some):
        duplicates.profile_pairs(features, focus=focus)
        met = scored[-1].select(F.least("pa", "pb"), F.greatest("pa", "pb"), F.col("by_surname").isNotNull()).collect()
        assert met and len(set(met)) == len(met)


def test_pairs_are_written_with_their_members(spark, monkeypatch):
    people, families, children = sample(spark, 5)

    class Found(Exception):
        pass

    def write(df):
        if {"pa", "pb"} <= set(df.columns):
            raise Found(df.columns)
        return cut_lineage(df)

    monkeypatch.setattr(duplicates, "cut_lineage", write)
    with pytest.raises(Found) as found:
        duplicates.duplicate_candidates(people, families, children)
    assert {"members_a", "members_b"} <= set(found.value.args[0])


def test_a_crowd_travels_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "CROWD", 4)
    rows = [(i, f"I{i}", "Joan", 1, ("joan",)) for i in range(1, 31)] + [(31, "I31", "Joana", 1, ("joan",))] * 2
    crowds = duplicates._crowds(spark.createDataFrame(rows, "person_id long, xref string, name string, profile long, f struct<gf: string>"))
    sizes = [len(r.members) for r in crowds.collect()]
    assert len(sizes) > 4 and sum(sizes) == 31
    side = lambda x: crowds.select(F.col("profile").alias(f"p{x}"), F.col("members").alias(f"members_{x}"))
    numbers = {"score": 0.6, "score_ba": 0.6, "_parents": 0, "_marriage": 0, "_children": 0}
    pairs = cut_lineage(side("a").crossJoin(side("b")).withColumns({c: F.lit(v) for c, v in numbers.items()}))
    spread = duplicates._spread(pairs, Settings())
    # Neither profiles nor persons are looked up for a pair.
    assert "Join" not in spread._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.i, r.j): r.n for r in spread.groupBy(F.col("m1.person_id").alias("i"), F.col("m2.person_id").alias("j")).agg(F.count("*").alias("n")).collect()}
    assert found == {(i, j): 1 + (j == 31) for i in range(1, 32) for j in range(i + 1, 32)}


def test_need_grows_where_a_person_has_no_relatives():
    settings = Settings()
    for branch in (b for b in branches(settings) if b.links == 0):
        needs = duplicates._all_needs(branch, settings)
        every = ("parents", "marriage", "children")
        assert {far: needs[(*far, ())] for far in branch.needs} == branch.needs
        assert all(needs.get((*far, every), 2.0) > value for far, value in branch.needs.items())


def pair(spark, a, b, settings=Settings()):
    """Scores of one pair of bare persons."""
    rows = [(1, "I1", *a), (2, "I2", *b)]
    persons = spark.createDataFrame(rows, PERSON)
    nobody = spark.createDataFrame([], "family_id long, father_id long, mother_id long")
    childless = spark.createDataFrame([], "family_id long, child_id long, sibling_order int")
    people = enrich.enrich_persons(persons, nobody, childless, spark.createDataFrame([], EVENT))
    f = person_features(people, settings)
    one = f.where("person_id = 1").select(F.col("f").alias("a"))
    two = f.where("person_id = 2").select(F.col("f").alias("b"))
    return with_scores(one.crossJoin(two), settings, both_ways=True).first()


def test_rule_goldens(spark):
    same = pair(spark, ("Joan", "Garcia", "M", "1893", None), ("JOAN", "García", "M", "10 JAN 1893", None))
    assert (same.score, same.rules_used) == (0.55, ["name", "birth"])
    assert same.reasons == ["noms similars", "mateix any de naixement"]
    near = pair(spark, ("Joan", "Garcia", "M", "1893", None), ("Joan", "Garcia", "M", "1894", None))
    assert near.score == 0.45
    lacking = pair(spark, (None, "Garcia", "M", "1893", None), ("Joan", "Garcia", "M", "1893", None))
    assert (lacking.score, lacking.score_ba) == (0.55, 0.41)


def test_groups_and_quick_decision(spark):
    rows = [(1, "I1", "Joan", "Garcia", None, "1893", None), (2, "I2", "JOAN", "García", None, "ABT 1893", None), (3, "I3", "Joan", "Garcia", None, "1900", None)]
    persons = spark.createDataFrame(rows, PERSON)
    groups = duplicates.duplicate_groups(persons).collect()
    assert [(g["key"], g["size"], g["reason"]) for g in groups] == [("joan garcia*garcia", 3, "nom similar (joan garcia*garcia)")]
    members = duplicates.group_members(persons, require_year=True).collect()
    assert sorted((m["key"], m["person_id"]) for m in members) == [("joan garcia*garcia*1893", 1), ("joan garcia*garcia*1893", 2)]
    two = persons.where("person_id = 1").select(F.struct("given_name", "surname").alias("a")).crossJoin(
        persons.where("person_id = 2").select(F.struct("given_name", "surname").alias("b"))
    )
    likely, message = duplicates.quick_decision("a", "b")
    assert tuple(two.select(likely, message).first()) == (True, "nom i cognom idèntics")
