import random

import pytest
from pyspark.sql import functions as F

from stemma.functions.names import name_similarity
from stemma.functions.places import STOPWORDS
from stemma.functions.text import phonetic_key
from stemma.operators import blocks, variants


def distance(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("least", [0.56, 0.6, 0.75, 0.9])
def test_similar_texts_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 13))) for _ in range(250)} | {"x" * n for n in range(1, 30)}
    df = spark.createDataFrame([(w,) for w in words], "text string")
    got = {(r.a, r.b) for r in variants.similar_texts(df, least).collect()}
    expected = {
        (a, b) for a in words for b in words
        if a != b and round(1 - distance(a, b) / max(len(a), len(b)), 2) >= least
    }
    assert got == expected


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8, 1.0])
def test_place_similarity_equals_all_pairs(spark, least):
    rng = random.Random(3)
    words = ["vic", "olot", "la", "de", "santa", "coloma", "ter", "nord", "vall", "mar"]
    names = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))).title() for _ in range(120)}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    tokens = {n: {w for w in n.lower().split() if w not in STOPWORDS} for n in names}
    got = {(r.a, r.b): r.similarity for r in variants.place_similarity_join(df, least).collect()}
    expected = {}
    for a in names:
        for b in names:
            x, y = tokens[a], tokens[b]
            if a < b and x and y:
                score = round(len(x & y) / len(x | y), 2)
                if score >= least:
                    expected[(a, b)] = score
    assert got == expected
    inside = {(r.outer, r.inner) for r in variants.place_containment_join(df).collect()}
    assert inside == {(a, b) for a in names for b in names if a != b and tokens[b] and tokens[b] <= tokens[a]}


def test_variant_groups(spark):
    df = spark.createDataFrame([("Cataluña",), ("Cataluna",), ("Barcelona",), ("CATALUÑA ",)], "name string")
    groups = variants.place_variant_groups(df).collect()
    assert [(g.canonical, g.variants) for g in groups] == [("CATALUÑA ", ["CATALUÑA ", "Cataluna", "Cataluña"])]
    rows = variants.variant_rows(df, "name").collect()
    assert {(r.raw, r.canonical, r.n_variants) for r in rows} == {(v, "CATALUÑA ", 3) for v in ("CATALUÑA ", "Cataluna", "Cataluña")}
    named = variants.name_variant_groups(df, "name").collect()
    assert [(g.original, g.alternatives) for g in named] == [("CATALUÑA ", ["Cataluna", "Cataluña"])]


def test_known_variants(spark):
    df = spark.createDataFrame([("José",), ("Joan",), ("Anna",)], "name string")
    got = [r.known_variants for r in variants.known_variants(df, "name").collect()]
    assert got == [["josep", "josé"], ["juan"], []]


def test_is_variant(spark):
    df = spark.createDataFrame([("Lleida", "LLEIDA"), ("", ""), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(variants.is_variant(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def distance_of(a, b):
    return round(1 - distance(a, b) / max(len(a), len(b)), 2)


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_low_similarities_equal_all_pairs_too(spark, least):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 11))) for _ in range(50)}
    words |= {"".join(rng.choice("ab") for _ in range(n)) for n in (18, 63, 65, 66, 90)}
    df = spark.createDataFrame([(w,) for w in words], "text string")
    got = {(r.a, r.b) for r in variants.similar_texts(df, least).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and distance_of(a, b) >= least}


def test_names_below_the_phonetic_similarity(spark):
    names = ["Garcia", "Garsia", "Puig", "Puch", "Pere", "Serra", "Sierra", "Gracia", "Anna"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for least in (0.35, 0.55, 0.7):
        got = {(r.a, r.b): r.similarity for r in variants.name_similarity_join(df, least).collect()}
        every = df.selectExpr("lower(name) as a").crossJoin(df.selectExpr("lower(name) as b")).where("a < b")
        scored = every.select("a", "b", name_similarity(F.col("a"), F.col("b"), phonetic_key(F.col("a")), phonetic_key(F.col("b"))).alias("s"))
        assert got == {(r.a, r.b): r.s for r in scored.collect() if r.s >= least}


def test_a_hot_block_is_many_cells(spark):
    rows = [("hot", i) for i in range(400)] + [("b", i) for i in range(3)] + [("c", 1), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "key string, item long")
    got = {tuple(r) for r in blocks.pairs_in_blocks(df, "key", "item", part=30).collect()}
    assert got == {(k, i, j) for k, n in (("hot", 400), ("b", 3)) for i in range(n) for j in range(i + 1, n)}
    left = df.withColumnRenamed("item", "x")
    right = spark.createDataFrame([("hot", i) for i in range(50)] + [("c", 7), (None, 3)], "key string, y long")
    plain = sorted(tuple(r) for r in left.join(right, "key").collect())
    for cell in (1000, 1 << 20):
        assert sorted(tuple(r) for r in blocks.split_join(left, right, ["key"], cell).collect()) == plain
