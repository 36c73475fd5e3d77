import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemma.functions import labels, names, places, text
from stemma.functions.numeric import exact_round


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def many(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_soundex(spark):
    words = ["Garcia", "Robert", "Smith", "Smyth", "Ashcraft", "Ñuñez", "123", "", None]
    assert many(spark, words, text.soundex) == ["G620", "R163", "S530", "S530", "A226", "N520", None, None, None]


def test_phonetic_key(spark):
    assert many(spark, ["Carbonell", "Carbonel", "", "12", "Pérez Pla"], text.phonetic_key) == ["C615", "C615", "", "", "P621"]


def test_surname_and_place(spark):
    assert many(spark, ["DE LA CRUZ", "o'hara", "-", None], text.title_surname) == ["De La Cruz", "O Hara", None, None]
    assert one(spark, "  Barcelona  ,", text.place_key) == "barcelona"
    assert many(spark, ["Lleida", "LLEIDA ", "Á", "", " , "], text.place_key) == ["lleida", "lleida", "á", None, None]
    assert one(spark, "joan  PERE 2n", text.title_given) == "Joan Pere 2n"


def test_slug(spark):
    assert many(spark, ["Joan Miró", "¡¿", "a" * 200], text.slug) == ["joan-miro", None, "a" * 120]


def test_names(spark):
    df = spark.createDataFrame([("josep", "Miró", "I1"), (None, None, "I2"), ("9x", "Pla", "I3")], "g string, s string, x string")
    rows = df.select(
        names.display_name(F.col("g"), F.col("s"), F.col("x")).alias("d"), names.initials(F.col("g"), F.col("s")).alias("i"),
        names.name_slug(F.col("g"), F.col("s")).alias("l"),
    ).collect()
    assert [tuple(r) for r in rows] == [("josep Miró", "J. M.", "josep-miro"), ("I2", "", ""), ("9x Pla", "P.", "9x-pla")]


def test_place_tokens(spark):
    assert one(spark, "Sant Feliu de la Móra", places.place_tokens) == ["sant", "feliu", "mora"]
    assert one(spark, "La Móra", places.place_canonical) == "la-mora"


def test_labels(spark):
    assert many(spark, ["M", "F", None, "X"], labels.sex_label) == ["Home", "Dona", "Desconegut", "X"]
    assert many(spark, ["birth", "first_job_x", None], labels.event_label) == ["Naixement", "first job_x", "Esdeveniment"]
    assert many(spark, [0.8, 0.61, 0.4, 0.1, None], labels.quality_label, "double") == ["Excel·lent", "Bona", "Regular", "Baixa", "—"]
    assert many(spark, [0.555, None], labels.percent, "double") == ["56%", "—"]


def plain(value: str) -> str:
    kept = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return kept.lower().strip()


alphabet = st.characters(codec="utf-8", categories=("Lu", "Ll", "Nd", "Zs", "Mn", "Po"), max_codepoint=0x24FF)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet, max_size=12), min_size=40, max_size=80))
def test_fold_equals_unicode_rule(spark, values):
    assert many(spark, values, text.fold) == [plain(v) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 40)), min_size=60, max_size=120))
def test_exact_round_equals_python(spark, pairs):
    values = [min(1.0, a / b) for a, b in pairs] + [0.575, 0.125, 0.375, 0.545, 0.005, 2.675]
    assert many(spark, values, lambda x: exact_round(x, 2), "double") == [round(v, 2) for v in values]
    assert many(spark, values, lambda x: exact_round(x, 3), "double") == [round(v, 3) for v in values]


def _plain(value):
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


def _signs():
    return (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)


def test_every_sign_that_decomposes(spark):
    signs = [c for c in _signs() if _plain(c) != c]
    texts = [f"a{c}b" for c in signs] + ["ﾊﾛ", "한국 각", "Straße Ångström ½", "𝔄𝔟 ①", "é\U0001d165", "x" * 5000 + "é" * 5000]
    assert len(signs) > 17_000
    assert many(spark, texts, text.remove_accents) == [_plain(t) for t in texts]


def test_every_sign_that_case_folds(spark):
    signs = [c for c in _signs() if c.casefold() != c]
    texts = [f"a{c}b" for c in signs] + ["Straße", "STRASSE", "ΟΔΟΣ", "ὈΔΥΣΣΕΎΣ", "İstanbul", "ŉ ǰ ﬄ", "plain"]
    assert many(spark, texts, text.casefold) == [t.casefold() for t in texts]


def test_keys_fold_case(spark):
    assert many(spark, ["Straße", "STRASSE", "straße "], text.place_key) == ["strasse"] * 3
    assert many(spark, ["Weiß", "WEISS", "Παπάς", "ΠΑΠΆΣ"], text.name_key) == ["weiss", "weiss", "παπάσ", "παπάσ"]


def test_phonetic_key_of_letters_without_a_class(spark):
    assert many(spark, ["Großmann", "Weiß", "Weiss", "ßab", "ñ한"], text.phonetic_key) == ["G655", "W000", "W200", "SS10", "N000"]


def test_all_white_space_is_stripped(spark):
    spaces = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    assert text.WHITESPACE == spaces
    assert one(spark, f"{spaces}a{spaces}b{spaces}", text.strip) == f"a{spaces}b"
    assert one(spark, f"a{spaces}b", text.collapse_spaces) == "a b"
