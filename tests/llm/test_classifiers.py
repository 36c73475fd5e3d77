import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stemma.llm import quality_sites
from stemma.llm.labelled import fold, label_sample
from stemma.llm.quality_sites import fit_sites, good_rows, quality_scores
from stemma.llm.toxicity import FEATURES, _Weights, features, fit_toxicity, toxicity

WORDS = "the of and river mountain letter window garden paper music table yellow summer winter bread".split()
BAD = ["grumpo", "zlorkan", "zlorkish", "zlorkem"]


def documents(n=700):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        words = r.choices(WORDS, k=r.randrange(8, 200)) + [f"w{r.randrange(2000)}x" for _ in range(5)]
        toxic, junk = r.random() < 0.2, r.random() < 0.2
        if toxic:
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        text = " ".join(words).capitalize() + "."
        if junk:
            text = " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", f"src{i % 7}"))
        if r.random() < 0.7:
            labels.append((i, int(not junk), int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", "en", "src0"), (None, "the river", "de", "other"), (3, *docs[3][1:])]
    docs.append((n + 2, "word " * 40_000, "en", "src1"))
    labels += [(None, 1, 1), (5, None, None), (n + 50, 1, 0)]
    return docs, labels


@pytest.fixture(scope="module")
def data(spark):
    docs, labels = documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    frame = frame.selectExpr("*", "'x' as score", "1 as row", "'y' as features", "0 as good")
    return frame.repartition(4).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_folds_and_samples(spark, data):
    _, labels = data
    kept = {r.doc_id for r in label_sample(labels, "toxic").collect()}
    assert kept == {r.doc_id for r in labels.collect() if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert 20 < label_sample(labels, "toxic", rows=60).count() < 120
    twice = spark.createDataFrame([(0, 1), (0, 0), (0, 0), (2, 1), (2, 0)], "doc_id long, toxic int")
    assert {(r.doc_id, r.label) for r in label_sample(twice, "toxic").collect()} <= {(0, 0.0), (2, 1.0)}


def test_toxicity_on_held_out_rows(data):
    docs, labels = data
    rows = toxicity(docs, labels).select("row.doc_id", "score", (fold("row.doc_id") == 1).alias("held")).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score >= 0.7, truth[r.doc_id]) for r in rows if r.held and truth.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(held) > 100
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_without_two_classes(data):
    docs, labels = data
    clean = labels.where("toxic = 0")
    for some, rate in ((clean, 0.0), (labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0)):
        model = fit_toxicity(docs, some)
        assert model.trees is None and {r.score for r in model.score(docs).collect()} == {rate}


def test_toxic_features():
    weights = _Weights({"grumpo": 6.0, ".zlor": 5.0})
    f = lambda text: dict(zip(FEATURES, features(text, weights)))
    assert set(f("").values()) == {0.0}
    assert f("a Zlorkish day")["strongest"] == 5.0 and f("zlo grump")["strongest"] == 0.0
    assert f("you are a grumpo")["hits_near_second_person"] > 0
    assert f("you " + "and " * 9 + "grumpo")["hits_near_second_person"] == 0
    assert f("gr0mp gr*mpo")["masked"] == 0.5 and f("grump0 is gr-umpo")["masked"] > 0
    assert f("GRUMPO NOW")["shouted"] == 1.0 and f("sooo")["stretched"] == 1.0


def test_quality_on_held_out_rows(data):
    docs, labels = data
    rows = quality_scores(docs, labels).select("doc_id", "posterior", "good", "path_rate", "host_rate").collect()
    assert len(rows) == docs.count() and all(0 < r.posterior < 1 for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.good, truth[r.doc_id]) for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and truth.get(r.doc_id) is not None]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and len(held) > 100
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_posterior_equals_a_plain_recomputation(data):
    """Site rates, the document left out of its path, and the odds, all in plain Python from the classifier's scores."""
    docs, labels = data
    model = fit_sites(docs, labels)
    kept = {r.doc_id: r.label for r in label_sample(labels, "quality", None).collect()}
    rows = quality_scores(docs, labels).collect()
    told = [kept.get(r.doc_id, r.document_score) for r in rows]
    sums = {}
    for r, q in zip(rows, told):
        for site in ((), (r.host,), (r.host, r.path)):
            good, n = sums.get(site, (0.0, 0))
            sums[site] = (good + q, n + 1)
    whole = sums[()][0] / sums[()][1]
    clip = lambda p: min(max(p, quality_sites.CLIP), 1 - quality_sites.CLIP)
    logit = lambda p: math.log(clip(p) / (1 - clip(p)))
    k, m = model.host_strength, model.path_strength
    for r, q in zip(rows, told):
        good, n = sums[(r.host,)]
        host = (good + whole * k) / (n + k)
        good, n = sums[(r.host, r.path)]
        path = min((max(good - q, 0.0) + host * m) / (n - 1 + m), 1.0)
        assert (r.host_rate, r.path_rate) == (pytest.approx(host), pytest.approx(path))
        odds = logit(r.document_score) - logit(model.base_rate) + logit(path)
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-odds))) and r.good == (r.posterior >= 0.3)


def test_good_rows_keeps_every_row_that_is_good(data):
    docs, labels = data
    scores = quality_scores(docs, labels)
    kept = good_rows(docs, scores)
    assert kept.columns == docs.columns
    want = Counter(r.doc_id for r in scores.where("good").collect())
    assert Counter(r.doc_id for r in kept.collect()) == want and want[3] == 2


def test_quality_without_two_classes(data):
    docs, labels = data
    assert quality_scores(docs, labels.limit(0)).where("not good").count() == 0
    assert quality_scores(docs, labels.where("quality = 1")).where("not good").count() == 0


def test_sparse_sites_shrink_towards_what_is_above(spark, monkeypatch):
    """Rates by the same formulas in plain Python, from labels alone (every document labelled, no classifier)."""
    rows = [(i, "t", "p", "big") for i in range(200)] + [(1000 + i, "t", "p", "bad") for i in range(150)]
    rows += [(5000 + i, "t", f"p{i}", "few") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    quality = lambda i: int(i < 1000 or 5000 <= i)
    monkeypatch.setattr(quality_sites, "label_sample", lambda labels, column, rows: labels.select("doc_id", F.col(column).cast("double").alias("label")))
    labels = spark.createDataFrame([(r[0], quality(r[0])) for r in rows], "doc_id long, quality int")
    model = fit_sites(docs, labels)
    assert model.global_rate == pytest.approx(203 / 353)
    rate = {r.host: r.host_rate for r in model.hosts.collect()}
    k = model.host_strength
    assert rate["big"] == pytest.approx((200 + k * 203 / 353) / (200 + k))
    assert rate["bad"] < 0.1 < rate["few"] < rate["big"]
    assert abs(rate["few"] - 203 / 353) < abs(1 - 203 / 353)


def test_sites_count_all_labels_beyond_the_sample_of_the_fit(spark):
    """Texts that tell nothing, hosts that tell all: the labels of 20 rows fit the classifier, all others count too."""
    docs = [(i, f"river letter {i}", "en", "bad" if i % 2 else "fine") for i in range(1000, 1600)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], 1 - r[0] % 2) for r in docs], "doc_id long, quality int")
    model = fit_sites(frame, labels, rows=20)
    held = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    scored = quality_scores(frame, labels, rows=20).select("doc_id", F.col("host").alias("source"), "document_score", "good").collect()
    p = {r.doc_id: r.document_score for r in scored}
    assert 0.2 < min(p.values()) and max(p.values()) < 0.8
    good = {r.host: r.good for r in model.paths.collect()}
    assert good["bad"] == pytest.approx(sum(p[i] for i in held if i % 2))
    assert good["fine"] == pytest.approx(300 - sum(1 - p[i] for i in held if not i % 2))
    assert {(r.source, r.good) for r in scored} == {("bad", False), ("fine", True)}


def test_capitals_and_masked_words_take_no_step_per_character():
    import random
    import re

    from stemma.llm import toxicity

    slow = re.compile(r"[^\W\d_]+[0-9@$*#!|.\-]+[^\W\d_]+[\w@$*]*")
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("aAbéÉßΩ1_.*@- \n$x9|") for _ in range(rng.randrange(16)))
        assert toxicity.capitals_in(text) == sum(map(str.isupper, text))
        assert toxicity.MASKED.findall(text) == slow.findall(text)
