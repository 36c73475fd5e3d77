"""Document quality by hierarchical empirical Bayes.

Evidence on a document comes from a logistic classifier over its whole text.
Evidence on where it comes from is gathered over the corpus: every document
adds its label, or the classifier's probability where it has none, to its host
and to its path (here the source and, within it, the language). A host's rate
of good documents is a beta posterior under the global prior, a path's one
under its host's rate; the strength of both priors comes from the spread of
the rates over hosts and paths, so sparse sites shrink towards what is above
them. The posterior odds of a document are its own evidence times the odds of
its path, with the document itself left out of that path.

Every text is read by the classifier once, into a narrow table (id, site,
hash, probability). Labels, sites and posteriors are joined to that, never to
texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.labelled import TRAIN_ROWS, label_sample, labelled_texts
from stemma.llm.tables import text_or_empty, whole_row
from stemma.session import cut_lineage

SIGN = re.compile(r"[^\w\s]")
DIGIT = re.compile(r"\d")
#: A document below this posterior of being good is rejected.
THRESHOLD = 0.3
#: Limits of a prior's strength, in documents, and of a classifier's probability.
STRENGTH = (1.0, 10_000.0)
CLIP = 1e-4

FEATURES = (
    "upper_words", "signs", "sign_words", "lone_signs", "exclamations", "digits", "repeated", "longest_run",
    "distinct", "entropy", "line_repeats", "word_length", "words", "short",
)


def features(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES; an empty text is the shortest there is."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    same = np.fromiter((a == b for a, b in zip(lower, lower[1:])), bool, max(len(words) - 1, 0))
    breaks = np.concatenate([[-1], np.nonzero(~same)[0], [len(same)]])
    shares = np.fromiter(counts.values(), float, len(counts)) / n
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    signs = len(SIGN.findall(text))
    tail = sum(1 for w in words if len(w) > 3 and not w[-1].isalnum() and w[-1] == w[-2])
    return [
        sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
        math.log1p(signs / n),
        tail / n,
        sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n,
        math.log1p(text.count("!") / n),
        len(DIGIT.findall(text)) / chars,
        float(same.sum()) / n,
        math.log1p(float(np.diff(breaks).max(initial=0))),
        len(counts) / n**0.8,
        float(-(shares * np.log(np.maximum(shares, 1e-12))).sum()) / math.log(n + 1),
        1 - len(set(lines)) / max(len(lines), 1),
        min(chars / n, 40.0) / 10,
        math.log1p(len(words)),
        float(len(words) < 5),
    ]


def feature_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t) for t in batch])

    return extract(text)


def _logit(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(bounded / (1 - bounded))


def _strength(groups: DataFrame, total: Column, number: Column, above: Column) -> float:
    """How many documents a prior counts for, by moments: large if the rates differ as chance would have them."""
    rate = total / number
    row = groups.agg(
        F.sum(number * (rate - above) ** 2).alias("spread"),
        F.sum(above * (1 - above)).alias("chance"),
        F.sum(number * above * (1 - above)).alias("whole"),
        F.sum(F.lit(1)).alias("groups"),
    ).first()
    if not row["groups"] or not row["whole"]:
        return STRENGTH[1]
    # spread = chance + (whole - chance) / (strength + 1), in expectation
    between = max((row["spread"] - row["chance"]) / max(row["whole"] - row["chance"], 1e-9), 1e-9)
    return float(min(max(1 / between - 1, STRENGTH[0]), STRENGTH[1]))


@dataclass
class SiteModel:
    """The classifier, what it says of each document, the rates of hosts and paths, and the strength of the priors."""

    classifier: LogisticRegressionModel | None
    scored: DataFrame
    base_rate: float
    hosts: DataFrame
    paths: DataFrame
    global_rate: float
    host_strength: float
    path_strength: float


def _site(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def row_sha256(text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> Column:
    """SHA-256 of all that a verdict depends on besides the id: host, path and text."""
    parts = [F.concat(F.length(_site(c)).cast("string"), F.lit(":"), _site(c)) for c in (host_col, path_col)]
    return F.sha2(F.concat(*parts, text_or_empty(f"`{text_col}`")).cast("binary"), 256)


def _evidence(
    docs: DataFrame, classifier: LogisticRegressionModel | None, base: float, text_col: str, host_col: str, path_col: str
) -> DataFrame:
    """(doc_id, host, path, row_sha256, p): the classifier's probability that the row's text is good."""
    names = ["doc_id", "host", "path", "row_sha256"]
    rows = docs.select(
        F.col("doc_id"),
        _site(host_col).alias("host"),
        _site(path_col).alias("path"),
        row_sha256(text_col, host_col, path_col).alias("row_sha256"),
        text_or_empty(f"`{text_col}`").alias("text"),
    )
    if classifier is None:
        return rows.select(*names, F.lit(base).alias("p"))
    dense = rows.select(*names, array_to_vector(feature_column(F.col("text"))).alias("features"))
    return classifier.transform(dense).select(*names, vector_to_array("probability")[1].alias("p"))


def fit_sites(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    rows: int = TRAIN_ROWS,
) -> SiteModel:
    """Fit the classifier on at most ``rows`` labelled documents, and gather sites over all documents and labels."""
    train = cut_lineage(
        labelled_texts(docs, labels, "quality", text_or_empty(text_col), rows)
        .select("label", feature_column(F.col("text")).alias("f"))
    )
    seen = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    base = seen.get(1.0, 0) / sum(seen.values()) if seen else 1.0
    classifier = None
    if seen.get(0.0) and seen.get(1.0):
        dense = train.select("label", array_to_vector("f").alias("features"))
        classifier = LogisticRegression(regParam=1e-4, maxIter=50).fit(dense)
    # All labels outside the held-out fold count for sites, not the classifier's sample alone.
    scored = cut_lineage(
        _evidence(docs, classifier, base, text_col, host_col, path_col).join(
            label_sample(labels, "quality", None), "doc_id", "left"
        )
    )
    told = F.coalesce("label", "p")
    paths = cut_lineage(scored.groupBy("host", "path").agg(F.sum(told).alias("good"), F.count(F.lit(1)).alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = whole["good"] / whole["n"] if whole["n"] else base
    host_strength = _strength(hosts, F.col("host_good"), F.col("host_n"), F.lit(rate))
    hosts = cut_lineage(
        hosts.withColumn("host_rate", (F.col("host_good") + rate * host_strength) / (F.col("host_n") + host_strength))
    )
    inside = paths.join(hosts.select("host", "host_rate"), "host")
    path_strength = _strength(inside, F.col("good"), F.col("n"), F.col("host_rate"))
    return SiteModel(classifier, scored, base, hosts, paths, rate, host_strength, path_strength)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = THRESHOLD,
    rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(doc_id, host, path, row_sha256, document_score, host_rate, path_rate, posterior, good) for every row of ``docs``.

    Whole texts count; a null text is an empty one, a null host or path the
    empty one. Repeated rows get equal scores. With labels of one class or
    none, the classifier gives every document the share of good labels (1
    without labels) and only the sites speak. An empty table gives an empty
    result. ``good`` is false where the posterior is below ``threshold``.
    Extra columns are ignored. `good_rows` keeps the rows that are good.
    """
    model = fit_sites(docs, labels, text_col, host_col, path_col, rows)
    base = min(max(model.base_rate, CLIP), 1 - CLIP)
    sites = model.paths.join(model.hosts.select("host", "host_rate"), "host")
    scored = model.scored.join(sites.withColumnRenamed("good", "_good"), ["host", "path"])
    # What the document itself added is taken out of its path before the path speaks for it.
    added = F.coalesce("label", "p")
    others = F.greatest(F.col("_good") - added, F.lit(0.0)) + F.col("host_rate") * model.path_strength
    path_rate = F.least(others / (F.greatest(F.col("n") - 1, F.lit(0)) + model.path_strength), F.lit(1.0))
    odds = _logit(F.col("p")) - math.log(base / (1 - base)) + _logit(F.col("path_rate"))
    return (
        scored.withColumn("path_rate", path_rate)
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .select(
            "doc_id",
            "host",
            "path",
            "row_sha256",
            F.col("p").alias("document_score"),
            "host_rate",
            "path_rate",
            "posterior",
            (F.col("posterior") >= threshold).alias("good"),
        )
    )


def good_rows(docs: DataFrame, scores: DataFrame, text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``scores`` calls good, repeated ones as often as they are there.

    Rows with one id and one hash have one verdict, so a semi-join on both
    finds them; null ids match null ids.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("key")
    marked = docs.select(whole_row(docs), named, row_sha256(text_col, host_col, path_col).alias("sha"))
    wanted = scores.where("good").select(named, F.col("row_sha256").alias("sha"))
    return marked.join(wanted, ["key", "sha"], "left_semi").select("row.*")
