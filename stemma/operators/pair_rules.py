"""Rules that score a pair of persons, as Columns over the structs ``a`` and ``b``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.dates import is_valid
from stemma.functions.names import display_name, raw_similarity
from stemma.functions.numeric import exact_round
from stemma.functions.text import blank_to_null, fold, has_text, phonetic_key

# Weight of each rule, in the order in which rules are applied.
WEIGHTS = {
    "name": 0.35,
    "birth": 0.2,
    "death": 0.1,
    "parents": 0.1,
    "marriage": 0.1,
    "children": 0.1,
    "place": 0.05,
}
THRESHOLD = 0.55

# Scores and confidences of the rule outcomes.
SAME_YEAR, SAME_YEAR_SURE = 1.0, 0.9
OVERLAP, OVERLAP_SURE = 0.8, 0.7
NEXT_YEAR, NEXT_YEAR_SURE = 0.5, 0.5
PARENTS_SHARED, PARENTS_SHARED_SURE = 1.0, 0.95
PARENTS_DIFFER, PARENTS_DIFFER_SURE = 0.2, 0.4
MARRIAGE_SHARED, MARRIAGE_SHARED_SURE = 1.0, 0.9
MARRIAGE_DIFFER, MARRIAGE_DIFFER_SURE = 0.15, 0.3
CHILDREN_DIFFER, CHILDREN_DIFFER_SURE = 0.1, 0.3
PLACE_SAME, PLACE_SAME_SURE = 1.0, 0.9
PLACE_RELATED, PLACE_RELATED_SURE = 0.7, 0.6
NAME_HIGH, NAME_LOW = 0.6, 0.4

# Reasons given by the rules.
REASON_NAME = "noms similars"
REASON_BIRTH = ("mateix any de naixement", "períodes de naixement solapats", "anys propers")
REASON_DEATH = ("mateix any de defunció", "anys propers")
REASON_PARENTS = ("mateixes famílies paternals ", "famílies paternals diferents")
REASON_MARRIAGE = ("mateix matrimoni ", "matrimonis diferents")
REASON_CHILDREN = ("fills en comú: ", "fills diferents")
REASON_PLACE = ("mateix lloc de naixement", "llocs relacionats")


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter that stays above the columns it reads.

    A plain filter on a computed score is moved into the join below with the
    whole scoring expression copied into the join condition, so every pair
    would be scored several times. A generator is not moved.
    """
    one_or_none = F.when(condition, F.array(F.lit(True)))
    return df.withColumn("_kept", F.explode(one_or_none)).drop("_kept")


@dataclass(frozen=True)
class CustomRule:
    """A user rule: Columns over ``a`` and ``b`` and the highest score it can give.

    ``inputs`` names the person columns the rule reads.
    """

    name: str
    weight: float
    score: Callable[[Column, Column], Column]
    confidence: Callable[[Column, Column], Column]
    reason: Callable[[Column, Column], Column]
    inputs: tuple[str, ...] = ()
    ceiling: float = 1.0


@dataclass(frozen=True)
class Settings:
    """Threshold, weights and extra rules of a duplicate search."""

    threshold: float = THRESHOLD
    weights: tuple[tuple[str, float], ...] = ()
    use_place: bool = False
    custom: tuple[CustomRule, ...] = ()

    def weight(self, name: str) -> float:
        return {**WEIGHTS, **dict(self.weights)}.get(name, 0.0)

    @property
    def total_weight(self) -> float:
        return sum({**WEIGHTS, **dict(self.weights)}.values()) + sum(r.weight for r in self.custom)


FEATURES = ("gf", "gk", "sf", "sk", "has_g", "has_s", "by", "bs", "be", "dy", "fc", "fs", "ch", "pl")


def person_features(persons: DataFrame, settings: Settings) -> DataFrame:
    """What the rules need, once per person: ``(person_id, profile, f)``.

    ``profile`` spells out every value that decides the score against an
    unrelated person, so persons of one profile are interchangeable there.
    """
    extra = tuple(dict.fromkeys(c for rule in settings.custom for c in rule.inputs))
    place = fold(F.col("birth_place")) if settings.use_place else F.lit(None).cast("string")
    birth_known = has_text(F.col("birth_date")) & is_valid(F.col("birth"))
    death_known = has_text(F.col("death_date")) & is_valid(F.col("death"))
    folded = persons.select(
        "person_id",
        "xref",
        display_name(F.col("given_name"), F.col("surname"), F.col("xref")).alias("name"),
        F.coalesce(fold(F.col("given_name")), F.lit("")).alias("gf"),
        F.coalesce(fold(F.col("surname")), F.lit("")).alias("sf"),
        has_text(F.col("given_name")).alias("has_g"),
        has_text(F.col("surname")).alias("has_s"),
        F.when(birth_known, F.col("birth.year")).alias("by"),
        F.when(birth_known, F.col("birth.start_sort")).alias("bs"),
        F.when(birth_known, F.col("birth.end_sort")).alias("be"),
        F.when(death_known, F.col("death.year")).alias("dy"),
        F.col("has_parents").alias("fc"),
        F.col("has_family").alias("fs"),
        F.col("has_children").alias("ch"),
        blank_to_null(place).alias("pl"),
        *extra,
    )
    keyed = folded.withColumn("gk", phonetic_key(F.col("gf"))).withColumn("sk", phonetic_key(F.col("sf")))
    decisive = [c for c in (*FEATURES, *extra) if c not in ("gk", "sk")]
    profile = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in decisive])
    return keyed.select(
        "person_id", "xref", "name", profile.alias("profile"), F.struct(*FEATURES, *extra).alias("f")
    )


def _id_set(ids: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(ids.cast("array<string>"), ", "), F.lit("}"))


#: Rules that are told by the number of their outcome.
_CASES = ("birth", "death", "parents", "marriage", "children", "place")


def with_scores(pairs: DataFrame, settings: Settings, shared: str | None = None, both_ways: bool = False) -> DataFrame:
    """Add score, confidence, rules used and reasons to rows with feature structs ``a`` and ``b``.

    ``shared`` names a struct of the shared family and child ids
    ``(p, m, c)`` and child counts ``(n_first, n_second)``; without it the two
    persons share nothing. Only the name rule depends on who comes first;
    ``both_ways`` adds ``score_ba``, the score with ``b`` as first person.
    """
    return with_reasons(with_evidence(pairs, settings, shared, both_ways), settings)


def evidence_columns(rows: DataFrame) -> list[str]:
    """What :func:`with_evidence` leaves for :func:`with_reasons`, besides the scores."""
    return [c for c in rows.columns if c.startswith("_")]


def with_evidence(
    pairs: DataFrame, settings: Settings, shared: str | None = None, both_ways: bool = False,
    rounded: Callable[[Column, int], Column] = exact_round,
) -> DataFrame:
    """Add the score and, in columns that begin with ``_``, what the rules found.

    Few numbers, so rows are small until a pair is known to count. Where no
    plain filter on the scores follows, ``rounded`` may be the faster
    :func:`round_column`.
    """
    a, b = F.col("a"), F.col("b")
    nothing = F.lit(False)
    given = F.when(a["has_g"] & b["has_g"], raw_similarity(a["gf"], b["gf"], a["gk"], b["gk"])).otherwise(F.lit(0.0))
    surname = F.when(a["has_s"] & b["has_s"], raw_similarity(a["sf"], b["sf"], a["sk"], b["sk"])).otherwise(F.lit(0.0))
    known = a["by"].isNotNull() & b["by"].isNotNull()
    overlap = (a["bs"] <= b["be"]) & (b["bs"] <= a["be"])
    birth_case = (
        F.when(~known, F.lit(0))
        .when(a["by"] == b["by"], F.lit(1))
        .when(overlap, F.lit(2))
        .when(F.abs(a["by"] - b["by"]) <= 1, F.lit(3))
        .otherwise(F.lit(0))
    )
    death_gap = F.abs(a["dy"] - b["dy"])
    death_case = F.coalesce(F.when(death_gap == 0, F.lit(1)).when(death_gap <= 1, F.lit(2)), F.lit(0))

    # All that is read from the two structs is read at once, so that the steps that follow carry numbers only.
    read = {"_g_raw": given, "_s_raw": surname}
    read |= {f"_{side}_{part}": F.col(side)[part] for side in ("a", "b") for part in ("has_g", "has_s")}
    told: dict[str, Column] = {}
    if shared is None:
        p_shared, m_shared, c_shared = nothing, nothing, nothing
    else:
        x = F.col(shared)
        p_ids, m_ids, c_count = x["p"], x["m"], x["c"]
        p_shared, m_shared, c_shared = F.size(p_ids) > 0, F.size(m_ids) > 0, c_count > 0
        told = {
            "_parents_told": F.concat(F.lit(REASON_PARENTS[0]), _id_set(p_ids)),
            "_marriage_told": F.concat(F.lit(REASON_MARRIAGE[0]), _id_set(m_ids)),
            "_children_told": F.concat(F.lit(REASON_CHILDREN[0]), c_count.cast("string")),
        }
        read["_jaccard_raw"] = F.when(c_shared, c_count / (x["n_first"] + x["n_second"] - c_count)).otherwise(F.lit(0.0))
    parents_case = F.when(p_shared, F.lit(1)).when(a["fc"] & b["fc"], F.lit(2)).otherwise(F.lit(0))
    marriage_case = F.when(m_shared, F.lit(1)).when(a["fs"] & b["fs"], F.lit(2)).otherwise(F.lit(0))
    children_case = F.when(c_shared, F.lit(1)).when(a["ch"] & b["ch"], F.lit(2)).otherwise(F.lit(0))
    both_placed = a["pl"].isNotNull() & b["pl"].isNotNull()
    related = F.contains(a["pl"], b["pl"]) | F.contains(b["pl"], a["pl"])
    place_case = F.when(both_placed & (a["pl"] == b["pl"]), F.lit(1)).when(both_placed & related, F.lit(2)).otherwise(F.lit(0))

    cases = (birth_case, death_case, parents_case, marriage_case, children_case, place_case)
    columns = {f"_{rule}": case for rule, case in zip(_CASES, cases, strict=True)} | told
    for i, rule in enumerate(settings.custom):
        columns |= {f"_score_{i}": rule.score(a, b), f"_sure_{i}": rule.confidence(a, b), f"_reason_{i}": rule.reason(a, b)}
    staged = pairs.withColumns(read | columns)
    staged = staged.withColumns({"_g": rounded(F.col("_g_raw"), 2), "_s": rounded(F.col("_s_raw"), 2)})
    g, s = F.col("_g"), F.col("_s")

    def raw_name(side: str) -> Column:
        has_g, has_s = F.col(f"_{side}_has_g"), F.col(f"_{side}_has_s")
        low = F.least(F.when(has_g, g).otherwise(s), F.when(has_s, s).otherwise(g))
        score = F.lit(NAME_HIGH) * F.greatest(g, s) + F.lit(NAME_LOW) * low
        return F.when(has_g | has_s, score).otherwise(F.lit(0.0))

    names = {"_name": "a", "_name_ba": "b"} if both_ways else {"_name": "a"}
    staged = staged.withColumns({"_high": F.greatest(g, s)} | {f"{c}_raw": raw_name(side) for c, side in names.items()})
    last = {c: rounded(F.col(f"{c}_raw"), 2) for c in names}
    if shared is not None:
        last["_jaccard"] = rounded(F.col("_jaccard_raw"), 2)
    staged = staged.withColumns(last)
    columns |= last

    found = _results(settings, staged.columns)
    scores = {rule: score for rule, (score, _, _) in found.items()}
    ways = {"score": scores}
    if both_ways:
        ways["score_ba"] = {**scores, "name": F.col("_name_ba")}
    staged = staged.withColumns({f"_{way}_raw": _weighted(points, found, settings) for way, points in ways.items()})
    keep = ["_high", *[c for c in columns if c != "_name_ba"], *([F.col("_g").alias("_given")] if both_ways else [])]
    return staged.select(*pairs.columns, *keep, *[rounded(F.col(f"_{way}_raw"), 3).alias(way) for way in ways])


def with_reasons(rows: DataFrame, settings: Settings, rounded: Callable[[Column, int], Column] = exact_round) -> DataFrame:
    """The rows of :func:`with_evidence` with confidence, rules used and reasons in place of what was found."""
    found = _results(settings, rows.columns)
    sure = _weighted({rule: sure for rule, (_, sure, _) in found.items()}, found, settings)
    none = F.array().cast("array<string>")
    used = [F.when(score > 0, F.array(F.lit(rule))).otherwise(none) for rule, (score, _, _) in found.items()]
    reasons = [F.when((score > 0) & reason.isNotNull(), F.array(reason)).otherwise(none) for score, _, reason in found.values()]
    return rows.withColumn("_sure_raw", sure).select(
        *[c for c in rows.columns if not c.startswith("_")],
        rounded(F.col("_sure_raw"), 3).alias("confidence"),
        F.concat(*used).alias("rules_used"),
        F.concat(*reasons).alias("reasons"),
    )


def _results(settings: Settings, columns: list[str]) -> dict[str, tuple[Column, Column, Column]]:
    """Score, confidence and reason of every rule, in order, from what was found."""

    def table(rule: str, *outcomes: tuple) -> tuple[Column, Column, Column]:
        case = F.col(f"_{rule}")
        out = []
        for position, default in ((0, F.lit(0.0)), (1, F.lit(0.0)), (2, F.lit(None).cast("string"))):
            column = None
            for i, outcome in enumerate(outcomes, start=1):
                value = outcome[position]
                value = value if isinstance(value, Column) else F.lit(value)
                column = F.when(case == i, value) if column is None else column.when(case == i, value)
            out.append(column.otherwise(default))
        return tuple(out)

    told = lambda rule: F.col(f"_{rule}_told") if f"_{rule}_told" in columns else F.lit(None).cast("string")
    jaccard = F.col("_jaccard") if "_jaccard" in columns else F.lit(0.0)
    results = {
        "name": (F.col("_name"), F.col("_high"), F.lit(REASON_NAME)),
        "birth": table(
            "birth",
            (SAME_YEAR, SAME_YEAR_SURE, REASON_BIRTH[0]),
            (OVERLAP, OVERLAP_SURE, REASON_BIRTH[1]),
            (NEXT_YEAR, NEXT_YEAR_SURE, REASON_BIRTH[2]),
        ),
        "death": table(
            "death", (SAME_YEAR, SAME_YEAR_SURE, REASON_DEATH[0]), (NEXT_YEAR, NEXT_YEAR_SURE, REASON_DEATH[1])
        ),
        "parents": table(
            "parents",
            (PARENTS_SHARED, PARENTS_SHARED_SURE, told("parents")),
            (PARENTS_DIFFER, PARENTS_DIFFER_SURE, REASON_PARENTS[1]),
        ),
        "marriage": table(
            "marriage",
            (MARRIAGE_SHARED, MARRIAGE_SHARED_SURE, told("marriage")),
            (MARRIAGE_DIFFER, MARRIAGE_DIFFER_SURE, REASON_MARRIAGE[1]),
        ),
        "children": table(
            "children",
            (jaccard, jaccard, told("children")),
            (CHILDREN_DIFFER, CHILDREN_DIFFER_SURE, REASON_CHILDREN[1]),
        ),
        "place": table(
            "place", (PLACE_SAME, PLACE_SAME_SURE, REASON_PLACE[0]), (PLACE_RELATED, PLACE_RELATED_SURE, REASON_PLACE[1])
        ),
    }
    for i, rule in enumerate(settings.custom):
        results[rule.name] = (F.col(f"_score_{i}"), F.col(f"_sure_{i}"), F.col(f"_reason_{i}"))
    return results


def _weighted(points: dict[str, Column], found: dict[str, tuple[Column, Column, Column]], settings: Settings) -> Column:
    """Sum in rule order over the rules that count, divided by all weights; still to be rounded."""
    weights = {rule: settings.weight(rule) for rule in found} | {rule.name: rule.weight for rule in settings.custom}
    total = F.lit(0.0)
    for rule, point in points.items():
        counts = found[rule][0] > 0
        total = total + F.when(counts, F.lit(float(weights[rule])) * point).otherwise(F.lit(0.0))
    return (total / (float(settings.total_weight) or 1.0)).cast("double")
