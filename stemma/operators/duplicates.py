"""Duplicate persons: candidate pairs, groups and quick decisions.

The pair search never compares all persons. Persons with the same deciding
values are folded into one profile, profiles meet through join keys made of
years and similar names (see :mod:`stemma.operators.blocking`), and pairs that
share relatives meet through those relatives. Scores of profile pairs hold for
every pair of their members that shares no relative.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.names import edit_similarity, folded_name
from stemma.functions.numeric import exact_round, round_column
from stemma.functions.text import fold, has_text
from stemma.operators import pair_rules as R
from stemma.operators.blocking import APART, Branch, branches, dictionary_least, needs_lacking, other_part
from stemma.operators.blocks import split_join
from stemma.operators.enrich import child_edges, parent_edges, spouse_edges
from stemma.operators.keys import dense_ids
from stemma.operators.pair_rules import (
    Settings,
    evidence_columns,
    keep_where,
    person_features,
    with_evidence,
    with_reasons,
)
from stemma.operators.variants import similar_texts
from stemma.session import all_partitions, compile_small_methods, cut_lineage

DEFAULT = Settings()

# Birth periods up to this many years are keyed by year, longer ones by bucket.
NARROW_YEARS = 32
# Buckets end here; later years share the last one and are told apart by the score.
LAST_YEAR = 10000
_FINE, _WIDE_BUILD, _WIDE_PROBE = 0, 1, 2
# Members of a profile that travel in one row; a larger crowd is dealt to several rows.
CROWD = 32


def link_edges(families: DataFrame, parent_children: DataFrame) -> DataFrame:
    """``(person_id, kind, link_id)``: family as child ``p``, own family ``m``, child ``c``."""
    as_child = child_edges(parent_children).select("person_id", F.lit("p").alias("kind"), F.col("family_id").alias("link_id"))
    as_spouse = spouse_edges(families).select("person_id", F.lit("m").alias("kind"), F.col("family_id").alias("link_id"))
    children = parent_edges(families, parent_children).select(
        "person_id", F.lit("c").alias("kind"), F.col("child_id").alias("link_id")
    )
    return as_child.unionByName(as_spouse).dropDuplicates().unionByName(children)


# --------------------------------------------------------------------- keys


def _period(f: Column) -> tuple[Column, Column, Column]:
    end = F.floor(f["be"] / 10000).cast("int")
    low, high = F.least(f["by"], end), F.greatest(f["by"], end)
    return low, high, (high - low) > NARROW_YEARS


def _buckets(low: Column, high: Column) -> Column:
    clamp = lambda y: F.least(F.greatest(y, F.lit(0)), F.lit(LAST_YEAR))
    return F.sequence(F.floor(clamp(low) / NARROW_YEARS).cast("int"), F.floor(clamp(high) / NARROW_YEARS).cast("int"))


def _entry(space: int, bucket: Column, far: Column) -> Column:
    return F.struct(F.lit(space).alias("space"), bucket.alias("bucket"), far.cast("int").alias("far"))


def _probe_births(f: Column) -> Column:
    """Years and buckets where a person looks for partners, one year beyond the period."""
    low, high, wide = _period(f)
    near = F.lit(0)
    years = F.transform(
        F.when(wide, F.array().cast("array<int>")).otherwise(F.sequence(low - 1, high + 1)),
        lambda y: _entry(_FINE, y, y != f["by"]),
    )
    coarse = _buckets(low - 1, high + 1)
    return F.when(wide, F.transform(coarse, lambda b: _entry(_WIDE_PROBE, b, near))).otherwise(
        F.concat(years, F.transform(coarse, lambda b: _entry(_WIDE_BUILD, b, near)))
    )


def _build_births(f: Column) -> Column:
    """Years and buckets where a person can be found."""
    low, high, wide = _period(f)
    near = F.lit(0)
    coarse = _buckets(low, high)
    years = F.transform(
        F.when(wide, F.array().cast("array<int>")).otherwise(F.sequence(low, high)), lambda y: _entry(_FINE, y, near)
    )
    to_wide = F.transform(coarse, lambda b: _entry(_WIDE_PROBE, b, near))
    from_narrow = F.transform(coarse, lambda b: _entry(_WIDE_BUILD, b, near))
    return F.when(wide, F.concat(to_wide, from_narrow)).otherwise(F.concat(years, to_wide))


def _with_births(rows: DataFrame, side: str, probe: bool) -> DataFrame:
    f = F.col(side)
    known = rows.where(f["by"].isNotNull())
    keyed = known.withColumn("_e", F.explode(_probe_births(f) if probe else _build_births(f)))
    return keyed.select(
        *rows.columns,
        F.col("_e.space").alias("k_space"),
        F.col("_e.bucket").alias("k_birth"),
        *([F.col("_e.far").alias("far_birth")] if probe else []),
    )


def _with_deaths(rows: DataFrame, side: str, probe: bool, reach: bool) -> DataFrame:
    year = F.col(side)["dy"]
    known = rows.where(year.isNotNull())
    if not probe:
        return known.withColumn("k_death", year)
    steps = [(0, 0), (-1, 1), (1, 1)] if reach else [(0, 0)]
    around = F.array(
        *[F.struct((year + F.lit(step)).alias("y"), F.lit(far).alias("far")) for step, far in steps]
    )
    keyed = known.withColumn("_e", F.explode(around))
    return keyed.select(*rows.columns, F.col("_e.y").alias("k_death"), F.col("_e.far").alias("far_death"))


#: The feature that says whether a person has the relatives a rule is about.
_HAS = {"parents": "fc", "marriage": "fs", "children": "ch"}


def _all_needs(branch: Branch, settings: Settings) -> dict[tuple, float]:
    """Least name score by (birth far, death far) and the rules about relatives that give a probe row nothing.

    Where a relative is the key, the rule about it gives all it has, so no rule is taken to lack.
    """
    sets = [s for n in range(len(APART) + 1) for s in combinations(APART, n)] if branch.links == 0 else [()]
    return {(*far, s): value for s in sets for far, value in needs_lacking(settings, branch, s).items()}


def _with_need(rows: DataFrame, branch: Branch, settings: Settings) -> DataFrame:
    """Least name score of each probe row; rows that cannot succeed drop out."""
    far_birth = F.col("far_birth") if branch.birth else F.lit(0)
    far_death = F.col("far_death") if branch.death else F.lit(0)
    needs = _all_needs(branch, settings)
    at = far_birth * 2 + far_death
    rules = tuple(APART) if branch.links == 0 else ()
    for rule in rules:
        at = at * 2 + F.when(F.col("a")[_HAS[rule]], F.lit(0)).otherwise(F.lit(1))
    known = []
    for i in range(4 << len(rules)):
        bits = [(i >> k) & 1 for k in reversed(range(2 + len(rules)))]
        lacking = tuple(rule for rule, bit in zip(rules, bits[2:], strict=True) if bit)
        known.append(F.lit(needs.get((bits[0], bits[1], lacking))).cast("double"))
    need = F.element_at(F.array(*known), (at + 1).cast("int"))
    return rows.withColumn("need", need).where("need is not null").drop("far_birth", "far_death")


def _name_parts(side: str) -> Column:
    f = F.col(side)
    return F.array_compact(
        F.array(
            F.when(f["gf"] != "", F.struct(F.lit("g").alias("part"), f["gf"].alias("text"))),
            F.when(f["sf"] != "", F.struct(F.lit("s").alias("part"), f["sf"].alias("text"))),
        )
    )


def _lacking(side: str) -> Column:
    return ~(F.col(side)["has_g"] & F.col(side)["has_s"])


def _meet(
    probe: DataFrame, build: DataFrame, keys: list[str], branch: Branch, settings: Settings, dictionary: DataFrame | None,
    sought: Column | None,
) -> DataFrame:
    """Join both sides on the keys of a branch, plus similar name parts where the branch asks for them.

    ``sought`` are the build rows that do not look for the probe rows themselves.
    ``by_surname`` is the least similarity under which two persons met by their
    surnames, and null where they met by anything else.
    """
    never = F.lit(None).cast("double")
    if not branch.by_token:
        # Years, places or relatives alone: such a key may be hot, so it is split by its size.
        return split_join(probe.drop("need"), build, keys).withColumn("by_surname", never)

    def by_part(left: DataFrame, right: DataFrame) -> DataFrame:
        parts = left.withColumn("_p", F.explode(_name_parts("a")))
        parts = parts.withColumn("k_part", F.col("_p.part")).withColumn("text", F.col("_p.text")).drop("_p")
        near = parts.join(dictionary, "text").where("sim >= need").drop("text", "sim")
        found = right.withColumn("_p", F.explode(_name_parts("b")))
        found = found.withColumn("k_part", F.col("_p.part")).withColumn("k_text", F.col("_p.text")).drop("_p")
        met = near.withColumnRenamed("other", "k_text").join(found, [*keys, "k_part", "k_text"])
        return met.withColumn("by_surname", F.when(F.col("k_part") == "s", F.col("need"))).drop("k_part", "k_text", "need")

    if not branch.by_both:
        return by_part(probe, build)

    # Both name parts must be similar, unless the first person lacks one.
    lacking = _lacking
    full = probe.where(~lacking("a")).withColumn("text", F.col("a")["gf"]).join(dictionary, "text")
    full = full.withColumnRenamed("sim", "sim_g").withColumnRenamed("other", "k_g").drop("text")
    full = full.withColumn("text", F.col("a")["sf"]).join(dictionary, "text")
    full = full.withColumnRenamed("sim", "sim_s").withColumnRenamed("other", "k_s").drop("text")
    least_other = F.when(F.lit(False), F.lit(0.0))
    for value in sorted(set(_all_needs(branch, settings).values())):
        least_other = least_other.when(F.col("need") == value, F.lit(other_part(value)))
    enough = (F.greatest("sim_g", "sim_s") >= F.col("need")) & (F.least("sim_g", "sim_s") >= least_other)
    full = full.where(enough).drop("sim_g", "sim_s", "need")
    found = build.where(~lacking("b")).withColumn("k_g", F.col("b")["gf"]).withColumn("k_s", F.col("b")["sf"])
    met = full.join(found, [*keys, "k_g", "k_s"]).drop("k_g", "k_s").withColumn("by_surname", never)
    met = met.unionByName(by_part(probe.where(lacking("a")), build))
    if sought is not None:
        met = met.unionByName(by_part(probe.where(~lacking("a")), build.where(lacking("b") & sought)))
    return met


def _with_places(left: DataFrame, right: DataFrame, branch: Branch, related: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``k_place``: the place itself, or for the probe every place that is related to its own."""
    right = right.where(F.col("b")["pl"].isNotNull()).withColumn("k_place", F.col("b")["pl"])
    left = left.where(F.col("a")["pl"].isNotNull())
    if branch.place == "same":
        return left.withColumn("k_place", F.col("a")["pl"]), right
    return left.withColumn("place", F.col("a")["pl"]).join(related, "place").drop("place"), right


def _reach(branch: Branch) -> bool:
    return any(d for _, d in branch.needs)


def _has_evidence(branch: Branch) -> Column:
    """Whether two persons have the years and places that a branch asks for, whoever comes first."""
    a, b = F.col("a"), F.col("b")
    (low_a, high_a, _), (low_b, high_b, _) = _period(a), _period(b)
    asked = [F.lit(True)]
    if branch.birth:
        asked.append(F.greatest(low_a, low_b) - 1 <= F.least(high_a, high_b))
        asked.append(a["by"].isNotNull() & b["by"].isNotNull())
    if branch.death:
        asked.append(F.abs(a["dy"] - b["dy"]) <= int(_reach(branch)))
    if branch.place:
        same = a["pl"] == b["pl"]
        holds = F.contains(a["pl"], b["pl"]) | F.contains(b["pl"], a["pl"])
        asked.append(same if branch.place == "same" else ~same & holds)
    return F.coalesce(reduce(lambda x, y: x & y, asked), F.lit(False))


def _met_once(branch: Branch, earlier: list[Branch], sought: Column | None = None) -> Column:
    """Of all meetings of two profiles, in both orders and under all keys and branches, exactly one.

    The more a branch asks for, the earlier it comes and the lower its least
    name score is; so a pair is left to the first branch whose evidence it has.
    Profiles that are only ``sought`` do not look for others, so they are met in one order as it is.
    """
    a, b = F.col("a"), F.col("b")
    one_order = F.col("pa") <= F.col("pb")
    if branch.by_both:
        # Who lacks a part of the name looks for the others.
        one_order = F.when(_lacking("a") == _lacking("b"), one_order).otherwise(_lacking("a"))
    if sought is not None:
        one_order = sought | one_order
    kept = [one_order, *[~_has_evidence(e) for e in earlier]]
    if branch.birth:
        (low_a, high_a, wide_a), (low_b, high_b, wide_b) = _period(a), _period(b)
        first = lambda low, high: F.element_at(_buckets(low, high), 1)
        year = F.when(a["by"] == b["by"], a["by"]).otherwise(F.greatest(low_a - 1, low_b))
        bucket = F.greatest(first(low_a - 1, high_a + 1), first(low_b, high_b))
        kept += [_has_evidence(branch), F.col("k_birth") == F.when(wide_a | wide_b, bucket).otherwise(year)]
    return reduce(lambda x, y: x & y, kept)


def _can_reach(settings: Settings) -> Column:
    """Whether two persons without a common relative reach the threshold if their names and places are the same."""
    a, b, w = F.col("a"), F.col("b"), settings.weight
    gap = F.abs(a["dy"] - b["dy"])
    best = w("name") + (w("place") * R.PLACE_SAME if settings.use_place else 0.0)
    best += sum(rule.weight * rule.ceiling for rule in settings.custom)
    points = [
        F.when(a["by"] == b["by"], w("birth") * R.SAME_YEAR).when((a["by"] + b["by"]).isNotNull(), w("birth") * R.OVERLAP),
        F.when(gap == 0, w("death") * R.SAME_YEAR).when(gap <= 1, w("death") * R.NEXT_YEAR),
        F.when(a["fc"] & b["fc"], w("parents") * R.PARENTS_DIFFER),
        F.when(a["fs"] & b["fs"], w("marriage") * R.MARRIAGE_DIFFER),
        F.when(a["ch"] & b["ch"], w("children") * R.CHILDREN_DIFFER),
    ]
    total = reduce(lambda x, y: x + y, [p.otherwise(0.0) for p in points], F.lit(float(best)))
    return total >= (settings.threshold - 0.0005) * settings.total_weight - 1e-9


def _branch_pairs(
    probe: DataFrame, build: DataFrame, branch: Branch, settings: Settings, dictionary: DataFrame | None, keys: list[str], sought: Column | None,
    related: DataFrame | None = None, once: Column | None = None,
) -> DataFrame:
    left, right = probe, build
    if branch.place:
        left, right = _with_places(left, right, branch, related)
        keys = [*keys, "k_place"]
    if branch.birth:
        left, right = _with_births(left, "a", True), _with_births(right, "b", False)
        keys = [*keys, "k_space", "k_birth"]
    if branch.death:
        reach = _reach(branch)
        left, right = _with_deaths(left, "a", True, reach), _with_deaths(right, "b", False, reach)
        keys = [*keys, "k_death"]
    met = _meet(_with_need(left, branch, settings), right, keys, branch, settings, dictionary, sought)
    if once is not None:
        met = met.where(once)
    return met.drop(*keys)


# --------------------------------------------------------------- pair search


def _dictionary(features: DataFrame, least: float) -> DataFrame:
    """Similar name parts ``(text, other, sim)``, each text with itself included."""
    texts = features.select(F.explode(F.array("f.gf", "f.sf")).alias("text")).where("text <> ''").dropDuplicates()
    near = similar_texts(texts, least).select(
        F.col("a").alias("text"),
        F.col("b").alias("other"),
        exact_round(edit_similarity(F.col("a"), F.col("b")), 2).alias("sim"),
    )
    return cut_lineage(near.unionByName(texts.select("text", F.col("text").alias("other"), F.lit(1.0).alias("sim"))))


def _related_places(features: DataFrame) -> DataFrame:
    """``(place, k_place)``: every place with the different ones that hold it or that it holds, as texts.

    The inner text is looked up by the rarest of its runs of three letters, or
    by itself if it is shorter.
    """
    places = features.select(F.col("f.pl").alias("t")).where("t is not null").dropDuplicates()
    places = cut_lineage(places.withColumn("n", F.length("t")))
    runs = F.flatten(
        F.transform(
            F.array(F.lit(1), F.lit(2), F.lit(3)),
            lambda w: F.transform(
                F.when(F.col("n") >= w, F.sequence(F.lit(1), F.col("n") - w + 1)).otherwise(F.array().cast("array<int>")),
                lambda p: F.substr(F.col("t"), p, w),
            ),
        )
    )
    held = cut_lineage(places.select("t", "n", F.explode(F.array_distinct(runs)).alias("run")))
    often = held.groupBy("run").agg(F.count(F.lit(1)).alias("times"))
    own = held.where(F.length("run") == F.least(F.col("n"), F.lit(3))).join(often, "run")
    rarest = own.groupBy("t").agg(F.min_by("run", F.struct("times", "run")).alias("run"))
    inner, outer = rarest.select("run", F.col("t").alias("inner")), held.select("run", F.col("t").alias("outer"))
    found = inner.join(outer, "run").where(F.contains("outer", F.col("inner")) & (F.col("inner") != F.col("outer")))
    found = cut_lineage(found.select(F.col("inner").alias("place"), F.col("outer").alias("k_place")))
    return found.unionByName(found.select(F.col("k_place").alias("place"), F.col("place").alias("k_place")))


def profile_pairs(features: DataFrame, settings: Settings = DEFAULT, dictionary: DataFrame | None = None, focus: DataFrame | None = None) -> DataFrame:
    """Pairs of profiles whose members are candidates when they share no relative.

    The result ``(pa, pb, score, score_ba, ...)`` has the score with a
    member of ``pa`` as first person and with a member of ``pb`` as first; the
    name rule treats the first person's missing name parts differently. Each
    unordered pair of profiles comes once, also a profile with itself. What
    the rules found goes along as numbers, for the reasons to be told at last.
    """
    profiles = features.select("profile", "f").distinct()
    if focus is not None:
        wanted = focus.select("profile").dropDuplicates().withColumn("asked", F.lit(True))
        profiles = profiles.join(wanted, "profile", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    return _scored_pairs(profiles, features, settings, dictionary)


def _scored_pairs(profiles: DataFrame, features: DataFrame, settings: Settings, dictionary: DataFrame | None) -> DataFrame:
    """The pairs of rows ``(profile, f, ...)`` that reach the threshold, each once.

    Further columns travel along, with ``_a`` and ``_b`` at the end of their
    names; with a column ``asked`` only pairs that touch such a row are looked for.
    """
    plan = [b for b in branches(settings) if b.links == 0]
    if dictionary is None and any(b.by_token for b in plan):
        dictionary = _dictionary(features, dictionary_least(plan))
    more = [c for c in profiles.columns if c not in ("profile", "f", "asked")]

    def side(rows: DataFrame, x: str, *flags: Column) -> DataFrame:
        return rows.select(F.col("profile").alias(f"p{x}"), F.col("f").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in more], *flags)

    probe, build, sought = side(profiles, "a"), side(profiles, "b"), None
    if "asked" in profiles.columns:
        probe, sought = side(profiles.where("asked"), "a"), F.col("sought")
        build = side(profiles, "b", (~F.col("asked")).alias("sought"))
    related = _related_places(features) if any(b.place == "related" for b in plan) else None
    met = []
    for i, branch in enumerate(plan):
        once = _met_once(branch, plan[:i], sought) & _can_reach(settings)
        met.append(_branch_pairs(probe, build, branch, settings, dictionary, [], sought, related, once))
    if not met:
        met = [probe.join(build, F.lit(False)).withColumn("by_surname", F.lit(None).cast("double"))]
    found = reduce(DataFrame.unionByName, met).drop("sought")
    swap = F.col("pa") > F.col("pb")

    def in_order(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        first = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
        turned = {x: first(x, y, x) for x, y in pairs} | {y: first(y, x, y) for x, y in pairs}
        return rows.select(*[turned.get(c, F.col(c)) for c in rows.columns])

    ids = [("pa", "pb"), *[(f"{c}_a", f"{c}_b") for c in more]]
    # A custom rule may depend on who comes first; else only the scores do, and long rows need not be turned.
    if settings.custom:
        found = in_order(found, ("a", "b"), *ids)
    scored = with_evidence(found, settings, both_ways=True, rounded=round_column)
    # Where the given names are as near as the surnames must be, the two have met by them as well.
    first = F.coalesce(F.col("_given") < F.col("by_surname"), F.lit(True))
    kept = keep_where(scored, first & (F.greatest("score", "score_ba") >= settings.threshold)).drop("a", "b", "by_surname", "_given")
    return kept if settings.custom else in_order(kept, ("score", "score_ba"), *ids)


def _numbered(features: DataFrame) -> DataFrame:
    """Features with a number, in the order of the texts, in place of the text of each profile."""
    numbers = dense_ids(features.select("profile").distinct(), "number", F.col("profile"))
    return features.join(numbers, "profile").drop("profile").withColumnRenamed("number", "profile")


def _crowds(features: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """Profiles with their members, ``(profile, f, members)``, a large crowd in rows of some ``CROWD`` members each.

    A member is a person's id, xref and name with the number ``n`` of equal
    rows. With ``focus`` it knows whether it is ``asked`` for, as does its profile.
    """
    own = features.groupBy("person_id", "xref", "name", "profile", "f").agg(F.count(F.lit(1)).alias("n"))
    asked = []
    if focus is not None:
        wanted = focus.select("person_id").dropDuplicates().withColumn("asked", F.lit(True))
        own = own.join(wanted, "person_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        asked = ["asked"]
    sizes = own.groupBy("profile").agg(F.count(F.lit(1)).alias("size"), *[F.bool_or(c).alias("of_asked") for c in asked])
    crowd = F.pmod(F.xxhash64("person_id", "xref", "name"), F.ceil(F.col("size") / CROWD))
    member = F.struct(F.struct("person_id", "xref", "name").alias("m"), "n", *asked)
    dealt = own.join(sizes, "profile").withColumn("crowd", crowd)
    rows = dealt.groupBy("profile", "f", "crowd", *["of_asked" for _ in asked]).agg(F.collect_list(member).alias("members"))
    return rows.select("profile", "f", "members", *[F.col("of_asked").alias(c) for c in asked])


def _spread(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Person pairs of pairs of crowds, smaller id first, with scores and what the rules found.

    Equal rows of a person are one where the pair may share a relative, as
    they are among the pairs that do; else each of them counts.
    """
    both = pairs.withColumn("_x", F.explode("members_a")).withColumn("_y", F.explode("members_b")).drop("members_a", "members_b")
    if "asked" in both.schema["_x"].dataType.fieldNames():
        both = both.where("_x.asked or _y.asked")
    both = both.withColumns({"ma": F.col("_x.m"), "mb": F.col("_y.m"), "na": F.col("_x.n"), "nb": F.col("_y.n")}).drop("_x", "_y")
    one = F.col("ma.person_id") < F.col("mb.person_id")
    distinct = both.where((F.col("pa") != F.col("pb")) | one)
    may_share = F.greatest("_parents", "_marriage", "_children") > 0
    times = F.when(may_share, F.lit(1)).otherwise((F.col("na") * F.col("nb")).cast("int"))
    distinct = distinct.withColumn("_time", F.explode(F.sequence(F.lit(1), times))).drop("_time")
    pick = lambda x, y: F.when(one, x).otherwise(y)
    return distinct.select(
        pick(F.col("ma"), F.col("mb")).alias("m1"),
        pick(F.col("mb"), F.col("ma")).alias("m2"),
        pick(F.col("score"), F.col("score_ba")).alias("score"),
        *evidence_columns(pairs),
    )


def _linked_pairs(features: DataFrame, edges: DataFrame, settings: Settings, dictionary: DataFrame | None, focus: DataFrame | None) -> DataFrame:
    """Person pairs ``(m1, m2, a, b)`` that share relatives and may reach the threshold."""
    plan = [b for b in branches(settings) if b.links > 0]
    person = F.struct("person_id", "xref", "name")
    joined = edges.join(features, "person_id")

    def sides(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
        left = rows.select(*keys, person.alias("m1"), F.col("f").alias("a"))
        if focus is not None:
            wanted = focus.select("person_id")
            left = left.join(wanted, F.col("m1.person_id") == F.col("person_id"), "left_semi")
        return left, rows.select(*keys, person.alias("m2"), F.col("f").alias("b"))

    met = []
    # A family has two partners at most, so all pairs of partners are simply taken.
    probe, build = sides(joined.where("kind = 'm'"), "link_id")
    met.append(probe.join(build, "link_id").select("m1", "a", "m2", "b"))
    # Siblings and persons with a common child: a family or child may be hot, so dates and names are keys too.
    probe, build = sides(joined.where("kind <> 'm'"), "kind", "link_id")
    for branch in (b for b in plan if b.links == 1):
        pairs = _branch_pairs(probe, build, branch, settings, dictionary, ["kind", "link_id"], F.lit(True))
        met.append(pairs.select("m1", "a", "m2", "b"))
    if any(b.links == 2 for b in plan):
        # Two shared links without a common family of their own: same parents and a common child.
        origins = edges.where("kind = 'p'").select("person_id", F.col("link_id").alias("origin"))
        probe, build = sides(joined.where("kind = 'c'").join(origins, "person_id"), "link_id", "origin")
        met.append(probe.join(build, ["link_id", "origin"]).select("m1", "a", "m2", "b"))
    both = reduce(DataFrame.unionByName, met)
    one = F.col("m1.person_id") < F.col("m2.person_id")
    pick = lambda x, y: F.when(one, F.col(x)).otherwise(F.col(y))
    return both.where("m1.person_id <> m2.person_id").select(
        pick("m1", "m2").alias("m1"), pick("m2", "m1").alias("m2"), pick("a", "b").alias("a"), pick("b", "a").alias("b")
    )


def _shared_links(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Shared family ids and number of shared children of each pair ``(i, j)``."""
    left = edges.select(F.col("person_id").alias("i"), "kind", "link_id")
    right = edges.select(F.col("person_id").alias("j"), "kind", "link_id")
    hits = pairs.join(left, "i").join(right, ["j", "kind", "link_id"])
    ids = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("link_id"))))
    return hits.groupBy("i", "j").agg(
        ids("p").alias("p"), ids("m").alias("m"), F.count_if(F.col("kind") == "c").alias("c")
    )


def duplicate_candidates(
    persons: DataFrame,
    families: DataFrame,
    parent_children: DataFrame,
    settings: Settings = DEFAULT,
    focus: DataFrame | None = None,
) -> DataFrame:
    """All person pairs at or above the threshold.

    ``persons`` are enriched persons. With ``focus`` (a table of
    ``person_id``) only pairs that touch one of those persons are looked for,
    and the restriction is applied before any join of pairs.
    """
    compile_small_methods(persons.sparkSession)
    edges = cut_lineage(link_edges(families, parent_children))
    features = cut_lineage(_numbered(cut_lineage(person_features(persons, settings))))
    least = dictionary_least(branches(settings))
    dictionary = None if least is None else _dictionary(features, least)
    focused = None
    if focus is not None:
        focused = features.join(focus.select("person_id").dropDuplicates(), "person_id", "left_semi")

    # The members travel with their profiles, so that pairs, of which there may be many, are written once and never shuffled.
    # Dealt out again, as few small files would be few tasks where the other side of a join is broadcast.
    crowds = cut_lineage(_crowds(features, focus)).repartition("profile")
    with all_partitions(persons.sparkSession):
        profiles = cut_lineage(_scored_pairs(crowds, features, settings, dictionary))
    apart = _spread(profiles, settings).where(F.col("score") >= settings.threshold)

    # Pairs that share a relative are scored with what they share. A shared link only lowers what else a candidate
    # must have, so those that are found apart are among them.
    linked = _linked_pairs(features, edges, settings, dictionary, focused)
    linked = linked.withColumn("i", F.col("m1.person_id")).withColumn("j", F.col("m2.person_id"))
    linked = cut_lineage(linked.distinct())
    both = with_evidence(linked.select("i", "j", "a", "b"), settings, rounded=round_column)
    again = cut_lineage(keep_where(both, F.col("score") >= settings.threshold).select("i", "j").distinct())
    here = (F.col("m1.person_id") == F.col("i")) & (F.col("m2.person_id") == F.col("j"))
    apart = with_reasons(apart.join(again, here, "left_anti"), settings, rounded=round_column)
    shared = _shared_links(linked.select("i", "j").distinct(), edges)
    sizes = edges.where("kind = 'c'").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    none = F.array().cast("array<bigint>")
    known = (
        linked.join(shared, ["i", "j"], "left")
        .join(sizes.select(F.col("person_id").alias("i"), F.col("n").alias("n1")), "i", "left")
        .join(sizes.select(F.col("person_id").alias("j"), F.col("n").alias("n2")), "j", "left")
    )
    x = F.struct(
        F.coalesce("p", none).alias("p"),
        F.coalesce("m", none).alias("m"),
        F.coalesce("c", F.lit(0)).alias("c"),
        F.coalesce("n1", F.lit(0)).alias("n_first"),
        F.coalesce("n2", F.lit(0)).alias("n_second"),
    )
    scored = with_evidence(known.select("m1", "m2", "a", "b", x.alias("x")), settings, shared="x", rounded=round_column).drop("a", "b", "x")
    rescored = cut_lineage(with_reasons(keep_where(scored, F.col("score") >= settings.threshold), settings, rounded=round_column))
    return apart.unionByName(rescored).select(
        F.col("m1.person_id").alias("a_id"),
        F.col("m1.xref").alias("a_xref"),
        F.col("m1.name").alias("a_name"),
        F.col("m2.person_id").alias("b_id"),
        F.col("m2.xref").alias("b_xref"),
        F.col("m2.name").alias("b_name"),
        "score",
        "confidence",
        "rules_used",
        "reasons",
    )


def top_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """The ``n`` best pairs, ids deciding ties."""
    return candidates.orderBy(F.desc("score"), "a_id", "b_id").limit(n)


# ------------------------------------------------------- groups and decisions


def group_key(match_on_surname: bool = True, require_year: bool = False) -> Column:
    """Key of a duplicate group: folded full name, folded surname and birth year, as asked for."""
    parts = [F.when(has_text(F.col("given_name")), folded_name(F.col("given_name"), F.col("surname")))]
    if match_on_surname:
        parts.append(fold(F.col("surname")))
    if require_year:
        parts.append(F.regexp_extract(F.col("birth_date"), r"\b(1[5-9]\d{2}|2\d{3})\b", 1))
    return F.concat_ws("*", *[F.nullif(p, F.lit("")) for p in parts])


def duplicate_groups(persons: DataFrame, match_on_surname: bool = True, require_year: bool = False) -> DataFrame:
    """``(key, size, reason)`` of keys held by more than one person."""
    keyed = persons.select(group_key(match_on_surname, require_year).alias("key")).where("key <> ''")
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    reason = F.concat(F.lit("nom similar ("), F.col("key"), F.lit(")"))
    return groups.select("key", "size", reason.alias("reason"))


def group_members(persons: DataFrame, match_on_surname: bool = True, require_year: bool = False) -> DataFrame:
    """``(key, person_id)`` of all members; long form, so a huge group is only many rows."""
    keyed = persons.select("person_id", group_key(match_on_surname, require_year).alias("key")).where("key <> ''")
    groups = duplicate_groups(persons, match_on_surname, require_year).select("key")
    return keyed.join(groups, "key", "left_semi").select("key", "person_id")


# Messages of the quick decision.
SAME_NAME = "nom i cognom idèntics"
ONLY_SURNAME = "cognom idèntic però sense nom"
NO_MATCH = "no coincideix"


def quick_decision(a: str, b: str, match_on_surname: bool = True) -> tuple[Column, Column]:
    """Whether two persons (struct columns ``a`` and ``b``) are likely the same, with a message."""
    x, y = F.col(a), F.col(b)
    same_given = has_text(x["given_name"]) & F.coalesce(
        folded_name(x["given_name"], x["surname"]) == folded_name(y["given_name"], y["surname"]), F.lit(False)
    )
    same_surname = has_text(x["surname"]) & F.coalesce(fold(x["surname"]) == fold(y["surname"]), F.lit(False))
    likely = same_given & (same_surname | F.lit(not match_on_surname))
    message = F.when(likely, F.lit(SAME_NAME)).when(~same_given & same_surname, F.lit(ONLY_SURNAME))
    return likely, message.otherwise(F.lit(NO_MATCH))
