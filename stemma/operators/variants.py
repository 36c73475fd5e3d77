"""Spelling variants and similarity joins of names and places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.functions.names import PHONETIC_SIMILARITY, name_similarity
from stemma.functions.places import place_canonical, place_tokens, token_jaccard
from stemma.functions.text import fold, has_text, phonetic_key
from stemma.operators.blocks import pairs_in_blocks
from stemma.operators.keys import dense_ids
from stemma.operators.pair_rules import keep_where
from stemma.session import cut_lineage

# Known variants of common given names.
KNOWN_VARIANTS = {
    "jose": ("jose", "josé", "josep"),
    "maria": ("maria", "maría"),
    "joan": ("joan", "juan"),
    "pau": ("pau", "pablo"),
    "pere": ("pere", "pedro", "pedre"),
}

# Fixed value: place similarity from which two places match.
PLACE_MATCH = 0.8


def _distinct_spellings(df: DataFrame, column: str) -> DataFrame:
    spelled = df.where(has_text(F.col(column))).select(F.col(column).alias("raw")).dropDuplicates()
    return spelled.withColumn("key", fold(F.col("raw"))).where("key <> ''")


def variant_rows(df: DataFrame, column: str) -> DataFrame:
    """``(key, raw, canonical, n_variants)`` for every spelling of a key with several spellings.

    Stays in long form: spellings are deduplicated first, group size and
    canonical form (longest, then alphabetic) come from an aggregation that
    combines early, and no group is gathered anywhere.
    """
    spelled = _distinct_spellings(df, column)
    groups = spelled.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.min(F.struct((-F.length("raw")).alias("l"), "raw")).alias("first"),
    )
    return spelled.join(groups.where("n_variants > 1"), "key").select(
        "key", "raw", F.col("first.raw").alias("canonical"), "n_variants"
    )


def _ordered_variants() -> Column:
    by_length = F.array_sort(F.collect_list(F.struct((-F.length("raw")).alias("l"), "raw")))
    return F.transform(by_length, lambda v: v["raw"])


def place_variant_groups(df: DataFrame, column: str = "name") -> DataFrame:
    """Places that agree once folded: canonical, variants (longest first), reason."""
    groups = _distinct_spellings(df, column).groupBy("key").agg(_ordered_variants().alias("variants"))
    return groups.where(F.size("variants") > 1).select(
        F.element_at("variants", 1).alias("canonical"),
        "variants",
        F.concat(F.lit("totes normalitzen a '"), F.col("key"), F.lit("'")).alias("reason"),
    )


def name_variant_groups(df: DataFrame, column: str = "given_name") -> DataFrame:
    """Names that agree once folded: original, normalized, alternatives without the original, reason."""
    groups = _distinct_spellings(df, column).groupBy("key").agg(_ordered_variants().alias("variants"))
    return groups.where(F.size("variants") > 1).select(
        F.element_at("variants", 1).alias("original"),
        F.col("key").alias("normalized"),
        F.slice("variants", 2, F.size("variants") - 1).alias("alternatives"),
        F.concat(F.lit("variants normalitzades a '"), F.col("key"), F.lit("'")).alias("reason"),
    )


def by_group_size(groups: DataFrame) -> DataFrame:
    """Report order: biggest groups first."""
    column = "variants" if "variants" in groups.columns else "alternatives"
    first = "canonical" if "canonical" in groups.columns else "original"
    return groups.orderBy(F.desc(F.size(column)), first)


def is_variant(a: Column, b: Column) -> Column:
    """Two texts with the same non-empty folded form."""
    folded = fold(a)
    return F.coalesce((folded != "") & (folded == fold(b)), F.lit(False))


def variant_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Rows of both sides whose texts are variants of each other."""
    a = left.withColumn("_key", fold(F.col(left_on))).where("_key <> ''")
    b = right.withColumn("_key", fold(F.col(right_on))).where("_key <> ''")
    return a.join(b, "_key").drop("_key")


def known_variants(df: DataFrame, column: str) -> DataFrame:
    """Add the sorted known variants of a name; empty when it is in no list.

    Names are looked up folded.
    """
    table = {form: sorted(set(forms) - {form}) for forms in KNOWN_VARIANTS.values() for form in forms}
    pairs = [x for key, rest in table.items() for x in (F.lit(key), F.array(*[F.lit(r) for r in rest]))]
    found = F.try_element_at(F.create_map(*pairs), fold(F.col(column)))
    empty = F.array().cast("array<string>")
    return df.withColumn("known_variants", F.coalesce(found, empty))


def place_forms(df: DataFrame, column: str = "name") -> DataFrame:
    """Distinct places with folded form and sorted distinct tokens."""
    name = F.col(column)
    return (
        df.where(has_text(name))
        .select(name.alias("place"))
        .dropDuplicates()
        .select(
            "place",
            fold(F.col("place")).alias("folded"),
            F.array_sort(F.array_distinct(place_tokens(F.col("place")))).alias("tokens"),
        )
    )


def _numbered_sets(places: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``(place, set_id)`` of places with tokens, and ``(set_id, n, tokens)`` of their distinct token sets.

    Tokens are numbered from the rarest on, and a set lists its numbers in
    that order, so that from here on only numbers are joined and compared.
    """
    forms = cut_lineage(place_forms(places, column).where(F.size("tokens") > 0).drop("folded"))
    sets = cut_lineage(forms.select("tokens").dropDuplicates().withColumn("set_id", F.monotonically_increasing_id()))
    held = sets.select("set_id", F.explode("tokens").alias("token"))
    often = held.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    numbers = dense_ids(often, "number", F.col("times"), F.col("token")).select("token", "number")
    ordered = held.join(numbers, "token").groupBy("set_id").agg(F.array_sort(F.collect_list("number")).alias("tokens"))
    named = forms.join(sets, "tokens").select("place", "set_id")
    return cut_lineage(named), cut_lineage(ordered.select("set_id", F.size("tokens").alias("n"), "tokens"))


def similar_token_sets(sets: DataFrame, min_similarity: float) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of different sets whose rounded Jaccard index reaches the minimum, a < b.

    ``sets`` holds ``(set_id, n, tokens)``, tokens numbered from the rarest on.
    Prefix filter: two sets of that similarity share a token among the first
    ``n - ceil(t*n) + 1`` of each. A word most places contain is therefore
    joined on only where nothing rarer is left. Positional filter: after the
    first token in common, no more can follow than either set has left, so
    most pairs go before any sets are compared. No pair is lost.
    """
    bound = min_similarity - 0.005
    if bound <= 0:
        raise ValueError("min_similarity must be at least 0.01")
    prefix = F.col("n") - F.ceil(F.col("n") * bound - 1e-9).cast("int") + 1
    keys = sets.select("set_id", "n", "tokens", F.posexplode(F.slice("tokens", F.lit(1), prefix)).alias("at", "key"))
    a = keys.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("at").alias("pa"), "key")
    b = keys.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), F.col("at").alias("pb"), "key")
    close = (F.least("na", "nb") >= F.greatest("na", "nb") * bound - 1e-9) & (F.col("a") < F.col("b"))
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = most >= (F.col("na") + F.col("nb")) * (bound / (1 + bound)) - 1e-9
    shared = F.size(F.array_intersect("ta", "tb"))
    scored = a.join(b, "key").where(close & enough).select(
        "a", "b", token_jaccard(shared, F.col("na"), F.col("nb")).alias("similarity")
    )
    # Scored where they meet, so only pairs that stay are shuffled.
    return keep_where(scored, F.col("similarity") >= min_similarity).distinct()


def place_similarity_join(places: DataFrame, min_similarity: float = PLACE_MATCH, column: str = "name") -> DataFrame:
    """Pairs of different places ``(a, b, similarity)`` at or above a similarity.

    Equal folded forms, and different forms with the same tokens, score 1.
    Places are compared by distinct token set and only the result is spread
    over the spellings again.
    """
    forms, sets = _numbered_sets(places, column)
    close = similar_token_sets(sets, min_similarity)
    same = sets.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("similarity"))
    left = forms.select(F.col("set_id").alias("a"), F.col("place").alias("place_a"))
    right = forms.select(F.col("set_id").alias("b"), F.col("place").alias("place_b"))
    spread = close.unionByName(same).join(left, "a").join(right, "b")
    # Sets of different numbers come once, so their places stand in either order.
    kept = spread.where("(a <> b and place_a <> place_b) or place_a < place_b")
    return kept.select(F.least("place_a", "place_b").alias("a"), F.greatest("place_a", "place_b").alias("b"), "similarity")


def place_containment_join(places: DataFrame, column: str = "name") -> DataFrame:
    """Pairs ``(outer, inner)`` of different places where all inner tokens are in the outer place.

    The inner place is looked up by its rarest token only.
    """
    forms, sets = _numbered_sets(places, column)
    inner = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"), F.element_at("tokens", 1).alias("key"))
    outer = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"), F.explode("tokens").alias("key"))
    held = outer.join(inner, "key").where(F.size(F.array_except("tb", "ta")) == 0).select("a", "b")
    left = forms.select(F.col("set_id").alias("a"), F.col("place").alias("outer"))
    right = forms.select(F.col("set_id").alias("b"), F.col("place").alias("inner"))
    return held.join(left, "a").join(right, "b").where("outer <> inner").select("outer", "inner")


def place_match_join(places: DataFrame, column: str = "name") -> DataFrame:
    """Pairs ``(a, b)`` of different places that match: same canonical or folded form, or similar enough."""
    folded = places.where(has_text(F.col(column))).select(F.col(column).alias("place")).dropDuplicates()
    keyed = folded.withColumn("key", place_canonical(F.col("place")))
    same = pairs_in_blocks(keyed, "key", "place").select("a", "b")
    return same.unionByName(place_similarity_join(places, PLACE_MATCH, column).select("a", "b")).dropDuplicates()


def longest_distance(min_similarity: float) -> float:
    """Share of the longer length that may be edited for a rounded similarity."""
    return 1.0 - (min_similarity - 0.005)


def _subsequences(text: Column, length: Column) -> Column:
    """All subsequences of ``length`` letters: letters are struck out from left to right, or picked where fewer stay."""
    nowhere = F.array().cast("array<int>")
    places = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(nowhere)

    def strike(found: Column, _: Column) -> Column:
        each = lambda x: F.transform(
            places(x["at"], F.length(x["s"])),
            lambda p: F.struct(F.concat(F.substr(x["s"], F.lit(1), p - 1), F.substr(x["s"], p + 1)).alias("s"), p.alias("at")),
        )
        return F.flatten(F.transform(found, each))

    def pick(found: Column, _: Column) -> Column:
        each = lambda x: F.transform(
            places(x["at"], F.length(text)),
            lambda p: F.struct(F.concat(x["s"], F.substr(text, p, F.lit(1))).alias("s"), (p + 1).alias("at")),
        )
        return F.flatten(F.transform(found, each))

    start = lambda s: F.array(F.struct(s.alias("s"), F.lit(1).alias("at")))
    gone = F.length(text) - length
    # Either way there are at most as many on the way as in the end.
    struck = F.aggregate(places(F.lit(1), F.when(gone <= length, gone).otherwise(F.lit(0))), start(text), strike)
    picked = F.aggregate(places(F.lit(1), F.when(gone > length, length).otherwise(F.lit(0))), start(F.lit("")), pick)
    return F.array_distinct(F.transform(F.when(gone <= length, struck).otherwise(picked), lambda x: x["s"]))


def _by_subsequences(sized: DataFrame, cores: dict[int, int]) -> DataFrame:
    """Pairs ``(a, b)`` of texts of lengths n <= m that have a subsequence of ``cores[m]`` letters in common."""
    table = F.create_map(*[F.lit(x) for pair in cores.items() for x in pair])
    long = sized.where(F.col("n").isin(*cores)).select(
        F.col("t").alias("b"), F.col("n").alias("m"),
        F.explode(_subsequences(F.col("t"), F.element_at(table, F.col("n")))).alias("key"),
    )
    lengths = F.array(*[F.lit(m) for m in cores])
    fitting = F.filter(lengths, lambda m: (m >= F.col("n")) & (F.element_at(table, m) <= F.col("n")))
    short = sized.select("t", "n", F.explode(fitting).alias("m")).select(
        F.col("t").alias("a"), "n", "m", F.explode(_subsequences(F.col("t"), F.element_at(table, F.col("m")))).alias("key")
    )
    return short.join(long, ["m", "key"]).where("n < m or a < b").select("a", "b", F.col("m").alias("nb"))


def _by_pieces(sized: DataFrame, share: float, lengths: list[int]) -> DataFrame:
    """Pairs ``(a, b)`` of texts that have a piece in common, for longer texts of other ``lengths``.

    With at most k edits, cutting the shorter text into k+1 pieces leaves one
    piece that occurs unchanged in the longer one, shifted by no more than the
    edits allow.
    """
    edits = lambda n: F.floor(n * share + 1e-9).cast("int")
    other = lambda c: ~F.col(c).isin(*lengths) if lengths else F.lit(True)

    # The longest text that may pair with one of length n.
    reach = F.ceil(F.col("n") / (1.0 - share) + 1e-9).cast("int")
    short = sized.select("t", "n", F.explode(F.sequence(F.col("n"), reach)).alias("m")).where(
        (F.col("m") - F.col("n") <= edits(F.col("m"))) & other("m")
    )
    short = short.select("t", "n", "m", edits(F.col("m")).alias("k"))
    short = short.select("t", "n", "m", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    start, length = _piece(F.col("n"), F.col("k"), F.col("i"))
    short_keys = short.select(
        F.col("t").alias("a"), F.col("n").alias("na"), F.col("m").alias("nb"), "i",
        F.substr(F.col("t"), start, length).alias("piece"),
    )

    lowest = F.greatest(F.lit(1), F.ceil(F.col("n") * (1.0 - share) - 1e-9).cast("int"))
    long = sized.where(other("n")).select("t", "n", edits(F.col("n")).alias("k"), F.explode(F.sequence(lowest, F.col("n"))).alias("s"))
    long = long.where(F.col("n") - F.col("s") <= F.col("k"))
    long = long.select("t", "n", "s", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    start, length = _piece(F.col("s"), F.col("k"), F.col("i"))
    spare = F.col("k") - (F.col("n") - F.col("s"))
    first = F.greatest(F.lit(1), start - F.floor(spare / 2).cast("int"))
    last = F.least(F.col("n") - length + 1, start + F.floor((F.col("k") + F.col("n") - F.col("s")) / 2).cast("int"))
    long = long.select("t", "n", "s", "i", length.alias("len"), first.alias("p0"), last.alias("p1")).where("p0 <= p1")
    long = long.select("t", "n", "s", "i", "len", F.explode(F.sequence("p0", "p1")).alias("p"))
    long_keys = long.select(
        F.col("t").alias("b"), F.col("s").alias("na"), F.col("n").alias("nb"), "i",
        F.substr(F.col("t"), F.col("p"), F.col("len")).alias("piece"),
    ).dropDuplicates()
    met = short_keys.join(long_keys, ["na", "nb", "i", "piece"]).where("na < nb or a < b")
    return met.select("a", "b", "nb")


#: Subsequences that a text may be filed under; longer texts are cut into pieces.
MOST_KEYS = 1000
#: Texts longer than this are never filed under subsequences.
LONGEST_FILED = 64


def filed_lengths(share: float) -> dict[int, int]:
    """For texts of each length m: how many letters of them stay whatever is edited, where that gives few subsequences.

    Where the edits may be half of a text or more, pieces are of no use; then
    longer texts are filed under as many letters as keep the keys few.
    """
    out = {}
    for m in range(1, LONGEST_FILED + 1):
        core = m - int(m * share + 1e-9)
        if core and math.comb(m, core) <= MOST_KEYS:
            out[m] = core
        elif core and share >= LEAST_PIECES:
            out[m] = max(r for r in range(1, core + 1) if math.comb(m, r) <= MOST_KEYS)
    return out


#: From this share of edits on, a piece of a text may have no letter.
LEAST_PIECES = 0.45


def met_texts(texts: DataFrame, min_similarity: float, column: str = "text") -> DataFrame:
    """Pairs ``(a, b, nb)`` that are compared: all whose edit similarity reaches the minimum, and others, some repeatedly."""
    share = longest_distance(min_similarity)
    if share >= 1.0:
        raise ValueError("the least edit similarity must be above 0.005")
    vocabulary = texts.where(F.col(column) != "").select(F.col(column).alias("t")).dropDuplicates()
    sized = vocabulary.select("t", F.length("t").alias("n"))
    cores = filed_lengths(share)
    met = _by_subsequences(sized, cores)
    if share < LEAST_PIECES:
        return met.unionByName(_by_pieces(sized, share, list(cores)))
    return met.unionByName(_by_letters(sized, share))


def _by_letters(sized: DataFrame, share: float) -> DataFrame:
    """Pairs with a text too long to be filed under subsequences that have a letter in common."""
    lettered = lambda c: F.explode(F.array_distinct(F.split(F.col(c), ""))).alias("key")
    long = sized.where(F.col("n") > LONGEST_FILED).select(F.col("t").alias("b"), F.col("n").alias("nb"), lettered("t"))
    least = math.ceil((LONGEST_FILED + 1) * (1 - share) - 1e-9)
    short = sized.where(F.col("n") >= least).select(F.col("t").alias("a"), F.col("n").alias("na"), lettered("t"))
    met = short.join(long, "key").where("na <= nb and (na < nb or a < b)")
    return met.where(F.col("na") >= F.col("nb") * (1 - share) - 1e-9).select("a", "b", "nb")


def similar_texts(texts: DataFrame, min_similarity: float, column: str = "text") -> DataFrame:
    """Ordered pairs ``(a, b)`` of distinct texts whose edit similarity reaches a minimum; every pair both ways.

    If at most k letters of the longer text, of length m, are edited, both
    texts have a subsequence of m - k letters in common. Every text is filed
    under its subsequences of that length, apart for each m, so two texts meet
    only where so many letters agree in order. Where that would be too many
    keys, pieces of the texts take their place. No pair is lost.
    """
    share = longest_distance(min_similarity)
    edits = F.floor(F.col("nb") * share + 1e-9).cast("int")
    near = met_texts(texts, min_similarity, column).where(F.levenshtein("a", "b") <= edits).select("a", "b").distinct()
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _piece(n: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of piece ``i`` of ``k+1`` nearly equal pieces."""
    pieces = k + 1
    base = F.floor(n / pieces).cast("int")
    longer = n - base * pieces
    short_pieces = pieces - longer
    length = base + F.when(i >= short_pieces, F.lit(1)).otherwise(F.lit(0))
    start = i * base + F.greatest(F.lit(0), i - short_pieces) + 1
    return start, length


def name_similarity_join(names: DataFrame, min_similarity: float, column: str = "name") -> DataFrame:
    """Pairs ``(a, b, similarity)`` of distinct folded names at or above a similarity.

    At or below the phonetic similarity, names of one phonetic key pair up as well.
    """
    folded = names.select(fold(F.col(column)).alias("text")).where("text <> ''").dropDuplicates()
    pairs = similar_texts(folded, min_similarity).where("a < b")
    if min_similarity <= PHONETIC_SIMILARITY:
        keyed = folded.select("text", phonetic_key(F.col("text")).alias("key"))
        alike = pairs_in_blocks(keyed, "key", "text").select("a", "b")
        pairs = pairs.unionByName(alike).dropDuplicates()
    similarity = name_similarity(
        F.col("a"), F.col("b"), phonetic_key(F.col("a")), phonetic_key(F.col("b"))
    )
    scored = pairs.select("a", "b", similarity.alias("similarity"))
    return scored.where(F.col("similarity") >= min_similarity)
