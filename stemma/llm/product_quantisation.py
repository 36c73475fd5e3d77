"""Near-duplicate vectors by product quantisation.

Coarse inverted lists: unit vectors belong to the nearest of a set of
centroids. Inside a list a vector is known by the codes of its residual, one
code word per subspace, together with the length of what the codes leave out.

A vector is compared with the members of its own list and, as a guest, of the
lists whose border it is near to: the plane halfway between two centroids is
at most ``reach`` away. Of two vectors at distance r on two sides of a plane,
one is at most r / 2 from it, so a reach of r / 2 loses no pair. Differences
have no reason to point at a plane: in many dimensions their part across it is
about r / sqrt(dim), and ``SPREAD`` times half of that is reach enough.

Distances to the members come from tables of the exact vector's distance to
every code word of every subspace. Such a distance is wrong by no more than
the left-out length, so a pair is discarded only if it cannot be near; the
cosine of every other pair is computed on the vectors themselves.

Vectors meet in packs, and what leaves a task are numbers of links and a
spanning forest of what it has linked, so a crowd of n near copies gives rows
in proportion to n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from stemma.llm.components import connected_components
from stemma.session import cut_lineage

THRESHOLD = 0.93
#: Vectors that centroids and code words are fitted on, and the most centroids.
SAMPLE = 16_384
CENTROIDS = 1024
#: Members that a list of the largest label should have, for so long as the centroids suffice.
LIST = 256
SUBSPACES, WORDS = 8, 256
ROUNDS = 8
#: Standard deviations of a difference's part across a plane that the two reaches add up to.
SPREAD = 5.0
PACK = 256
#: Edges that a task gathers before it reduces them to a spanning forest.
HELD = 1 << 18
SEED = 42


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vector, dim): vector and label are null in rows that link with nothing."""
    kind = vectors.schema[vector_col].dataType
    wide = isinstance(kind, ArrayType) and not isinstance(kind.elementType, FloatType)
    element = "double" if wide else "float"
    v = F.col("v")
    sound = F.col("label").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0)
    sound &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast(f"array<{element}>").alias("v"),
    ).select("vec_id", "label", F.when(F.coalesce(sound, F.lit(False)), v).alias("vector"), F.size("v").alias("dim"))


def _spelt(vector: Column) -> Column:
    """The vector as text, equal for equal vectors only (negative zero is zero)."""
    return F.array_join(F.transform(vector, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")).cast("string")), ",")


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, however large or small their components."""
    wide = matrix.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of ``x`` and of ``y``."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1), 0.0)


def fit_means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` means of the rows of ``x`` (fewer if there are fewer rows); an empty one moves to a row that lies far off."""
    k = max(1, min(k, len(x)))
    means = x[random.choice(len(x), k, replace=False)] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) > k else 0):
        far = np.empty(len(x))
        own = np.empty(len(x), np.int64)
        for s in range(0, len(x), 4096):
            d = _squares(x[s : s + 4096], means)
            own[s : s + 4096], far[s : s + 4096] = d.argmin(axis=1), d.min(axis=1)
        number = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        means = sums / np.maximum(number, 1)[:, None]
        empty = np.flatnonzero(number == 0)
        means[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return means


class Quantiser:
    """Centroids, the code words of the residuals' subspaces, and the reach of a vector beyond its list."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float = THRESHOLD, spread: float = SPREAD):
        random = np.random.default_rng(SEED)
        dim = sample.shape[1]
        self.centroids = fit_means(sample, lists, random)
        residual = sample - self.centroids[self.nearest(sample)] if len(sample) else sample
        cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        self.parts = list(zip(cuts, cuts[1:]))
        self.words = [fit_means(residual[:, a:b], WORDS, random) for a, b in self.parts]
        self.radius = math.sqrt(max(2 - 2 * threshold, 0.0))
        self.reach = self.radius / 2 * min(1.0, spread / math.sqrt(dim))
        gaps = np.sqrt(_squares(self.centroids, self.centroids))
        np.fill_diagonal(gaps, np.inf)
        self.gaps = np.where(gaps == 0, np.inf, gaps)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _squares(x, self.centroids).argmin(axis=1)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list of each row, and the (row, list) pairs of the lists it is a guest of."""
        d = _squares(x, self.centroids)
        own = d.argmin(axis=1)
        away = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.gaps[own])
        near = away <= self.reach + 1e-9
        near[np.arange(len(x)), own] = False
        row, guest = np.nonzero(near)
        return own, row, guest

    def codes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code words of each row's residual, and the length of what they leave out."""
        residual = x - self.centroids[own]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        left = np.zeros(len(x))
        for m, (a, b) in enumerate(self.parts):
            d = _squares(residual[:, a:b], self.words[m])
            codes[:, m] = d.argmin(axis=1)
            left += ((residual[:, a:b] - self.words[m][codes[:, m]]) ** 2).sum(axis=1)
        return codes, np.sqrt(left)

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of exact rows to the coded members of a list, from one table per subspace."""
        residual = x - self.centroids[cell]
        out = np.zeros((len(x), len(codes)), np.float32)
        for m, (a, b) in enumerate(self.parts):
            table = _squares(residual[:, a:b], self.words[m]).astype(np.float32)
            out += np.take(table, codes[:, m], axis=1)
        return out


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the least of its component in the graph of edges (u, v)."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = np.minimum(root, root[root])
        while (root != root[root]).any():
            root = root[root]
        if (root[a] == root[b]).all():
            break
    child = np.flatnonzero(root != np.arange(len(names)))
    return names[child], names[root[child]]


def _blobs(matrix: np.ndarray, cuts: list[tuple[int, int]]) -> pa.Array:
    return pa.array([matrix[a:b].tobytes() for a, b in cuts], pa.binary())


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    sample: int = SAMPLE,
    list_size: int = LIST,
    spread: float = SPREAD,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Rows of one label link when the cosine of their vectors is ``threshold``
    or more, in double precision. Rows whose label or vector is null, whose
    vector is zero, empty or of another length than most, or holds a null or
    non-finite component, link with nothing. Every row is a vector of its own,
    also repeated ones and those without an id; equal vectors of a label count
    as linked and are compared once. ``component_id`` is the smallest id
    reachable by links, and ``kept`` marks the rows that have it. Centroids
    and code words are fitted on at most about ``sample`` distinct vectors;
    all vectors are indexed. An empty table gives an empty result. Extra
    columns are ignored.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col, label_col)
    lengths = usable.where("vector is not null").groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    keyed = usable.withColumn("key", F.when((F.col("dim") == dim) & F.col("vector").isNotNull(), F.sha2(F.concat_ws("\n", F.col("label"), _spelt(F.col("vector"))), 256)))
    keyed = keyed.withColumn("vector", F.when(F.col("key").isNotNull(), F.col("vector")))
    points = keyed.where("key is not null").groupBy("key").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"),
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"),
    )
    points = cut_lineage(points.withColumn("point", F.monotonically_increasing_id()))
    # Lists belong to one label, so the largest label says how many centroids keep them small.
    count, largest = points.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
    count, largest = count or 0, largest or 0
    kind = np.dtype("<f4" if isinstance(points.schema["vector"].dataType.elementType, FloatType) else "<f8")

    share = min(1.0, sample / max(count, 1))
    taken = points if share == 1 else points.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    grown = taken.orderBy("key").select("vector").toArrow().column("vector").combine_chunks()
    grown = units(grown.flatten().to_numpy().reshape(-1, dim)) if len(grown) else np.zeros((0, dim))
    quantiser = Quantiser(grown, min(CENTROIDS, math.ceil(largest / list_size)), threshold, spread)
    shared = spark.sparkContext.broadcast(quantiser)  # at most CENTROIDS centroids, their distances, and WORDS words

    entry = "label string, cell int, guest boolean, point long, copies long, vector binary, code binary, left double, others binary"
    names = [f.split()[0] for f in entry.split(", ")]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                n = batch.num_rows
                raw = batch.column("vector").flatten().to_numpy().astype(kind).reshape(n, dim)
                x = units(raw)
                own, row, guest = q.lists(x)
                codes, left = q.codes(x, own)
                at = np.concatenate([np.arange(n), row])
                starts = np.searchsorted(row, np.arange(n + 1))
                # A member says which lists it is a guest of, a guest which list it is a member of.
                others = [guest[a:b].astype("<i4").tobytes() for a, b in zip(starts, starts[1:])]
                others += [x.tobytes() for x in own[row].astype("<i4")[:, None]]
                take = pa.array(at)
                blobs = pa.array([r.tobytes() for r in raw], pa.binary())
                coded = pa.array([c.tobytes() for c in codes] + [b""] * len(row), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").take(take),
                        pa.array(np.concatenate([own, guest]).astype(np.int32)),
                        pa.array(np.arange(len(at)) >= n),
                        batch.column("point").take(take),
                        batch.column("copies").take(take),
                        blobs.take(take),
                        coded,
                        pa.array(np.concatenate([left, np.zeros(len(row))])),
                        pa.array(others, pa.binary()),
                    ],
                    names,
                )

    # Entered twice, for the ranges and for the packs, as an entry costs less than its place on disk.
    lists = points.select("label", "vector", "point", "copies").mapInArrow(enter, entry)
    # Ranges over (list, point): a hot list is dealt to as many tasks as its rows are worth.
    dealt = lists.repartitionByRange("label", "cell", "point").sortWithinPartitions("label", "cell", "guest", "point")
    pack_of = (
        "label string, cell int, guest boolean, pack long, points binary, copies binary, vectors binary, codes binary, "
        "lefts binary, others array<binary>"
    )
    pack_names = [f.split()[0] for f in pack_of.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            label, cell, guest = (batch.column(c).to_pylist() for c in ("label", "cell", "guest"))
            new = [i for i in range(1, n) if (label[i], cell[i], guest[i]) != (label[i - 1], cell[i - 1], guest[i - 1])]
            cuts = [(a, min(a + PACK, e)) for s, e in zip([0, *new], [*new, n]) for a in range(s, e, PACK)]
            joined = {c: batch.column(c).to_pylist() for c in ("vector", "code", "others")}
            point = batch.column("point").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([label[a] for a, _ in cuts], pa.string()),
                    pa.array([cell[a] for a, _ in cuts], pa.int32()),
                    pa.array([guest[a] for a, _ in cuts], pa.bool_()),
                    pa.array([int(point[a]) for a, _ in cuts], pa.int64()),
                    _blobs(point.astype("<i8"), cuts),
                    _blobs(batch.column("copies").to_numpy().astype("<i8"), cuts),
                    pa.array([b"".join(joined["vector"][a:b]) for a, b in cuts], pa.binary()),
                    pa.array([b"".join(joined["code"][a:b]) for a, b in cuts], pa.binary()),
                    _blobs(batch.column("left").to_numpy().astype("<f8"), cuts),
                    pa.array([joined["others"][a:b] for a, b in cuts], pa.list_(pa.binary())),
                ],
                pack_names,
            )

    packs = cut_lineage(dealt.mapInArrow(pack, pack_of))
    asking = packs.withColumnsRenamed({c: f"{c}_" for c in pack_names if c not in ("label", "cell")})
    members = packs.where("not guest").drop("guest")
    meeting = asking.join(members, ["label", "cell"]).where("guest_ or pack_ <= pack")
    columns = ["cell", "guest_", "pack_", "points_", "copies_", "vectors_", "others_", "pack", "points", "copies", "vectors", "codes", "lefts", "others"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        numbers: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> None:
            nonlocal held
            if numbers:
                who, n = (np.concatenate(c) for c in zip(*numbers))
                who, at = np.unique(who, return_inverse=True)
                numbers[:] = [(who, np.bincount(at, n, len(who)).astype(np.int64))]
            if edges:
                edges[:] = [spanning(*(np.concatenate(c) for c in zip(*edges)))]
            held = len(numbers[0][0]) + len(edges[0][0]) if numbers else 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for pair, has_n in ((numbers, True), (edges, False)):
                for a, b in pair:
                    other = pa.nulls(len(a), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a), other if has_n else pa.array(b), pa.array(b) if has_n else other], ["u", "v", "n"]
                    )

        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in columns}
                mine, theirs = np.frombuffer(r["points_"], "<i8"), np.frombuffer(r["points"], "<i8")
                x = units(np.frombuffer(r["vectors_"], kind).reshape(len(mine), dim))
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(theirs), -1)
                least = np.sqrt(q.distances(x, r["cell"], codes)) - np.frombuffer(r["lefts"], "<f8")
                i, j = np.nonzero(least <= q.radius + 1e-4)  # the tables are in single precision
                if not r["guest_"] and r["pack_"] == r["pack"]:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                y = units(np.frombuffer(r["vectors"], kind).reshape(len(theirs), dim))
                near = np.concatenate([(x[i[s : s + 65536]] * y[j[s : s + 65536]]).sum(axis=1) for s in range(0, len(i), 65536)]) >= threshold
                i, j = i[near], j[near]
                if r["guest_"] and len(i):
                    # A pair that also meets in the guest's own list counts in the lower one.
                    home = np.frombuffer(b"".join(r["others_"]), "<i4")
                    back = [np.frombuffer(o, "<i4") for o in r["others"]]
                    known = np.concatenate([k * (1 << 32) + o.astype(np.int64) for k, o in enumerate(back)])
                    twice = np.isin(j * (1 << 32) + home[i], known) & (home[i] < r["cell"])
                    i, j = i[~twice], j[~twice]
                if not len(i):
                    continue
                own, other = np.frombuffer(r["copies_"], "<i8"), np.frombuffer(r["copies"], "<i8")
                for who, at, n in ((mine, i, other[j]), (theirs, j, own[i])):
                    some = np.bincount(at, n, len(who)).astype(np.int64)
                    numbers.append((who[some > 0], some[some > 0]))
                    held += len(numbers[-1][0])
                edges.append(spanning(mine[i], theirs[j]))
                held += len(edges[-1][0])
                if held >= HELD:
                    merged()
                    if held >= HELD // 2:
                        yield from passed_on()
                        numbers, edges, held = [], [], 0
        merged()
        yield from passed_on()

    found = cut_lineage(meeting.select(columns).mapInArrow(compare, "u long, v long, n long"))
    numbers = found.where("n is not null").groupBy(F.col("u").alias("point")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("n is null").select("u", "v"))
    linked = cut_lineage(parts.join(points.select(F.col("point").alias("node"), "least"), "node"))
    reached = linked.groupBy("component").agg(F.min("least").alias("reached"))
    reached = linked.join(reached, "component").select(F.col("node").alias("point"), "reached")
    classes = cut_lineage(
        points.select("key", "point", "least", "copies")
        .join(numbers, "point", "left")
        .join(reached, "point", "left")
        .select(
            "key",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("reached", "least").alias("component_id"),
        )
    )
    answered = keyed.select("vec_id", "key").join(classes, "key", "left")
    alone = F.col("key").isNull()
    return answered.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
