"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample: a node parts its vectors at the median of
their projections on a random direction. Every vector is then sent to its leaf
in each tree. A query walks all trees with one priority queue of branches, in
the order of how far they lie beyond the splits on the way in all, until the
leaves it has opened hold enough vectors. The candidates in these leaves are ranked
by their exact inner products.

That happens in two steps. The leaf that a query falls into in each tree gives
a bound, the score of its (k + 1)-th best candidate so far; from the other
leaves only what reaches the bound is passed on.

Vectors and queries meet in packs: one row holds up to PACK vectors of a leaf,
another up to PACK queries that opened it, and their join compares two packs
by one matrix product. Equal vectors are one point of the forest, so a hot
vector does not fill a leaf.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.session import cut_lineage

TREES = 8
#: Vectors that the trees are grown on, and the vectors of the whole table that a leaf should hold.
SAMPLE = 20_000
LEAF = 512
#: The opened leaves of a query hold SEARCH x n ** POWER vectors together; a vector counts in each tree. Chosen for
#: a recall of 0.95 on vectors without any structure, for which the needed share is largest.
SEARCH, POWER = 24.0, 0.68
PACK = 256
#: Rows of a leaf from which its packs are gathered by several tasks.
SLICE_ROWS = 8192
#: Scored pairs that a task gathers before it merges them.
HELD = 1 << 20
SEED = 42


@dataclass
class Tree:
    """Split nodes in breadth-first order: directions, thresholds, children (a leaf is -1 - its number)."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    leaves: int
    sizes: np.ndarray

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), np.int64)
        if not len(self.thresholds):
            return at
        open_rows = np.arange(len(vectors))
        while len(open_rows):
            node = at[open_rows]
            side = (vectors[open_rows] * self.directions[node]).sum(axis=1) > self.thresholds[node]
            at[open_rows] = self.children[node, side.astype(int)]
            open_rows = open_rows[at[open_rows] >= 0]
        return -1 - at


def grow_tree(sample: np.ndarray, leaf: float, random: np.random.Generator) -> Tree:
    """Split while a node holds more than ``leaf`` vectors of the sample and they differ in projection."""
    directions, thresholds, children, sizes = [], [], [], []
    waiting = [(np.arange(len(sample)), -1, 0)]
    while waiting:
        rows, parent, side = waiting.pop(0)
        own, cut = None, 0.0
        if len(rows) > leaf:
            a, b = sample[random.choice(rows, 2, replace=False)]
            own = a - b
            if not own.any():
                own = random.standard_normal(sample.shape[1])
            own = own / np.linalg.norm(own)
            reach = (sample[rows] * own).sum(axis=1)
            cut = float(np.median(reach))
            right = reach > cut
            if right.all() or not right.any():
                own = None
        if own is None:
            name = -1 - len(sizes)
            sizes.append(len(rows))
        else:
            name = len(thresholds)
            directions.append(own)
            thresholds.append(cut)
            children.append([0, 0])
            waiting += [(rows[~right], name, 0), (rows[right], name, 1)]
        if parent >= 0:
            children[parent][side] = name
    dim = sample.shape[1]
    return Tree(
        np.array(directions).reshape(-1, dim), np.array(thresholds), np.array(children, np.int64).reshape(-1, 2), len(sizes), np.array(sizes)
    )


def search_forest(forest: list[Tree], query: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one shared queue, until the leaves hold ``wanted`` vectors of the sample."""
    reach = [t.directions @ query - t.thresholds if len(t.thresholds) else np.zeros(0) for t in forest]
    queue = [(0.0, i, 0 if len(t.thresholds) else -1) for i, t in enumerate(forest)]
    found, held = [], 0
    while queue and held < wanted:
        far, i, node = heapq.heappop(queue)
        tree = forest[i]
        while node >= 0:
            margin = reach[i][node]
            side = int(margin > 0)
            heapq.heappush(queue, (far + abs(margin), i, int(tree.children[node, 1 - side])))
            node = int(tree.children[node, side])
        found.append((i, -1 - node))
        held += tree.sizes[-1 - node]
    return found


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, dim): double vectors with an id, without null, zero and non-finite ones."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull())
        .withColumn("dim", F.size("vector"))
        .where(~bad & F.exists(v, lambda x: x != 0))
    )


def _blob(vector: Column) -> Column:
    """The vector as text, which is equal for equal vectors only (negative zero is zero)."""
    return F.array_join(F.transform(vector, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string")), ",")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(rows: DataFrame, dim: int, expected: float) -> DataFrame:
    """Rows (tree, leaf, point, vector, bound) as packs (tree, leaf, points, vectors, bounds) of up to PACK rows each.

    A leaf of which many more than SLICE_ROWS rows are expected is dealt to several tasks.
    """
    slices = max(1, math.ceil(expected / SLICE_ROWS))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("point"), F.lit(slices)))
    sorted_rows = dealt.repartition("tree", "leaf", "slice").sortWithinPartitions("tree", "leaf")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, leaf = (batch.column(c).to_numpy() for c in ("tree", "leaf"))
            point, bound = batch.column("point").to_numpy(), batch.column("bound").to_numpy()
            matrix = _matrix(batch.column("vector"), dim)
            new = np.concatenate([[0], np.nonzero((np.diff(tree) != 0) | (np.diff(leaf) != 0))[0] + 1, [len(tree)]])
            out = [(a, min(a + PACK, e)) for s, e in zip(new, new[1:]) for a in range(s, e, PACK)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([tree[a] for a, _ in out], pa.int32()),
                    pa.array([leaf[a] for a, _ in out], pa.int32()),
                    pa.array([point[a:b].astype("<i8").tobytes() for a, b in out], pa.binary()),
                    pa.array([matrix[a:b].astype("<f8").tobytes() for a, b in out], pa.binary()),
                    pa.array([bound[a:b].astype("<f8").tobytes() for a, b in out], pa.binary()),
                ],
                ["tree", "leaf", "points", "vectors", "bounds"],
            )

    return sorted_rows.select("tree", "leaf", "point", "vector", "bound").mapInArrow(
        pack, "tree int, leaf int, points binary, vectors binary, bounds binary"
    )


def _best(found: list[tuple[np.ndarray, ...]], keep: int) -> tuple[np.ndarray, ...]:
    """Of (query, point, score) rows, each query's ``keep`` best points, once each, and those that tie with the last."""
    query, point, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((point, -score, query))
    query, point, score = query[order], point[order], score[order]
    # A pair has the same score wherever it is computed, so its repeats stand together.
    new = np.concatenate([[True], (query[1:] != query[:-1]) | (point[1:] != point[:-1])])
    query, point, score = query[new], point[new], score[new]
    _, first, number = np.unique(query, return_index=True, return_counts=True)
    last = np.repeat(score[first + np.minimum(number, keep) - 1], number)
    return query[score >= last], point[score >= last], score[score >= last]


def _compared(pairs: DataFrame, dim: int, keep: int) -> DataFrame:
    """(query, point, score): each query's ``keep`` best points among the packs of a task, with exact scores.

    A task merges what its packs give before anything is shuffled; it passes
    its rows on early where they are more than HELD after merging.
    """

    def batch_of(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["query", "point", "score"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        held = merged = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("queries", "query_vectors", "points", "vectors", "query_bounds")]
            for row in range(batch.num_rows):
                raw = [c[row].as_py() for c in columns]
                queries, points = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[2], "<i8")
                q, v = (np.frombuffer(x, "<f8").reshape(-1, dim) for x in (raw[1], raw[3]))
                near, last = q @ v.T, np.frombuffer(raw[4], "<f8")
                if len(points) > keep:
                    last = np.maximum(last, np.partition(near, -keep, axis=1)[:, -keep])
                # All that may tie with the last one asked for, whatever the rounding of the product.
                at, best = np.nonzero(near >= (last - 1e-9 * (1 + np.abs(np.maximum(last, -1e300))))[:, None])
                if not len(at):
                    continue
                found.append((queries[at], points[best], (q[at] * v[best]).sum(axis=1)))
                held += len(at)
                if held >= merged + HELD:
                    found = [_best(found, keep)]
                    held = merged = len(found[0][0])
                    if held >= HELD:
                        yield batch_of(found[0])
                        found, held, merged = [], 0, 0
        if found:
            yield batch_of(_best(found, keep))

    return pairs.mapInArrow(compare, "query long, point long, score double")


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    search: float = SEARCH,
    power: float = POWER,
    leaf: int = LEAF,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest by inner product, ties to the smaller id.

    ``is_query`` is a condition on the column ``vec_id``. Every row but the
    query's own id is a candidate. Vectors that are null, empty or zero or hold
    null or non-finite components take no part, nor do rows without an id and
    vectors of another length than most. Of rows with one id, one counts. All
    rows are indexed; only the splits of the trees come from a sample of at
    most about ``sample`` distinct vectors. An empty table gives an empty
    result. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col)
    lengths = usable.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 1
    keyed = usable.where(F.col("dim") == dim).withColumn("key", F.sha2(_blob(F.col("vector")), 256))
    rows = cut_lineage(
        keyed.groupBy("vec_id")
        .agg(F.min("key").alias("key"), F.min_by("vector", "key").alias("vector"))
        .withColumn("query", is_query)
    )
    # A point is a distinct vector, named by its smallest id. Ties go to the smaller id, so among equal vectors
    # only the k + 1 smallest ids can be in an answer.
    points = cut_lineage(
        rows.groupBy("key").agg(
            F.min("vec_id").alias("point"), F.min_by("vector", "vec_id").alias("vector"), F.max("query").alias("query")
        )
    )
    first = W.partitionBy("key").orderBy("vec_id")
    members = rows.select("key", "vec_id").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    members = cut_lineage(members.join(points.select("key", "point"), "key").select("point", "vec_id"))
    sizes = points.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("query").cast("long")).alias("queries")).first()
    count, asking = sizes["n"], sizes["queries"] or 0
    share = min(1.0, sample / max(count, 1))
    taken = points if share == 1 else points.where(F.pmod(F.xxhash64("point"), F.lit(1 << 20)) < int(share * (1 << 20)))
    grown = taken.orderBy("point").select("vector").toArrow().column("vector").combine_chunks()
    grown = _matrix(grown, dim) if len(grown) else np.zeros((0, dim))
    scale = len(grown) / max(count, 1)
    forest = [grow_tree(grown, max(leaf * scale, 4.0), np.random.default_rng((SEED, i))) for i in range(trees)]
    shared = spark.sparkContext.broadcast(forest)  # at most trees x sample / 4 directions
    held = search * count**power
    wanted = held * scale

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("vector"), dim)
            for i, tree in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(matrix), i, np.int32)), pa.array(tree.leaf_of(matrix).astype(np.int32)), batch.column("point"), batch.column("vector")],
                    ["tree", "leaf", "point", "vector"],
                )

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened = [search_forest(shared.value, v, wanted) for v in _matrix(batch.column("vector"), dim)]
            at = pa.array([i for i, o in enumerate(opened) for _ in o], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for o in opened for t, _ in o], pa.int32()),
                    pa.array([n for o in opened for _, n in o], pa.int32()),
                    batch.column("point").take(at),
                    # The queue begins with the roots, so the first leaves are the query's own.
                    pa.array([k < trees for o in opened for k in range(len(o))], pa.bool_()),
                ],
                ["tree", "leaf", "point", "own"],
            )

    no_bound = F.lit(float("-inf")).alias("bound")
    leaf_rows = points.select("point", "vector").mapInArrow(leaves, "tree int, leaf int, point long, vector array<double>")
    index = cut_lineage(_packed(leaf_rows.select("*", no_bound), dim, leaf).drop("bounds"))
    asking_points = points.where("query").select("point", "vector")
    opened = cut_lineage(asking_points.mapInArrow(probes, "tree int, leaf int, point long, own boolean"))

    def compared(asked: DataFrame) -> DataFrame:
        packs = _packed(asked, dim, asking * held / max(count, 1)).withColumnsRenamed(
            {"points": "queries", "vectors": "query_vectors", "bounds": "query_bounds"}
        )
        found = _compared(cut_lineage(packs).join(index, ["tree", "leaf"]), dim, k + 1)
        return cut_lineage(found.groupBy("query", "point").agg(F.max("score").alias("score")))

    near_first = compared(opened.where("own").drop("own").join(asking_points.select("*", no_bound), "point"))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))
    bounds = near_first.withColumn("n", place).where(F.col("n") == k + 1).select(F.col("query").alias("point"), "score")
    bounded = asking_points.join(bounds, "point", "left").select(
        "point", "vector", F.coalesce("score", F.lit(float("-inf"))).alias("bound")
    )
    rest = compared(opened.where("not own").drop("own").join(bounded, "point"))
    scored = near_first.unionByName(rest).groupBy("query", "point").agg(F.max("score").alias("score"))

    # k + 1 points hold at least k ids besides the query's own; points that tie with the last stay until ids decide.
    near = scored.withColumn("n", F.rank().over(W.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") <= k + 1)
    top = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    answers = (
        near.drop("n").join(members, "point").withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).drop("n")
    )
    names = points.select("key", F.col("point").alias("query"))
    queries = rows.where("query").select("key", F.col("vec_id").alias("query_id")).join(names, "key")
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(answers, "query")
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
