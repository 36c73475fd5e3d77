import numpy as np
from pyspark.sql import functions as F

from stemma.llm.neighbours import grow_tree, nearest_neighbours, search_forest

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in np.nonzero(ids % 20 == 0)[0]:
        score = (matrix * matrix[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), r.standard_normal(16).tolist()) for i in range(3000)]
    got = answers(nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, leaf=64))
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    found = 0
    for q, near in want.items():
        assert [x[0] for x in got[q]] == list(range(1, 21))
        assert [s for _, _, s in got[q]] == sorted((s for _, _, s in got[q]), reverse=True)
        found += len({i for i, _ in near} & {i for _, i, _ in got[q]})
    assert found >= 0.9 * 20 * len(want)


def test_ties_copies_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 90)] + [(200, [0.0, 1.0]), (201, [0.6, 0.8]), (202, [-1.0, 0.0])]
    got = answers(nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    want = brute(rows, 20)
    assert {q: [(i, round(s, 6)) for _, i, s in x] for q, x in got.items()} == {
        q: [(i, round(s, 6)) for i, s in x] for q, x in want.items()
    }
    few = answers(nearest_neighbours(spark.createDataFrame(rows[-3:], SCHEMA), F.col("vec_id") % 20 == 0))
    assert [i for _, i, _ in few[200]] == [201, 202]


def test_ties_among_different_vectors_go_to_the_smaller_id(spark):
    rows = [(0, [1.0] + [0.0] * 40)] + [(i, [0.5 if k == 0 else float(k == i) for k in range(41)]) for i in range(40, 0, -1)]
    got = answers(nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0))
    assert [i for _, i, _ in got[0]] == list(range(1, 21))


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [-1.0, -0.0]), (20, [0.0, -0.0]), (40, None),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as point", "1 as key")
    got = answers(nearest_neighbours(frame, F.col("vec_id") % 20 == 0))
    assert {q: [(i, s) for _, i, s in x] for q, x in got.items()} == {0: [(8, 3.0), (9, -1.0)]}
    assert nearest_neighbours(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0])], SCHEMA)
    assert nearest_neighbours(alone, F.col("vec_id") % 20 == 0).count() == 0


def test_tree_holds_every_vector_once_and_the_search_opens_all_leaves_in_the_end():
    r = np.random.default_rng(3)
    points = np.vstack([r.standard_normal((500, 8)), np.ones((300, 8))])
    forest = [grow_tree(points, 20, np.random.default_rng(i)) for i in range(3)]
    for tree in forest:
        leaves = tree.leaf_of(points)
        assert (np.bincount(leaves, minlength=tree.leaves) == tree.sizes).all()
    opened = search_forest(forest, points[0], 1e9)
    assert len(opened) == len(set(opened)) == sum(t.leaves for t in forest)
    assert opened[0][1] == forest[opened[0][0]].leaf_of(points[:1])[0]
