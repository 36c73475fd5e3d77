import duckdb
import numpy as np

from stemma.llm.oracle import VECTOR_DEDUP
from stemma.llm.product_quantisation import Quantiser, near_duplicate_vectors, spanning, units

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    x = units(np.array([r[1] for r in rows], np.float32))
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= threshold) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    least = np.array(ids)
    while True:
        reach = np.minimum(least, np.where(near, least[None], 1 << 40).min(axis=1))
        if (reach == least).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), least)}
        least = reach


def answers(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def invented(seed, groups, dim, noise):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = units(r.standard_normal((1, dim)))[0]
        for _ in range(int(r.integers(1, 6))):
            shift = r.standard_normal(dim) * noise / np.sqrt(dim)
            rows.append((len(rows), (centre + shift).astype(np.float32).tolist(), int(r.integers(2))))
    return rows


def test_links_equal_all_pairs(spark):
    for dim, noise in ((64, 0.3), (8, 0.25)):
        rows = invented(dim, 500, dim, noise)
        got = answers(near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), list_size=32))
        want = brute(rows)
        found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
        assert there > 300 and all(got[i][0] <= want[i][0] for i in want)
        assert found >= 0.99 * there
        assert sum(got[i] == want[i] for i in want) >= 0.99 * len(rows)


def test_a_crowd_of_near_copies_and_equal_vectors(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal(16)
    rows = [(i, (centre + r.standard_normal(16) * 0.05).astype(np.float32).tolist(), 1) for i in range(900)]
    rows += [(1000 + i, [1.0] + [0.0] * 15, 2) for i in range(50)] + [(2000, [2.0] + [0.0] * 15, 2)]
    got = answers(near_duplicate_vectors(spark.createDataFrame(rows, SCHEMA), list_size=64))
    assert got == brute(rows)
    assert got[2000] == (50, 1000)


def test_unusable_rows_nulls_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0], 1), (11, [], 1), (None, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", cell int, key string")
    got = sorted((tuple(r) for r in near_duplicate_vectors(df).collect()), key=repr)
    links = {1: (2, 1, True), 2: (2, 1, False), None: (2, 1, False)}
    want = [(i, *links.get(i, (0, i, True))) for i, _, _ in rows]
    assert got == sorted(want, key=repr)
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_reach_of_half_the_radius_and_left_out_lengths_lose_nothing():
    r = np.random.default_rng(5)
    x = units(r.standard_normal((2000, 6)))
    q = Quantiser(x, 20)
    assert q.reach == q.radius / 2
    own, row, guest = q.lists(x)
    entered = {*zip(range(len(x)), own.tolist()), *zip(row.tolist(), guest.tolist())}
    codes, left = q.codes(x, own)
    i, j = np.nonzero(x @ x.T >= 0.93)
    for a, b in zip(i.tolist(), j.tolist()):
        assert (a, own[b]) in entered or (b, own[a]) in entered
        least = np.sqrt(q.distances(x[a : a + 1], own[b], codes[b : b + 1])[0, 0]) - left[b]
        assert least <= q.radius + 1e-4


def test_spanning_forest_has_the_components_of_the_edges():
    r = np.random.default_rng(7)
    u, v = r.integers(0, 200, 150), r.integers(0, 200, 150)
    a, b = spanning(u, v)
    least = {int(i): int(i) for i in {*u.tolist(), *v.tolist()}}
    for _ in range(200):
        for s, t in zip(u.tolist(), v.tolist()):
            least[s] = least[t] = min(least[s], least[t])
    assert {int(x): int(y) for x, y in zip(a, b)} == {i: m for i, m in least.items() if i != m}


def test_sql_says_the_same():
    rows = invented(9, 80, 8, 0.25)
    duck = duckdb.connect()
    duck.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    duck.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    found = duck.execute(f"SELECT vec_id, n_links, component_id FROM ({VECTOR_DEDUP})").fetchall()
    assert {i: (n, c) for i, n, c in found} == brute(rows)
