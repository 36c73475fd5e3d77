import random

import numpy as np
import pytest
import xxhash

from stemma.llm.components import connected_components
from stemma.llm.simhash_dedup import fingerprint, links, simhash_dedup


def plain(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance):
    prints = np.array(sorted(prints), np.int64)
    parent = {int(p): int(p) for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in prints:
        for q in prints[np.bitwise_count(prints.view(np.uint64) ^ p.view(np.uint64)) <= distance]:
            a, b = find(int(p)), find(int(q))
            parent[max(a, b)] = min(a, b)
    return {p: find(p) for p in parent}


def test_fingerprint_is_the_majority_of_shingle_bits():
    r = random.Random(1)
    texts = ["", " \t", "A", "a B", "a b c", "É x y z é", "a\x0bb\x0cc d"] + [
        " ".join(r.choices("the of a Xyz über 日本 q".split(), k=r.randrange(60))) for _ in range(30)
    ]
    assert [fingerprint(t.encode()) for t in texts] == [plain(t) for t in texts]
    long = " ".join(str(i % 977) for i in range(70_000))
    assert fingerprint(long.encode()) == plain(long)


@pytest.mark.parametrize("distance,limit", [(2, 64), (2, 2), (4, 3)])
def test_links_connect_the_same_classes_as_all_pairs(spark, distance, limit):
    r = random.Random(distance)
    prints = set()
    for _ in range(25):
        seed = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 6, 20])):
            seed ^= sum(1 << b for b in set(r.choices(range(64), k=r.choice([1, 1, 2, 3, 5]))))
            prints.add(seed - (1 << 64) if seed >> 63 else seed)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {x.node: x.component for x in connected_components(links(df, distance, limit)).collect()}
    want = classes(prints, distance)
    assert {p: found.get(p, p) for p in prints} == want
    assert len(set(want.values())) < len(prints)


def test_documents_of_a_class(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (5, base), (3, base + " x"), (9, base.upper()), (9, base.upper()), (None, base), (4, None), (6, " \n"), (7, "solo text"),
        (None, "nobody"), (8, "w " * 3000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    found = simhash_dedup(docs).collect()
    assert len(found) == len(rows)
    want = classes([f - (1 << 64) if (f := plain(t or "")) >> 63 else f for _, t in rows], 2)
    by = {}
    for r in found:
        f = int(r.fingerprint, 16)
        by.setdefault(want[f - (1 << 64) if f >> 63 else f], []).append(r)
    for group in by.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.component_id for r in group} == {min(ids) if ids else None}
        assert sum(r.kept for r in group) == 1
    assert {r.component_id for r in found if r.doc_id in (4, 6)} == {4}
    assert simhash_dedup(docs.limit(0)).count() == 0
