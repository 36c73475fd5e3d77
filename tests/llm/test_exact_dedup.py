import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stemma.llm.components import connected_components
from stemma.llm.exact_dedup import exact_dedup
from stemma.llm.tables import keep_rows

LONG = "ab c" * 900


def expected(rows):
    """(doc_id, keep_id, group_size, sha) by a plain rule, ids null last."""
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in rows:
        same = groups[norm(text)]
        out.append((doc_id, min(same)[3], len(same), hashlib.sha256(norm(text).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb "), (5, None), (6, ""), (7, " \n"), (8, LONG), (9, LONG + "x"),
    (10, LONG + " "), (11, "é b"), (12, "é b"), (13, "éb"), (None, "zz"), (None, "only null"), (14, "z z"),
    (15, "b" + LONG), (16, LONG * 3), (17, LONG * 3 + "\r"), (18, LONG * 2),
]


@pytest.mark.parametrize("block,digest", [(64, None), (64, "weak"), (16384, None)])
def test_equal_texts_and_only_they_share_a_name(spark, block, digest):
    weak = lambda b: F.substring(F.unhex(F.md5(b)), 1, 1) if digest else F.unhex(F.md5(b))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    rows = exact_dedup(docs, block_bytes=block, digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == expected(ROWS)
    names = {}
    for r in rows:
        names.setdefault((r.n_blocks, r.name), set()).add(r.text_sha256)
    assert all(len(v) == 1 for v in names.values())
    assert sum(r.kept for r in rows) == len(names)


def test_repeated_rows_keep_one_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "x  y"), (2, "xy")], "doc_id long, text string")
    found = exact_dedup(docs)
    assert [(r.doc_id, r.kept) for r in found.collect()].count((1, True)) == 1
    assert found.where("kept").count() == 1
    assert [tuple(r) for r in keep_rows(docs, found.where("kept")).collect()] == [(1, "x  y")]
    assert exact_dedup(docs.limit(0)).count() == 0


def test_keep_rows_with_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(None, "a", 1), (None, "b", 2), (3, None, 3), (3, None, 4)], "doc_id long, text string, key int"
    )
    kept = exact_dedup(docs).where("kept")
    rows = keep_rows(docs, kept).collect()
    assert sorted(r.text or "" for r in rows) == ["", "a", "b"] and rows[0].__fields__ == docs.columns


def test_components_match_union_find(spark):
    import random

    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 160)]
    edges += [(200 + k, 201 + k) for k in range(40)] + [(7, 7), (7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    rows = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in rows} == {n: find(n) for n in parent}
    assert len(rows) == len(parent)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
