import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stemma.llm.token_alignment import (
    BYTES_VOCABULARY,
    PIECES_VOCABULARY,
    Pair,
    Rows,
    align_documents,
    group_links,
    groups_of,
    overlap_links,
    parts_of,
    token_links,
)

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path(BYTES_VOCABULARY))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES_VOCABULARY))


def letters():
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}


def brute(rows, libraries):
    first, second = libraries
    of = letters()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_bytes = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, second.id_to_piece(i)) for i in b)
        ]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
            docs.append((doc_id, [], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in own]).tolist() for own in (a_bytes, b_bytes)]
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0].index(e)], b[ends[1].index(e)]) for e in both]
        counts.update(links)
        groups, i, j = [], 0, 0
        for e in both:
            k, n = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:n])))
            i, j = k, n
        docs.append((doc_id, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        ((d, len(a), len(b), len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for d, a, b, x, h in docs),
        key=repr,
    )


def strange(seed, n):
    r = random.Random(seed)
    signs = ["a", "b", " ", "  ", "\n", "é", "漢", "😀", "́", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "the ", "ing", "1", "'s", "\t", "\x00"]
    return ["".join(r.choice(signs) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def test_product_equals_the_dense_one():
    r = np.random.default_rng(1)
    for _ in range(20):
        dense = [(r.random(s) < 0.3) * r.integers(1, 5, s) for s in ((7, 9), (9, 5))]
        rows = []
        for m in dense:
            at = np.nonzero(m)
            rows.append(Rows(np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))]), at[1], m[at]))
        i, j, data = rows[0].times(rows[1], 5).entries()
        got = np.zeros((7, 5), int)
        got[i, j] = data
        assert (got == dense[0] @ dense[1]).all()
        back = rows[0].transposed(9)
        i, j, data = back.entries()
        turned = np.zeros((9, 7), int)
        turned[i, j] = data
        assert (turned == dense[0].T).all()


def test_links_of_both_kinds():
    a, b = np.array([1, 3, 2]), np.array([2, 2, 2])
    assert [x.tolist() for x in overlap_links(a, b)] == [[0, 1, 1, 2], [0, 0, 1, 2], [1, 1, 2, 2]]
    own, other, n = groups_of(a, b)
    assert (own.tolist(), other.tolist(), n) == ([0, 0, 1], [0, 0, 1], 2)
    assert [x.tolist() for x in group_links(own, other, n)] == [[0, 0, 1, 1, 2], [0, 1, 0, 1, 2]]


def test_ids_are_those_of_the_libraries(libraries):
    pair = Pair(BYTES_VOCABULARY, PIECES_VOCABULARY)
    texts = [t for t in strange(5, 400) if "▁" not in t]
    for text, a, b in zip(texts, *pair.encode(texts)):
        if len(a):
            assert a.tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids
            assert b.tolist() == libraries[1].encode(text)


def test_long_texts_are_cut_where_no_token_crosses(libraries):
    r = random.Random(2)
    text = "".join(r.choice([" ", "  ", "word", "x", "\n ", " \n", "é", "."]) for _ in range(20_000))
    parts = parts_of(text, 500)
    assert len(parts) > 50 and " ".join(parts) == text
    assert [i for p in parts for i in libraries[0].encode(" " + p, add_special_tokens=False).ids] == libraries[0].encode(" " + text).ids
    assert [i for p in parts for i in libraries[1].encode(p)] == libraries[1].encode(text)


@pytest.mark.parametrize("chunk_bytes", [500, 1 << 22])
def test_documents_equal_the_plain_alignment(spark, libraries, chunk_bytes):
    texts = strange(7, 150) + ["a ▁ b", "▁", None, "", " ", "same words here"] + ["same words here"] * 40 + ["word é " * 30_000]
    rows = list(enumerate(texts)) + [(3, "repeated id"), (None, "no id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", chunk int").repartition(3)
    got = align_documents(df, chunk_bytes=chunk_bytes).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
    want = brute([r for r in rows if len(r[1] or "") < 1000], libraries)
    long = [tuple(r) for r in got.collect()]
    assert len(long) == len(rows)
    if chunk_bytes == 500:
        short = align_documents(df.where("text is null or length(text) < 1000"), chunk_bytes=500)
        assert sorted((tuple(r) for r in short.collect()), key=repr) == want
    else:
        small = [r for r in long if r[0] != texts.index("word é " * 30_000)]
        assert [r[:5] + r[7:] for r in sorted(small, key=repr)] == [r[:5] + r[7:] for r in want]


def test_link_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "unbelievable naïveté"), (2, None)], SCHEMA)
    links = token_links(df).collect()
    digest = align_documents(df).where("doc_id = 1").first()
    assert sum(r.end_together for r in links) == digest.n_links == digest.n_groups
    assert sum(r.shared_bytes for r in links) == len(" unbelievable naïveté".encode())
    assert {r.doc_id for r in links} == {1}
    inside = token_links(df, "group").collect()
    assert {(r.a_index, r.b_index) for r in links} <= {(r.a_index, r.b_index) for r in inside}
    assert align_documents(spark.createDataFrame([], SCHEMA)).collect() == []
