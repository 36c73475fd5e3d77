import random
import zlib

import numpy as np
import pytest

from stemma.llm.sentencepiece_codec import LITERAL, SPACE, Stream, codec, decode_ids, encode_texts


@pytest.fixture(scope="module")
def own():
    return codec()


def best_score(c, text):
    """The largest sum of scores over all splits, by the plain recurrence."""
    best = [0.0] + [None] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - c.longest), j):
            piece = c.pieces.get(text[i:j])
            if piece is None and j - i == 1:
                score = c.unknown
            elif piece is None:
                continue
            else:
                score = piece
            if best[i] is not None and (best[j] is None or best[i] + score > best[j]):
                best[j] = best[i] + score
    return best[-1]


@pytest.fixture(scope="module")
def scored(own):
    model = own.model
    skip = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    own.pieces = {model.id_to_piece(i): model.get_score(i) for i in range(len(model)) if not skip(i)}
    return own


def split_score(c, ids):
    """The score of ids: a run of byte pieces counts once per character."""
    total, raw = 0.0, b""
    for i in ids:
        if c.model.is_byte(i):
            raw += c.shown[i]
        else:
            total += c.model.get_score(i)
    return total + c.unknown * len(raw.decode())


def random_text(r, n):
    return "".join(r.choices("aaaeeetthhnnioss  .,éñ日ﬁ\n\t▁😀ThE", k=n))


def test_no_split_is_better(scored):
    r = random.Random(4)
    for n in [0, 1, 2, 3, 7, 20, 60, 200] * 6:
        text = random_text(r, n)
        normal = scored.normalised(text)
        ids = list(scored.encode(text))
        assert split_score(scored, ids) == pytest.approx(best_score(scored, normal), rel=1e-12)
        assert scored.decode(ids) == text
        assert list(scored.stream([normal])) == ids


def test_chunks_of_any_size_give_the_same_ids_in_a_bounded_window(own):
    r = random.Random(8)
    normal = own.normalised(random_text(r, 6000))
    whole = list(own.stream([normal]))
    for size in (1, 3, 17, 1000):
        search, out, widest = Stream(own), [], 0
        for at in range(0, len(normal), size):
            out += search.push(normal[at : at + size])
            widest = max(widest, len(search.text))
        assert out + search.push("", last=True) == whole
        if size <= 17:
            assert widest <= 6 * own.longest + size


def test_long_run_without_spaces(own):
    text = "ab" * 30_000 + "é" * 1000
    search, widest = Stream(own), 0
    out = []
    for at in range(0, len(text), 100):
        out += search.push(text[at : at + 100])
        widest = max(widest, len(search.text))
    out += search.push("", last=True)
    assert widest < 1000 and own.decode(out) == text


def test_space_sign_in_the_text_survives(own):
    assert LITERAL not in "any text" and own.decode(own.encode(f"a{SPACE}b {SPACE}")) == f"a{SPACE}b {SPACE}"


def test_table(spark, own):
    rows = [(1, "the cat"), (1, "the cat"), (2, None), (None, ""), (3, "  x\n y "), (4, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as restored")
    got = encode_texts(docs)
    for r, (doc_id, text) in zip(sorted(got.collect(), key=str), sorted(rows, key=lambda x: str(x))):
        assert r.restored and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())
    back = sorted((r.doc_id or 0, r.text) for r in decode_ids(got.select("doc_id", "ids")).collect())
    assert back == sorted((i or 0, t or "") for i, t in rows)
    assert encode_texts(docs.limit(0)).count() == 0
