import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stemma.llm.packing import CAPACITY, VOCABULARY, WordEncoder, _best_fit, pack_documents, plan_packing

PATH = public_tokenizers.path(VOCABULARY)


def test_words_give_the_ids_of_the_whole_text():
    whole, words = Tokenizer.from_file(PATH), WordEncoder(PATH)
    r = random.Random(5)
    signs = "abcXYZ019éÉßÑñİıǅǆ日本'!?.,;:-_*$&%#|<>@́­ \x85\x1c\t\r\x0b\x00😀ªº²½"
    texts = ["", " ", "\n\n", "it's we'll <|endoftext|> a<|startoftext|>b", "A" * 300, "don't stop!!! 2024-01-02 (x)"]
    texts += ["".join(r.choices(signs + "  \n", k=r.randrange(80))) for _ in range(400)]
    for text in texts:
        assert words.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_all_plain_signs_split_as_the_tokenizer_does():
    whole, words = Tokenizer.from_file(PATH), WordEncoder(PATH)
    r = random.Random(6)
    plain = [chr(c) for c in range(0x20, 0x250)] + list("\n\n    ''''stremvld....,,")
    texts = ["".join(r.choices(plain if k % 2 else "abcdeST .,;'!?-09\n<>_[]", k=r.randrange(60))) for k in range(1500)]
    ids, starts = words.encode_all(pa.array(["", *texts, ""])[1:-1])
    for text, begin, till in zip(texts, starts, starts[1:]):
        assert ids[begin:till].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize(
    "histogram",
    [
        {}, {2048: 7}, {1: 5}, {1025: 9}, {1024: 9}, {700: 10, 648: 10, 1400: 10}, {2047: 3, 1: 2, 2: 9},
        {s: 1 + s % 5 for s in range(3, 2000, 7)}, {1300: 4000, **{s: 3 for s in range(5, 800)}},
    ],
)
def test_plan_holds_every_piece_once_and_is_near_the_bound(histogram):
    plan, bound = plan_packing(histogram)
    assert all(sum(s * n for s, n in c) <= CAPACITY for c, _ in plan)
    held = Counter()
    for config, times in plan:
        for s, n in config:
            held[s] += n * times
    assert held == Counter(histogram)
    used = sum(n for _, n in plan)
    left = np.zeros(CAPACITY + 1, np.int64)
    for s, n in histogram.items():
        left[s] = n
    assert bound - 1e-6 <= used <= max(1.01 * sum(_best_fit(left).values()), np.ceil(bound) + 1)


def test_pieces_of_documents(spark):
    tokenizer = Tokenizer.from_file(PATH)
    r = random.Random(2)
    vocabulary = "one two three idiot über naïve x, y. 12".split()
    rows = [(i, " ".join(r.choices(vocabulary, k=r.choice([0, 3, 50, 900, 2500, 9000])))) for i in range(40)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as length").repartition(5)
    got = pack_documents(docs, with_ids=True).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), CAPACITY)):
            piece = np.array(ids[at : at + CAPACITY], "<u4").tobytes()
            want[(doc_id, k, at, len(piece) // 4, zlib.crc32(piece), piece)] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, bytes(x.ids)) for x in got) == want
    sequences = defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    total = sum(x.length for x in got)
    assert len(sequences) <= -(-total // CAPACITY) + 1
    assert pack_documents(docs.limit(0)).count() == 0
