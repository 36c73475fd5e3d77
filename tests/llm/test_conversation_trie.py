import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from stemma.llm.conversation_trie import conversation_sequences, conversation_trie, grafted
from stemma.llm.oracle import CONVERSATION_TRIE

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v, key=lambda t: t[0])] for c, v in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def brute(sequences):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[: d - 1])].add(s[d - 1])
        ends[tuple(s)].append(c)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not kids[k]
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], digest(k))
        for k, m in members.items()
    )


def nodes(df):
    return sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        for r in df.collect()
    )


def invented(seed, convs, length, words):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c, t, r.choice(["user", None]), r.choice(words)) for t in range(r.randrange(length))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [4, 40, 8192])
def test_nodes_equal_those_of_a_plain_trie(spark, limit):
    rows = invented(1, 300, 6, ["a", "bb", "", "ccc é"])
    got = conversation_trie(grafted(conversation_sequences(spark.createDataFrame(rows, SCHEMA))), limit)
    assert nodes(got) == brute(rebuilt(rows))


def test_common_runs_copies_and_prefixes_burst_at_forks(spark):
    rows = []
    for c in range(60):  # a crowd of equal ones, all with one long beginning, some the beginning of others
        n = 30 if c % 2 else 30 + c % 7
        rows += [(c, t, "user", f"turn {t}") for t in range(n)]
        rows += [(c, 99, "user", f"last {c % 5}")] if c % 3 == 0 else []
    own = {c: [] for c in range(60)}
    for c, _, role, text in rows:
        own[c].append((role, text))
    got = conversation_trie(conversation_sequences(spark.createDataFrame(rows, SCHEMA)), 16)
    assert nodes(got) == brute(own)


def test_nulls_ties_empty_and_clashing_columns(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "x"), (2, None, "", ""), (2, 0, "user", "x"), (None, 0, "user", "y"),
        (3, 1, "user", "x"), (3, 1, "user", "x"), (5, 0, "user", "z" * 200_000), (-7, 0, "user", "x"),
    ]
    own = {1: [("", ""), ("user", "x")], 2: [("", ""), ("user", "x")], 3: [("user", "x")] * 2, 5: [("user", "z" * 200_000)], -7: [("user", "x")]}
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], SCHEMA + ", ids int, head string")
    assert nodes(conversation_trie(conversation_sequences(df))) == brute(own)
    none = conversation_sequences(spark.createDataFrame([], SCHEMA))
    assert conversation_trie(grafted(none)).collect() == []


def test_a_conversation_can_be_left_without_turns(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(lone, 0, "user", "gone"), (lone + 100, 0, "user", "kept" * 3)]
    got = conversation_trie(grafted(conversation_sequences(spark.createDataFrame(rows, SCHEMA))))
    assert nodes(got) == brute(rebuilt(rows))


def test_sql_says_the_same(spark):
    rows = [r for r in invented(3, 250, 5, ["a", "bb", "ccc"]) if r[0] != 100]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = "conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    want = sorted(duck.execute(f"SELECT {names} FROM ({CONVERSATION_TRIE})").fetchall())
    assert want == brute(rebuilt(rows))
