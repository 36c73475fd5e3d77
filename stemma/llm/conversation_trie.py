"""Prefix trie of conversations, built as a burst trie.

A conversation is the sequence of its turns, each named by a digest of role
and text. Equal sequences become one path with a count. Containers hold the
suffixes of the paths below a trie head. A container of more turns than
``limit`` bursts: what all its suffixes begin with becomes a run of trie nodes
in one step, and its suffixes go on, by their next turn, to the containers of
new heads. The containers that remain are dealt out by head, sorted, and swept
into nodes; what their top nodes sum up is added to the burst nodes above them,
last burst first.

A run of common turns costs one burst whatever its length, and a crowd of
copies is one path, so the rounds follow the forks of large containers only.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from stemma.llm.tables import text_or_empty
from stemma.session import cut_lineage

#: Bytes of a turn's name and of its number of code points.
NAME, SIZE = 16, 4
#: Turns that a container may hold; one with a single path is never burst.
LIMIT = 8192
#: Bytes of ids that are joined before they go on as one row.
PACK = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = (
    "up string, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, turn_key string"
)


def conversation_sequences(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, ids, chars): the names of a conversation's turns in order, 16 bytes each, and their code points, 4 bytes each.

    Turns go by ``turn``, null first; turns of one number by their names, and
    repeated rows are turns of their own. A null role or text counts as empty.
    Rows without a conversation are left out. Extra columns are ignored.
    """
    role, text = text_or_empty(f"`{role_col}`"), text_or_empty(f"`{text_col}`")
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    named = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.substring(F.sha2(told, 256), 1, 2 * NAME).alias("name"),
            F.lpad(F.hex(F.char_length(text)), 2 * SIZE, "0").alias("size"),
        ).alias("t"),
    )
    listed = named.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select(
        "conv_id", F.unhex(F.array_join("t.name", "")).alias("ids"), F.unhex(F.array_join("t.size", "")).alias("chars")
    )


def _cut(column: str, width: int, first: Column | int, turns: Column | int | None = None) -> Column:
    """Turns of a blob from turn ``first`` on (from 0), ``turns`` of them or all."""
    first = F.lit(first) if isinstance(first, int) else first
    turns = F.lit(1 << 20) if turns is None else F.lit(turns) if isinstance(turns, int) else turns
    return F.substring(F.col(column), (first * width + 1).cast("int"), (turns * width).cast("int"))


def grafted(sequences: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """``sequences`` whose first h turns are those of conversation c - c % group; h is the CRC-32 of c in decimal, modulo ``most``.

    The other conversation gives fewer turns if it has fewer and none if it is absent.
    """
    own = sequences.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    givers = sequences.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("giver"),
        _cut("ids", NAME, 0, most).alias("ids_"),
        _cut("chars", SIZE, 0, most).alias("chars_"),
    )
    both = own.join(givers, F.col("conv_id") - F.col("conv_id") % group == F.col("giver"), "left")

    def mixed(column: str, width: int) -> Column:
        given = F.coalesce(_cut(f"{column}_", width, 0, F.col("h")), F.lit(b""))
        return F.concat(given, _cut(column, width, F.col("h"))).alias(column)

    return both.select("conv_id", mixed("ids", NAME), mixed("chars", SIZE))


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each run of equal keys, also across batches."""
    rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
    return (list(run) for _, run in itertools.groupby(rows, lambda r: r[key]))


def distinct_paths(sequences: DataFrame) -> DataFrame:
    """(ids, chars, n, least, ends): equal sequences once, with their number, least id and the digest of all ids.

    ``ends`` is the SHA-256 of the decimal ids, ascending and joined by commas.
    Ids are dealt by ranges of (sequence, id), so a crowd of equal sequences
    is spread; one task then only digests the joined text of a crowd.
    """
    named = cut_lineage(sequences.select(F.sha2("ids", 256).alias("path"), "conv_id", "ids", "chars"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first, ids, chars, n, held, size = None, 0, b"", b"", 0, [], 0

        def packed() -> dict:
            return {"path": path, "first": first, "ids": ids, "chars": chars, "n": n, "joined": ",".join(held).encode()}

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("path", "conv_id", "ids", "chars"))):
                if n and (row[0] != path or size >= PACK):
                    out.append(packed())
                    n = 0
                if not n:
                    path, first, ids, chars = row
                    held, size = [], 0
                held.append(str(row[1]))
                size += len(held[-1]) + 1
                n += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, pack_schema)
        if n:
            yield pa.RecordBatch.from_pylist([packed()], pack_schema)

    pack_schema = pa.schema(
        [("path", pa.string()), ("first", pa.int64()), ("ids", pa.binary()), ("chars", pa.binary()), ("n", pa.int64()), ("joined", pa.binary())]
    )
    packs = (
        named.repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .mapInArrow(join, "path string, first long, ids binary, chars binary, n long, joined binary")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, sha = None, {}, hashlib.sha256()
        for batch in batches:
            out = []
            for pack in batch.to_pylist():
                if pack["path"] != now:
                    if row:
                        out.append(row | {"ends": sha.hexdigest()})
                    now, sha = pack["path"], hashlib.sha256()
                    row = {"ids": pack["ids"], "chars": pack["chars"], "n": 0, "least": pack["first"]}
                else:
                    sha.update(b",")
                sha.update(pack["joined"])
                row["n"] += pack["n"]
            yield pa.RecordBatch.from_pylist(out, path_schema)
        if row:
            yield pa.RecordBatch.from_pylist([row | {"ends": sha.hexdigest()}], path_schema)

    path_schema = pa.schema(
        [("ids", pa.binary()), ("chars", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())]
    )
    return (
        packs.repartition("path")
        .sortWithinPartitions("path", "first")
        .mapInArrow(digest, "ids binary, chars binary, n long, least long, ends string")
    )


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences of names begin with alike."""
    if a[:NAME] != b[:NAME]:
        return 0
    n = min(len(a), len(b)) // NAME
    x, y = (np.frombuffer(s, "<u8", 2 * n) for s in (a, b))
    other = np.flatnonzero(x != y)
    return int(other[0]) // 2 if len(other) else n


def _sizes(chars: bytes) -> list[int]:
    return np.frombuffer(chars, ">i4").tolist()


def sweep(paths: list[dict]) -> list[tuple]:
    """The nodes of one container, its head first, from its paths in the order of their suffixes; rows as in NODE."""
    head = paths[0]
    up, turn, size, n, least = [-1], [head["turn"]], [head["size"]], [0], [None]
    children, leaves, saved, ends, depth = [0], [0], [0], [NO_ENDS], [head["at"]]
    stack, before = [0], b""

    def close() -> None:
        k = stack.pop()
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * size[k]
        if stack:
            p = stack[-1]
            n[p] += n[k]
            least[p] = least[k] if least[p] is None else min(least[p], least[k])
            children[p] += 1
            leaves[p] += leaves[k]
            saved[p] += saved[k]

    for path in paths:
        ids, sizes = path["ids"], _sizes(path["chars"])
        shared = common_turns(before, ids)
        while len(stack) - 1 > shared:
            close()
        for j in range(shared, len(sizes)):
            up.append(stack[-1])
            stack.append(len(up) - 1)
            turn.append(ids[NAME * j : NAME * (j + 1)])
            size.append(sizes[j])
            depth.append(depth[0] + j + 1)
            n.append(0)
            least.append(None)
            children.append(0)
            leaves.append(0)
            saved.append(0)
            ends.append(NO_ENDS)
        k = stack[-1]
        n[k] += path["n"]
        least[k] = path["least"] if least[k] is None else min(least[k], path["least"])
        ends[k] = path["ends"]
        before = ids
    while stack:
        close()
    return [
        (
            head["up"] if k == 0 else None,
            least[k],
            depth[k],
            head["above"] if k == 0 else least[up[k]],
            n[k],
            children[k],
            leaves[k],
            saved[k],
            ends[k],
            turn[k].hex() if turn[k] is not None else None,
        )
        for k in range(len(up))
    ]


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in NODE.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for paths in _runs(batches, "head"):
        held += sweep(paths)
        if len(held) >= LIMIT:
            yield _node_batch(held)
            held = []
    yield _node_batch(held)


@F.pandas_udf(ArrayType(LongType()))
def _run_sizes(low: pd.Series, high: pd.Series, chars: pd.Series) -> pd.Series:
    """Code points of the turns that the least and the greatest suffix, and so all between, begin with."""
    return pd.Series(
        [np.array(_sizes(c)[: common_turns(bytes(a), bytes(b))], np.int64) for a, b, c in zip(low, high, chars)], dtype=object
    )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of burst runs: alike in members, and forked or ended only at the last."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            sizes = np.array([r["size"], *r["run"]], np.int64)
            saved = r["saved"] + (r["n_convs"] - 1) * np.cumsum(sizes[::-1])[::-1]
            last = len(sizes) - 1
            for i in range(len(sizes)):
                name = r["turn"] if i == 0 else r["low"][NAME * (i - 1) : NAME * i]
                out.append(
                    (
                        None,
                        r["conv_id"],
                        r["at"] + i,
                        r["above"] if i == 0 else r["conv_id"],
                        r["n_convs"],
                        r["n_children"] if i == last else 1,
                        r["n_leaves"],
                        int(saved[i]),
                        r["ends"] if i == last and r["ends"] else NO_ENDS,
                        name.hex() if name is not None else None,
                    )
                )
        yield _node_batch(out)


def conversation_trie(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_key.

    ``sequences`` are rows (conv_id, ids, chars) as `conversation_sequences`
    gives them, each id once. A node is named by its smallest member and its
    depth; ``turn_key`` is the name of its last turn (null at the root).
    ``saved_tokens`` sums (members - 1) x code points of the last text over
    the subtree. Sequences without turns are members of the root alone. An
    empty table gives an empty result.
    """
    waiting = distinct_paths(sequences).select(
        F.lit("").alias("head"),
        F.lit(None).cast("string").alias("up"),
        F.lit(0).alias("at"),
        F.lit(None).cast("long").alias("above"),
        F.lit(None).cast("binary").alias("turn"),
        F.lit(0).cast("long").alias("size"),
        "ids", "chars", "n", "least", "ends",
    )
    columns = waiting.columns
    settled, bursts = [], []
    while True:
        waiting = cut_lineage(waiting)
        weights = waiting.groupBy("head").agg(
            F.sum(F.octet_length("ids") / NAME + 1).alias("weight"), F.count(F.lit(1)).alias("paths")
        )
        heavy = cut_lineage(weights.where((F.col("weight") > limit) & (F.col("paths") > 1)).select("head"))
        if heavy.isEmpty():
            settled.append(waiting)
            break
        crowded = waiting.join(heavy, "head", "left_semi")
        least = lambda c: F.min_by(c, "ids").alias(c)
        burst = crowded.groupBy("head").agg(
            *[F.first(c).alias(c) for c in ("up", "at", "above", "turn", "size")],
            F.min("ids").alias("low"),
            F.max("ids").alias("high"),
            least("chars"),
            least("ends"),
            F.sum("n").alias("n_convs"),
            F.min("least").alias("conv_id"),
        )
        burst = burst.withColumn("run", _run_sizes("low", "high", "chars")).withColumn("shared", F.size("run"))
        ended = F.octet_length("low") == F.col("shared") * NAME
        burst = cut_lineage(
            burst.withColumn("ends", F.when(ended, F.col("ends")))
            .withColumn("low", _cut("low", NAME, 0, F.col("shared")))
            .drop("high", "chars")
        )
        bursts.append(burst)
        settled.append(waiting.join(heavy, "head", "left_anti"))
        forked = burst.select("head", "shared", F.col("conv_id").alias("above_"))
        moving = waiting.join(forked, "head").where(F.octet_length("ids") > F.col("shared") * NAME)
        fork = F.col("shared")
        waiting = moving.select(
            F.sha2(F.concat(F.col("head"), F.hex(_cut("ids", NAME, 0, fork + 1))).cast("binary"), 256).alias("head"),
            F.col("head").alias("up"),
            (F.col("at") + fork + 1).alias("at"),
            F.col("above_").alias("above"),
            _cut("ids", NAME, fork, 1).alias("turn"),
            F.conv(F.hex(_cut("chars", SIZE, fork, 1)), 16, 10).cast("long").alias("size"),
            _cut("ids", NAME, fork + 1).alias("ids"),
            _cut("chars", SIZE, fork + 1).alias("chars"),
            "n", "least", "ends",
        )
    containers = settled[0].select(columns)
    for more in settled[1:]:
        containers = containers.unionByName(more.select(columns))
    dealt = containers.repartition("head").sortWithinPartitions("head", "ids")
    nodes = dealt.mapInArrow(_swept, NODE)
    if bursts:
        nodes = cut_lineage(nodes)
        below = _summed(nodes.select("up", "n_leaves", F.col("saved_tokens").alias("total")))
        for burst in reversed(bursts):
            done = burst.join(below, "head").withColumn(
                "total", F.expr("saved + (n_convs - 1) * (size + aggregate(run, 0L, (a, b) -> a + b))")
            )
            done = cut_lineage(done)
            nodes = nodes.unionByName(done.mapInArrow(_chained, NODE))
            more = below.unionByName(_summed(done.select("up", "n_leaves", "total"))).groupBy("head")
            below = cut_lineage(more.agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")]))
    return nodes.drop("up")


def _summed(tops: DataFrame) -> DataFrame:
    """(head, n_children, n_leaves, saved): the sums of the containers and runs below each burst."""
    return tops.where("up is not null").groupBy(F.col("up").alias("head")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("total").alias("saved")
    )
