"""Alignment of two tokenizers over the same bytes by sparse incidence matrices.

Both tokenizers cut the same bytes, a space and the text. Matrix A has a row
per token of the first and a column per byte, B one row per token of the
second; both are compressed sparse rows built by hand. The product A x B' by
Gustavson's row-by-row scheme holds how many bytes two tokens share: its
entries are the overlap links. Where tokens of both end together a group ends;
the product of the incidence matrices tokens x groups holds the links within
groups.

Texts are cut into chunks. A chunk is one row with the distinct id pairs of
its links, how often it has each, and its links as places in that list. Pairs
are counted over all chunks by a grouped sum, and the counts come back to the
chunks by a join on the pair and one on the chunk, so no table of pairs is
held anywhere whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from stemma.llm.tables import text_or_empty
from stemma.session import cut_lineage

BYTES_VOCABULARY = "byte_bpe_50k.json"
PIECES_VOCABULARY = "piece_bpe_32k.model"
#: Characters from which a text is cut before a space that follows another sign; neither tokenizer joins across.
LONG = 1 << 16
#: Bytes tokenized and multiplied at once, and bytes whose pairs are listed together.
BLOCK, CHUNK = 1 << 19, 1 << 22

_workers: dict[tuple[str, str], Pair] = {}


def _letter_bytes() -> dict[str, int]:
    """The byte-level alphabet: visible Latin-1 signs stand for themselves, other bytes for U+0100 and on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _path(vocabulary: str) -> str:
    return vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)


def parts_of(text: str, long: int = LONG) -> list[str]:
    """The text in parts of about ``long`` characters; a part but the first begins after a space that follows another sign."""
    parts, start = [], 0
    while len(text) - start > long:
        at = text.find(" ", start + long)
        while at > 0 and text[at - 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[start:at])
        start = at + 1
    return [*parts, text[start:]]


class Pair:
    """The two tokenizers: ids of a text as it stands after a space, and the bytes of every id."""

    def __init__(self, first: str, second: str):
        with open(_path(first), encoding="utf-8") as file:
            model = json.load(file)
        letters = _letter_bytes()
        ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items()}
        # The vocabulary numbers its entries in the order of its merges, so ids serve as ranks.
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=_path(second))
        self.a_bytes = np.array([b""] * (max(ranks.values()) + 1), object)
        for word, i in ranks.items():
            self.a_bytes[i] = word
        of = self.second
        self.b_bytes = np.array(
            [
                bytes([int(of.id_to_piece(i)[3:5], 16)]) if of.is_byte(i) else of.id_to_piece(i).replace("▁", " ").encode()
                for i in range(of.get_piece_size())
            ]
            + [b""],
            object,
        )[:-1]
        self.a_width = np.array([len(b) for b in self.a_bytes])
        self.b_width = np.array([len(b) for b in self.b_bytes])
        most = max(len(self.a_bytes), len(self.b_bytes))
        # How an id is written as the first of its group, the first of the second tokenizer's in it, and else.
        self.written = np.array([[f"{sign}{i}".encode() for i in range(most)] for sign in ";|,"], object)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers; none where the text is empty or the joined bytes of either differ from a space and the text."""
        parts = [parts_of(t) for t in texts]
        flat = [p for own in parts for p in own]
        first = self.first.encode_ordinary_batch([" " + p for p in flat], num_threads=1)
        second = self.second.encode(flat, num_threads=1)
        a, b, at = [], [], 0
        for text, own in zip(texts, parts):
            x = np.array([i for p in first[at : at + len(own)] for i in p], np.int64)
            y = np.array([i for p in second[at : at + len(own)] for i in p], np.int64)
            at += len(own)
            raw = b" " + text.encode()
            if not text or b"".join(self.a_bytes[x]) != raw or b"".join(self.b_bytes[y]) != raw:
                x = y = np.zeros(0, np.int64)
            a.append(x)
            b.append(y)
        return a, b


def _pair(first: str, second: str) -> Pair:
    if (first, second) not in _workers:
        _workers[first, second] = Pair(first, second)
    return _workers[first, second]


@dataclass
class Rows:
    """A sparse matrix in compressed rows: row i has the columns ``cols[starts[i]:starts[i + 1]]`` with ``data``."""

    starts: np.ndarray
    cols: np.ndarray
    data: np.ndarray

    @classmethod
    def intervals(cls, widths: np.ndarray) -> Rows:
        """Row i holds ones in the next ``widths[i]`` columns."""
        starts = np.concatenate([[0], np.cumsum(widths)])
        return cls(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64))

    @classmethod
    def members(cls, column: np.ndarray) -> Rows:
        """Row i holds a one in ``column[i]``."""
        return cls(np.arange(len(column) + 1), column, np.ones(len(column), np.int64))

    def transposed(self, columns: int) -> Rows:
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        if len(self.cols) and (np.diff(self.cols) < 0).any():
            order = np.argsort(self.cols, kind="stable")
            row, cols, data = row[order], self.cols[order], self.data[order]
        else:
            cols, data = self.cols, self.data
        return Rows(np.concatenate([[0], np.cumsum(np.bincount(cols, minlength=columns))]), row, data)

    def times(self, other: Rows, columns: int) -> Rows:
        """Gustavson's product: row i is the sum of the rows of ``other`` that row i's columns name, by its data."""
        rows = len(self.starts) - 1
        number = np.diff(other.starts)[self.cols]
        row = np.repeat(np.repeat(np.arange(rows), np.diff(self.starts)), number)
        if (number == 1).all():
            at, data = other.starts[self.cols], self.data
        else:
            before = np.cumsum(number) - number
            at = np.arange(number.sum()) - np.repeat(before - other.starts[self.cols], number)
            data = np.repeat(self.data, number)
        key, data = row * columns + other.cols[at], data * other.data[at]
        if not len(key):
            return Rows(np.zeros(rows + 1, np.int64), key, data)
        if (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, data = key[order], data[order]
        new = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        key, data = key[new], np.add.reduceat(data, new)
        return Rows(np.searchsorted(key, np.arange(rows + 1) * columns), key % columns, data)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), self.cols, self.data


def overlap_links(a_width: np.ndarray, b_width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, bytes they share) from the incidence of tokens and bytes; both cover the same bytes."""
    a, b = Rows.intervals(a_width), Rows.intervals(b_width)
    return a.times(b.transposed(int(a.starts[-1])), max(len(b_width), 1)).entries()


def groups_of(a_width: np.ndarray, b_width: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token of A and of B, and their number: a group ends where tokens of both do."""
    a, b = np.cumsum(a_width), np.cumsum(b_width)
    ends = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(ends, a), np.searchsorted(ends, b), len(ends)


def group_links(a_group: np.ndarray, b_group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of every pair within a group, from the incidence of tokens and groups."""
    shared = Rows.members(a_group).times(Rows.members(b_group).transposed(groups), max(len(b_group), 1))
    return shared.entries()[:2]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of rows that hold about ``size`` bytes together."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column("doc_id"), batch.column("text")):
            ids.append(i)
            texts.append(text.as_py())
            held += len(texts[-1]) + 64
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("text"))


def token_links(
    docs: DataFrame,
    kind: str = "overlap",
    id_col: str = "doc_id",
    text_col: str = "text",
    first: str = BYTES_VOCABULARY,
    second: str = PIECES_VOCABULARY,
) -> DataFrame:
    """One row per link: doc_id, a_index, b_index, a_id, b_id, shared_bytes, end_together, group_no.

    ``kind`` is "overlap" for tokens that share bytes or "group" for tokens of
    one group (``shared_bytes`` is then null). Indexes count a document's
    tokens from 0, groups likewise. Texts without tokens have no links.
    """
    if kind not in ("overlap", "group"):
        raise ValueError("kind must be 'overlap' or 'group'")
    source = _source(docs, id_col, text_col)
    fields = "a_index int, b_index int, a_id int, b_id int, shared_bytes int, end_together boolean, group_no int"
    schema = StructType([source.schema["doc_id"], *StructType.fromDDL(fields).fields])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(first, second)
        for ids, texts in _blocks(batches, BLOCK // 8):
            for name, a, b in zip(ids, *pair.encode(texts)):
                a_width, b_width = pair.a_width[a], pair.b_width[b]
                a_group, b_group, n = groups_of(a_width, b_width)
                if kind == "overlap":
                    i, j, shared = overlap_links(a_width, b_width)
                    shared = pa.array(shared.astype(np.int32))
                else:
                    i, j = group_links(a_group, b_group, n)
                    shared = pa.nulls(len(i), pa.int32())
                ints = [pa.array(c.astype(np.int32)) for c in (i, j, a[i], b[j])]
                ends = pa.array(np.cumsum(a_width)[i] == np.cumsum(b_width)[j])
                names = pa.array([name.as_py()] * len(i), name.type)
                group = pa.array(a_group[i].astype(np.int32))
                yield pa.RecordBatch.from_arrays([names, *ints, shared, ends, group], schema.names)

    return source.mapInArrow(link, schema)


def _written_groups(pair: Pair, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> np.ndarray:
    """The ids of both in the order of groups, each with the sign before it; a group's first id has a semicolon."""
    place = np.concatenate([a_group * 2, b_group * 2 + 1])
    order = np.argsort(place, kind="stable")
    place = place[order]
    new = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
    sign = np.where(new, place % 2, 2)
    return pair.written[sign, np.concatenate([a, b])[order]]


def _chunks(docs: DataFrame, id_col: str, text_col: str, first: str, second: str, chunk_bytes: int) -> DataFrame:
    """One row per chunk of documents; see the module's first lines. ``ids`` to ``digests`` have a place per document."""
    source = _source(docs, id_col, text_col).withColumn("part", F.spark_partition_id())
    lists = "n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, link_ends array<long>"
    schema = StructType(
        [
            *StructType.fromDDL("chunk long").fields,
            StructField("ids", ArrayType(source.schema["doc_id"].dataType)),
            *StructType.fromDDL(f"{lists}, a_ids array<int>, b_ids array<int>, numbers array<long>, links binary").fields,
        ]
    )

    def row(chunk: int, held: dict[str, list], id_type: pa.DataType) -> pa.RecordBatch:
        pairs = np.concatenate(held["links"])
        own, at, number = np.unique(pairs, return_inverse=True, return_counts=True)
        values = {
            "ids": pa.array([[i.as_py() for i in held["ids"]]], pa.list_(id_type)),
            "digests": pa.array([held["digests"]], pa.list_(pa.string())),
            "link_ends": pa.array([np.cumsum(held["n_links"])], pa.list_(pa.int64())),
            "a_ids": pa.array([(own >> 32).astype(np.int32)], pa.list_(pa.int32())),
            "b_ids": pa.array([(own & 0xFFFFFFFF).astype(np.int32)], pa.list_(pa.int32())),
            "numbers": pa.array([number.astype(np.int64)], pa.list_(pa.int64())),
            "links": pa.array([at.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes()], pa.binary()),
            "chunk": pa.array([chunk], pa.int64()),
        }
        for c in ("n_a", "n_b", "n_groups"):
            values[c] = pa.array([held[c]], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([values[c] for c in schema.names], schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(first, second)
        part = -1

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal part
            for batch in batches:
                if batch.num_rows:
                    part = batch.column("part")[0].as_py()
                    yield batch

        number = size = 0
        empty = lambda: {c: [] for c in ("ids", "n_a", "n_b", "n_groups", "digests", "n_links", "links")}
        held = empty()
        for ids, texts in _blocks(own(batches), BLOCK):
            a, b = pair.encode(texts)
            joined_a, joined_b = np.concatenate(a), np.concatenate(b)
            a_width, b_width = pair.a_width[joined_a], pair.b_width[joined_b]
            i, j, _ = overlap_links(a_width, b_width)
            # Documents end where tokens of both do, so no link and no group crosses from one to the next.
            together = np.cumsum(a_width)[i] == np.cumsum(b_width)[j]
            i, j = i[together], j[together]
            a_group, b_group, _ = groups_of(a_width, b_width)
            a_ends, b_ends = (np.cumsum([len(x) for x in own]) for own in (a, b))
            link_ends = np.searchsorted(i, a_ends)
            written = _written_groups(pair, joined_a, joined_b, a_group, b_group)
            at = token = group = done = 0
            for a_end, b_end, link_end in zip(a_ends.tolist(), b_ends.tolist(), link_ends.tolist()):
                till = int(a_group[a_end - 1]) + 1 if a_end > token else group
                text = b"".join(written[at : a_end + b_end])[1:]
                held["digests"].append(hashlib.sha256(text).hexdigest() if text else "")
                for c, n in (("n_a", a_end - token), ("n_b", a_end + b_end - at - (a_end - token)), ("n_groups", till - group), ("n_links", link_end - done)):
                    held[c].append(n)
                at, token, group, done = a_end + b_end, a_end, till, link_end
            held["ids"] += ids
            held["links"].append((joined_a[i] << 32) | joined_b[j])
            size += len(a_width) and int(a_width.sum()) or 0
            if size >= chunk_bytes or len(held["ids"]) >= chunk_bytes >> 6:
                yield row((part << 32) + number, held, ids[0].type)
                number, size, held = number + 1, 0, empty()
        if held["ids"]:
            yield row((part << 32) + number, held, held["ids"][0].type)

    return source.mapInArrow(cut, schema)


def align_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    first: str = BYTES_VOCABULARY,
    second: str = PIECES_VOCABULARY,
    chunk_bytes: int = CHUNK,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Links are overlapping tokens that end together. A pair of ids counts how
    many links of all documents hold it; ``count_sum`` adds this over a
    document's links, ``n_best`` are the links whose count is the highest of
    their second id, ties included. Texts that are null, empty, or not given
    back byte for byte by both tokenizers have no tokens: zeros and an empty
    digest. Every row is a document of its own, also repeated rows and rows
    without an id. Whole texts are aligned. An empty table gives an empty
    result. Extra columns are ignored.
    """
    chunks = cut_lineage(_chunks(docs, id_col, text_col, first, second, chunk_bytes))
    listed = chunks.select("chunk", F.posexplode(F.arrays_zip("a_ids", "b_ids", "numbers")).alias("at", "p")).select(
        "chunk", "at", F.col("p.a_ids").alias("a"), F.col("p.b_ids").alias("b"), F.col("p.numbers").alias("n")
    )
    counts = cut_lineage(listed.groupBy("a", "b").agg(F.sum("n").alias("total")))
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    weights = counts.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best"))
    told = listed.drop("n").join(weights, ["a", "b"]).groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("at", "total", "best"))).alias("w")  # a chunk's distinct pairs
    )
    back = chunks.drop("a_ids", "b_ids", "numbers").join(
        told.select("chunk", F.col("w.total").alias("totals"), F.col("w.best").alias("bests")), "chunk", "left"
    )
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = StructType(
        [
            StructField("doc_id", chunks.schema["ids"].dataType.elementType),
            *StructType.fromDDL(", ".join(f"{c} long" for c in columns) + ", groups_sha256 string").fields,
        ]
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = lambda c: batch.column(c)[k].values
                ends = np.concatenate([[0], cell("link_ends").to_numpy()])
                totals, bests = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if batch.column("totals")[k].is_valid:
                    totals = cell("totals").to_numpy()
                    bests = cell("bests").to_numpy(zero_copy_only=False).astype(np.int64)
                links = np.frombuffer(batch.column("links")[k].as_py(), "<u2" if len(totals) <= 1 << 16 else "<u4")
                sums = [np.concatenate([[0], np.cumsum(x[links])])[ends] for x in (bests, totals)]
                found = [np.diff(ends), *[np.diff(s) for s in sums]]
                yield pa.RecordBatch.from_arrays(
                    [cell("ids"), cell("n_a"), cell("n_b"), cell("n_groups"), *[pa.array(x.astype(np.int64)) for x in found], cell("digests")],
                    schema.names,
                )

    return back.select("ids", "n_a", "n_b", "n_groups", "digests", "link_ends", "links", "totals", "bests").mapInArrow(
        spread, schema
    )
