"""SentencePiece ids by a streaming Viterbi search, and back.

The search finds the split of a text into pieces with the largest sum of
scores. It reads character by character and keeps, of the best scores, only
those a piece can still begin at: a window as long as the longest piece. As
soon as the backpointers of all positions in the window meet in one boundary,
the ids up to it are committed and forgotten, so a text of any length needs
little memory.

Ids are the best split under the scores of the vocabulary file, as for a
unigram model. A merge-trained file holds scores too, but its own encoder
applies merges in their order, which is another split.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from stemma.llm.tables import text_or_empty

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a SPACE sign that is in the text itself; no text can hold it.
LITERAL = "\ud800"
#: Fixed value: how much less than the lowest score an unknown character has.
UNKNOWN_PENALTY = 10.0
REMEMBERED = 1 << 18
LONGEST_WORD = 64

_workers: dict[str, Codec] = {}


class Stream:
    """One search: push text, take the ids that are certain, finish."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.text = ""  # from the last committed boundary on
        self.scores: list[float | None] = [0.0]
        self.back: list[tuple[int, int] | None] = [None]  # (where the piece begins, its id or -1)
        self.at = 0  # positions before it have been extended

    def push(self, text: str, last: bool = False) -> list[int]:
        """The ids that have become certain."""
        self.text += text
        self.scores += [None] * len(text)
        self.back += [None] * len(text)
        out: list[int] = []
        codec, longest = self.codec, self.codec.longest
        while self.at < len(self.text):
            # A piece may reach beyond what has been pushed.
            if not last and len(self.text) - self.at < longest:
                break
            self._extend(self.at)
            self.at += 1
            if self.at >= 2 * longest and self.at % longest == 0:
                out += self._commit()
        if last and self.text:
            out += codec.path(self.text, self.back, 0, len(self.text))
            self.text, self.scores, self.back, self.at = "", [0.0], [None], 0
        return out

    def _extend(self, i: int) -> None:
        start, text, scores, back = self.scores[i], self.text, self.scores, self.back
        node, single = self.codec.trie, False
        for j in range(i, min(len(text), i + self.codec.longest)):
            found = node.get(text[j])
            if found is None:
                break
            node, piece, own = found
            if piece is not None:
                single = single or j == i
                score = start + own
                if scores[j + 1] is None or score > scores[j + 1]:
                    scores[j + 1], back[j + 1] = score, (i, piece)
        if not single:
            score = start + self.codec.unknown
            if scores[i + 1] is None or score > scores[i + 1]:
                scores[i + 1], back[i + 1] = score, (i, -1)

    def _commit(self) -> list[int]:
        """Commit up to the boundary where the paths of all positions in the window meet, if there is one."""
        window = {k for k in range(self.at, min(self.at + self.codec.longest, len(self.scores))) if self.scores[k] is not None}
        while len(window) > 1:
            far = max(window)
            window.discard(far)
            window.add(self.back[far][0])
        boundary = window.pop()
        if boundary <= 0:
            return []
        out = self.codec.path(self.text, self.back, 0, boundary)
        base = self.scores[boundary]
        self.text = self.text[boundary:]
        self.scores = [None if s is None else s - base for s in self.scores[boundary:]]
        self.back = [b and (b[0] - boundary, b[1]) for b in self.back[boundary:]]
        self.back[0] = None
        self.at -= boundary
        return out


class Codec:
    """Pieces and scores of one vocabulary file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        #: By character: (further characters, id of the piece that ends here or None, its score).
        self.trie: dict = {}
        self.bytes: dict[int, int] = {}
        self.shown: list[bytes] = []
        lowest, pairs = 0.0, set()
        self.longest = 1
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.shown.append(bytes([int(piece[1:-1], 16)]))
                continue
            self.shown.append(piece.replace(SPACE, " ").encode())
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.shown[-1] = b""
                continue
            node, score = self.trie, model.get_score(i)
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, None, 0.0))[0]
            further = node[piece[-1]][0] if piece[-1] in node else {}
            node[piece[-1]] = (further, i, score)
            lowest = min(lowest, score)
            self.longest = max(self.longest, len(piece))
            pairs.update(map("".join, zip(piece, piece[1:])))
        #: Neighbours within a piece. Between any others every path has a boundary.
        self.pairs = frozenset(pairs)
        self.unknown = lowest - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        #: No piece has a space sign after another one: every path has a boundary before each word.
        self.by_word = not any(b == SPACE and a != SPACE for a, b in pairs) and "\n" not in self.trie
        probe = "a  b\nc\tÅ "
        self.plain = model.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def path(self, text: str, back: list, first: int, last: int) -> list[int]:
        """The ids between two boundaries."""
        out: list[int] = []
        while last > first:
            begin, piece = back[last]
            out += [piece] if piece >= 0 else self._fallback(text[begin:last])[::-1]
            last = begin
        return out[::-1]

    def _fallback(self, sign: str) -> list[int]:
        raw = (SPACE if sign == LITERAL else sign).encode()
        return [self.bytes.get(b, self.unknown_id) for b in raw] if self.bytes else [self.unknown_id]

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.model.normalize(text)
        return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""

    def stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """Ids of a normalised text that comes in chunks."""
        search = Stream(self)
        for chunk in chunks:
            yield from search.push(chunk)
        yield from search.push("", last=True)

    def _search(self, part: str) -> bytes:
        """The ids of a part: of a long one by a stream, of one within the window without its bookkeeping."""
        n = len(part)
        if n > 2 * self.longest:
            return array("i", self.stream([part])).tobytes()
        scores, back = [0.0] + [None] * n, [None] * (n + 1)
        trie, unknown = self.trie, self.unknown
        for i in range(n):
            start, node, single = scores[i], trie, False
            for j in range(i, n):
                found = node.get(part[j])
                if found is None:
                    break
                node, piece, own = found
                if piece is not None:
                    if j == i:
                        single = True
                    score, known = start + own, scores[j + 1]
                    if known is None or score > known:
                        scores[j + 1], back[j + 1] = score, (i, piece)
            if not single and (scores[i + 1] is None or start + unknown > scores[i + 1]):
                scores[i + 1], back[i + 1] = start + unknown, (i, -1)
        return array("i", self.path(part, back, 0, n)).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.old_parts.get(part)
        if ids is None:
            ids = self._search(part)
        if len(part) <= LONGEST_WORD:
            if len(self.parts) >= REMEMBERED:
                self.old_parts, self.parts = self.parts, {}
            self.parts[part] = ids
        return ids

    def _new(self, word: str) -> bytes:
        """The ids of a word; a sign at its end is a part of its own where there is a sure boundary before it."""
        ids = self.old.get(word)
        if ids is None:
            known = self.parts.get
            if word[-2:] in self.pairs or len(word) == 1:
                ids = known(word) or self._part(word)
            else:
                ids = (known(word[:-1]) or self._part(word[:-1])) + (known(word[-1]) or self._part(word[-1]))
        if len(word) <= LONGEST_WORD:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = ids
        return ids

    def encode(self, text: str) -> array:
        """The ids of a text; where every word is a search of its own, words are remembered."""
        normal = self.normalised(text)
        out = array("i")
        if not self.by_word:
            out.extend(self.stream([normal]))
            return out
        words = WORDS.findall(normal)
        ids = list(map(self.young.get, words))
        if None in ids:
            new = self._new
            ids = [new(w) if x is None else x for w, x in zip(words, ids)]
        out.frombytes(b"".join(ids))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces are joined to characters, the space before the first word goes."""
        raw = b"".join(map(self.shown.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


#: Words with the space signs before them; line feeds are no piece and stand alone.
WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def codec(model: str = MODEL) -> Codec:
    """The codec of a vocabulary file, loaded once in each worker."""
    if model not in _workers:
        _workers[model] = Codec(model if os.path.isabs(model) else public_tokenizers.path(model))
    return _workers[model]


def encode_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(doc_id, ids, ids_crc32, restored) for every row of ``docs``, also repeated ones.

    ``ids_crc32`` is the CRC-32 of the ids as little-endian 32-bit numbers,
    ``restored`` whether decoding gives the whole text back. A null text
    counts as empty and has no ids. Texts of any length are encoded whole.
    Extra columns are ignored. An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = StructType(
        [
            source.schema["doc_id"],
            StructField("ids", ArrayType(IntegerType())),
            StructField("ids_crc32", LongType()),
            StructField("restored", BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                flat, ends, crc, same = array("i"), [0], [], []
                for text in part.column("text").to_pylist():
                    ids = own.encode(text)
                    flat.extend(ids)
                    ends.append(len(flat))
                    crc.append(zlib.crc32(_little(ids)))
                    same.append(own.decode(ids) == text)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(crc, pa.int64()), pa.array(same)], schema.names
                )

    return source.mapInArrow(run, schema)


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("i", ids)
        ids.byteswap()
    return ids.tobytes()


def decode_ids(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``rows`` with the column ``text`` for their ids; null ids have a null text, unknown ids are an error."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model)
        for batch in batches:
            yield batch.map(lambda ids: None if ids is None else own.decode(ids))

    return rows.withColumn("text", decoded(F.col(ids_col)))
