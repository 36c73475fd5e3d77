"""Best-fit packing of documents into sequences of a fixed number of tokens.

Which lengths share a sequence is decided on the histogram of lengths alone,
which has at most ``capacity`` entries however many documents there are. The
configuration program asks for the fewest sequences whose fillings
(configurations: how many pieces of which length) take up every piece. It is
solved by multiplicative weights: every length has a price, a knapsack dynamic
program finds what a sequence is worth at most, configurations worth that much
get a small step, and the prices of the lengths they cover fall. The solution
is rounded to whole sequences and what is left goes by best fit.

The pieces then take the places the plan has for their length, by their rank
among the pieces of that length; ranks come from counts per partition, so no
length is gathered anywhere.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from stemma.llm.tables import text_or_empty
from stemma.session import cut_lineage

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: The id put after every document.
END = 0
#: Rounds of the multiplicative weights, and how hard a price follows the coverage of its length.
ROUNDS = 24
RATE = 3.0
#: How much less than the most a configuration may be worth and still get a step.
SLACK = 0.002
#: Words whose ids a Python worker remembers, and the longest word remembered.
REMEMBERED = 1 << 17
LONGEST_WORD = 64
#: Documents whose words are numbered together.
BATCH = 1024
#: Words that normalisation leaves as they are but for their case: visible signs up to U+024F, without "<",
#: which may begin a special token.
PLAIN = re.compile("[!-;=-~\u00a1-\u024f]+")
#: A text of such signs alone; U+0130 is left out, as its lower case is two signs.
PLAIN_TEXT = "^[\n !-;=-~\u00a1-\u012f\u0131-\u024f]*$"
#: A letter and a sign after it that begins no contraction.
SIGN_AFTER = r"([a-z])([!-&(-/:;=-@\[-`{-~])"
#: Fixed value: the pattern by which the vocabulary splits words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

Plan = list[tuple[tuple[tuple[int, int], ...], int]]

_workers: dict[str, WordEncoder] = {}


def packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 signs stand for themselves, other bytes for U+0100 and on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: 0x100 + i for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes.

    The vocabulary drops white space before it splits, so a text's ids are
    those of its words between spaces and line feeds, in order. A word of plain
    letters and signs is split by the vocabulary's own pattern and given to
    its merges directly; any other word goes through the whole tokenizer.
    Words and their parts are remembered in two generations: when the young
    one is full it becomes the old one, so frequent ones stay and memory is
    bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _part(self, part: str) -> bytes:
        ids = self.old_parts.get(part)
        if ids is None:
            seen = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = packed([t.id for t in self.merge(seen)])
        if len(part) <= LONGEST_WORD:
            if len(self.parts) >= REMEMBERED:
                self.old_parts, self.parts = self.parts, {}
            self.parts[part] = ids
        return ids

    def _new(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isascii() and word.isalpha():
                ids = packed([t.id for t in self.merge(word.lower())])
            elif PLAIN.fullmatch(word):
                lower = word.lower()
                if lower.isalpha():
                    split = [lower]
                elif lower[:-1].isalpha():
                    split = [lower[:-1], lower[-1]]
                else:
                    split = SPLIT.findall(lower)
                known = self.parts.get
                ids = b"".join([known(p) or self._part(p) for p in split])
            else:
                ids = packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= LONGEST_WORD:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {"": b""}
            self.young[word] = ids
        return ids

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each begin, with the end of the last.

        Words are split and numbered for the whole array at once; each distinct
        word is looked up once, and its ids are copied to its places. Texts of
        plain signs are put in lower case first, and signs after a letter set
        apart, as the vocabulary's pattern does; that leaves fewer words.
        """
        plain = pc.match_substring_regex(texts, PLAIN_TEXT)
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=SIGN_AFTER, replacement=r"\1 \2")
        split = pc.split_pattern(pc.replace_substring(pc.if_else(plain, apart, texts), "\n", " "), " ")
        # The values of the lists that are there, whatever lies before them in memory.
        words = split.flatten()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        coded = words.dictionary_encode()
        known = self.young.get
        found = [known(w) for w in coded.dictionary.to_pylist()]
        if None in found:
            new = self._new
            found = [new(w) if x is None else x for w, x in zip(coded.dictionary.to_pylist(), found)]
        width = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(width) - width
        place = coded.indices.to_numpy()
        number = width[place]
        after = np.cumsum(number)
        at = np.repeat(first[place] - (after - number), number) + np.arange(after[-1] if len(after) else 0)
        ids = np.frombuffer(b"".join(found), "<u4")[at]
        words_before = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return ids, np.concatenate([[0], after])[words_before]

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()


def _encoder(vocabulary: str) -> WordEncoder:
    if vocabulary not in _workers:
        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        _workers[vocabulary] = WordEncoder(path)
    return _workers[vocabulary]


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, part, and ``ids`` (32-bit little-endian) if asked for.

    A document is its ids and the end id; one longer than ``capacity`` is cut
    into pieces of that length, the last of which may be shorter. ``part`` is
    the number of the partition that read it.
    """
    source = docs.select(
        F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), F.spark_partition_id().alias("part")
    )
    schema = StructType(
        [
            source.schema["doc_id"],
            StructField("piece", IntegerType()),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids_crc32", LongType()),
            StructField("part", IntegerType()),
            *([StructField("ids", BinaryType())] if with_ids else []),
        ]
    )
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        end = END.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column("text")
            for first in range(0, batch.num_rows, BATCH):
                rows, at = [], []
                every, starts = encoder.encode_all(texts[first : first + BATCH])
                for i, (begin, till) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
                    ids = every[begin:till].tobytes() + end
                    for piece, begin in enumerate(range(0, len(ids), width)):
                        part = ids[begin : begin + width]
                        at.append(first + i)
                        rows.append((piece, begin // 4, len(part) // 4, zlib.crc32(part), part))
                piece, begin, length, crc, ids = zip(*rows)
                columns = [
                    batch.column("doc_id").take(pa.array(at)),
                    pa.array(piece, pa.int32()),
                    pa.array(begin, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    batch.column("part").take(pa.array(at)),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, schema.names)

    return source.mapInArrow(cut, schema)


def _knapsack(prices: np.ndarray, capacity: int) -> np.ndarray:
    """``best[c]``: the most that lengths filling at most ``c`` are worth; a length of price 0 does not exist."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], (prices[1 : c + 1] + best[c - 1 :: -1]).max())
    return best


def least_sequences(counts: np.ndarray) -> float:
    """A lower bound: for every k, pieces longer than capacity - k need a sequence each and spare it for none from k on."""
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    number, tokens = np.cumsum(counts), np.cumsum(counts * sizes)
    best = float(tokens[-1]) / capacity
    for k in range(1, capacity // 2 + 1):
        alone = number[-1] - number[capacity - k]
        middle = tokens[capacity - k] - tokens[k - 1]
        large = number[capacity - k] - number[capacity // 2]
        room = large * capacity - (tokens[capacity - k] - tokens[capacity // 2])
        small = tokens[capacity // 2] - tokens[k - 1]
        best = max(best, alone + large + max(0.0, small - room) / capacity, alone + middle / capacity)
    return best


def solve_configurations(
    counts: np.ndarray, sequences: float, rounds: int = ROUNDS, rate: float = RATE, slack: float = SLACK
) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractions of configurations, ``sequences`` in all, that cover the lengths as evenly as they can.

    ``counts[s]`` is the number of pieces of length s. Every round deals out an
    equal share of the sequences, only to configurations worth nearly the most
    that the knapsack program finds at the present prices. The price of a
    length falls by exp(-rate x share covered), so one that is left behind
    becomes dear until the best configurations hold it.
    """
    capacity = len(counts) - 1
    sizes = np.nonzero(counts)[0]
    have = np.maximum(counts, 1).astype(float)
    covered = np.zeros(capacity + 1)
    worth = np.where(counts > 0, np.arange(capacity + 1) / capacity, 0.0)
    x: dict[tuple[tuple[int, int], ...], float] = {}
    share = 0.0
    for t in range(1, rounds + 1):
        goal = t / rounds
        prices = worth * np.exp(rate * (goal - covered))
        prices[covered >= goal] = 0.0
        best = _knapsack(prices, capacity)
        asked, least = prices.copy(), (1 - slack) * best[capacity]
        share += sequences / rounds
        around = prices[sizes] + best[capacity - sizes]
        for s in sizes[np.argsort(-around, kind="stable")]:
            if share <= 0:
                break
            if prices[s] <= 0:
                continue
            inside, room = Counter({int(s): 1}), capacity - int(s)
            while room:
                value = np.where(prices[1 : room + 1] > 0, prices[1 : room + 1] + best[room - 1 :: -1], -1.0)
                pick = room - int(value[::-1].argmax())
                if prices[pick] <= 0:
                    break
                inside[pick] += 1
                room -= pick
            if sum(asked[i] * n for i, n in inside.items()) < least:
                continue
            step = min(share, *((goal - covered[i]) * have[i] / n for i, n in inside.items()))
            config = tuple(sorted(inside.items(), reverse=True))
            x[config] = x.get(config, 0.0) + step
            share -= step
            for i, n in inside.items():
                covered[i] += n * step / have[i]
                prices[i] = worth[i] * np.exp(rate * (goal - covered[i])) if covered[i] < goal - 1e-12 else 0.0
    return x


def _best_fit(left: np.ndarray) -> Counter:
    """Configurations for the pieces ``left``: longest first, each into the tightest gap that takes it.

    Equal sequences are moved together, so the work depends on the lengths
    there are and not on the number of pieces.
    """
    capacity = len(left) - 1
    gaps: list[list[list]] = [[] for _ in range(capacity + 1)]  # by gap: [configuration, how many]
    open_gaps = 0  # bit g: some sequence has a gap of g

    def put(inside: tuple, times: int) -> None:
        nonlocal open_gaps
        if times:
            gap = capacity - sum(s * n for s, n in inside)
            gaps[gap].append([inside, times])
            open_gaps |= 1 << gap

    for s in range(capacity, 0, -1):
        rest = int(left[s])
        while rest:
            fits = open_gaps >> s
            if not fits:
                put(((s, capacity // s),), rest // (capacity // s))
                rest %= capacity // s
                if rest:
                    put(((s, rest),), 1)
                break
            gap = s + (fits & -fits).bit_length() - 1
            inside, times = gaps[gap].pop()
            each = min(gap // s, rest)
            used = min(times, rest // each)
            if times > used:
                gaps[gap].append([inside, times - used])
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
            put((*inside, (s, each)), used)
            rest -= each * used
    out: Counter = Counter()
    for same in gaps:
        for inside, times in same:
            out[inside] += times
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[Plan, float]:
    """Configurations with how often each is used, for every piece of the histogram, and a lower bound on their number."""
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        counts[s] += n
    plan: Counter = Counter()
    if counts[capacity]:
        plan[((capacity, 1),)] = int(counts[capacity])
    full, counts[capacity] = int(counts[capacity]), 0
    if not counts.any():
        return list(plan.items()), float(full)
    bound = least_sequences(counts)
    x = solve_configurations(counts, bound, rounds)
    left = counts.copy()
    for config in sorted(x, key=lambda c: (-sum(s * n for s, n in c), -x[c], c)):
        times = min(int(x[config]), *(int(left[s]) // n for s, n in config))
        if times > 0:
            plan[config] += times
            for s, n in config:
                left[s] -= n * times
    plan += _best_fit(left)
    return [(c, n) for c, n in sorted(plan.items(), reverse=True) if n], full + bound


def _slots(plan: Plan) -> tuple[np.ndarray, ...]:
    """For the pieces of a length from a rank on: sequence, pieces per sequence, offset; sorted by length and rank."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for config, times in plan:
        offset = 0
        for s, n in config:
            rows.append((s, taken[s], sequence, n, offset))
            taken[s] += n * times
            offset += s * n
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5


def _placed(pieces: DataFrame, plan: Plan) -> DataFrame:
    """``pieces`` with ``rank`` turned into sequence_id and offset."""
    # At most a slot row for each length of each configuration: bounded by capacity and rounds, not by the pieces.
    shared = pieces.sparkSession.sparkContext.broadcast(_slots(plan))
    names = [c for c in pieces.columns if c != "rank"]
    schema = StructType(
        [pieces.schema[c] for c in names] + [StructField("sequence_id", LongType()), StructField("offset", LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, per, offset = shared.value
        keys = (length << 44) | first
        for batch in batches:
            s = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (s << 44) | rank, side="right") - 1
            turn, seat = np.divmod(rank - first[k], per[k])
            placed = [pa.array(sequence[k] + turn), pa.array(offset[k] + seat * s)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + placed, schema.names)

    return pieces.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    rounds: int = ROUNDS,
    with_ids: bool = False,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if asked for.

    Every row is a document of its own, also repeated rows and rows without an
    id. A null text counts as empty: it is the end id alone. Offsets in a
    sequence are gapless from 0. Extra columns are ignored. An empty table
    gives an empty result.
    """
    pieces = cut_lineage(token_pieces(docs, id_col, text_col, capacity, vocabulary, with_ids))
    counts = cut_lineage(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_packing(histogram, capacity, rounds)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = W.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("own", F.row_number().over(own) - 1)
        .join(offsets, ["length", "part"])
        .withColumn("rank", (F.col("before") + F.col("own")).cast("long"))
    )
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return _placed(ranked.select(*out, "rank"), plan)
