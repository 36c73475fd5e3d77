"""Near duplicates by SimHash, found through a table of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to a set of reference
fingerprints (pivots). Flipping one bit changes a distance by one, so two
fingerprints at most ``max_distance`` bits apart differ by no more than that
in any coordinate: a pair with a larger difference is discarded unseen.

The first pivots are the origin and the masks of 2-bit cells. The difference
of two such coordinates says how many bits of a cell are set, and at most
``max_distance`` cells can differ between linked fingerprints. Cells are dealt
to parts; some choice of parts is untouched by the flips, so candidates are
found by equality on the coordinates of each choice, without all pairs. The
remaining pivots are scattered and serve the coordinate test.

A bucket of candidates above ``bucket_limit`` is not compared pair by pair.
Its members are linked exactly through their surroundings: two fingerprints
are at most 2r bits apart if and only if some fingerprint lies within r bits
of both, and every member is linked to the least member at each such point.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemma.llm.components import connected_components
from stemma.llm.tables import text_or_empty
from stemma.session import cut_lineage

SEED = 42
CELL_BITS = 2
#: Candidates in one bucket that are still compared pair by pair.
BUCKET_LIMIT = 64
#: Shingles whose bits are counted at once.
SLICE = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a UTF-8 text: majority bits of the XXH64 of its word shingles, zero if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(width)))), len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, n, SLICE):
        size = min(SLICE, n - start)
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in itertools.islice(shingles, size)), "<u8", size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.packbits(ones * 2 > n, bitorder="little").view("<u8"))[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """The fingerprint of a binary text as a signed long."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.fromiter((fingerprint(bytes(x), width) for x in batch), np.uint64, len(batch))
            yield pd.Series(found.view(np.int64))

    return prints(text)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivots(scattered: int = 32) -> list[int]:
    """Reference fingerprints: the origin, the masks of the cells, and scattered ones."""
    cells = [((1 << CELL_BITS) - 1) << at for at in range(0, 64, CELL_BITS)]
    return [0, *cells, *(xxhash.xxh64_intdigest(str(i), SEED) for i in range(scattered))]


def pivot_table(prints: DataFrame, references: list[int], column: str = "fp") -> DataFrame:
    """``prints`` with one column ``d<i>`` for the distance to each reference."""
    return prints.withColumns(
        {f"d{i}": F.bit_count(F.col(column).bitwiseXOR(F.lit(_signed(r)))) for i, r in enumerate(references)}
    )


def _bucket_keys(max_distance: int) -> Column:
    """One key for each choice of parts that ``max_distance`` flips can leave untouched."""
    n, deal = 64 // CELL_BITS, max_distance + 2
    # Bits set in cell j, from the coordinates of the origin and of its mask.
    ones = [((F.col("d0") - F.col(f"d{j + 1}") + CELL_BITS) / 2).cast("long") for j in range(n)]
    parts = []
    for p in range(deal):
        own = [F.shiftleft(ones[j], 2 * k) for k, j in enumerate(range(p, n, deal))]
        parts.append(sum(own[1:], own[0]))
    choices = itertools.combinations(range(deal), deal - max_distance)
    return F.array(
        *[F.struct(F.lit(i).alias("choice"), F.array(*[parts[p] for p in c]).alias("key")) for i, c in enumerate(choices)]
    )


def links(prints: DataFrame, max_distance: int = 2, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect all pairs at most ``max_distance`` bits apart.

    In buckets of up to ``bucket_limit`` members every linked pair is an edge;
    in larger ones each member has an edge to the least member within reach of
    a common point, which gives the same connected classes. That needs an
    even distance.
    """
    if max_distance not in (2, 4):
        raise ValueError("max_distance must be 2 or 4")
    references = pivots()
    keyed = cut_lineage(
        pivot_table(prints.select("fp"), references)
        .select("fp", F.explode(_bucket_keys(max_distance)).alias("b"))
        .select("fp", F.xxhash64("b.choice", "b.key").alias("bucket"))
    )
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = cut_lineage(keyed.join(sizes, "bucket"))

    near = [f"d{i}" for i in range(len(references))]
    small = pivot_table(shared.where(F.col("members") <= bucket_limit).select("bucket", "fp"), references)
    other = small.select("bucket", *[F.col(c).alias(f"{c}_") for c in ("fp", *near)])
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_"))) <= max_distance
    within = F.greatest(*[F.abs(F.col(d) - F.col(f"{d}_")) for d in near]) <= max_distance
    pairs = small.join(other, "bucket").where(F.col("fp") < F.col("fp_")).where(within).where(close)
    edges = pairs.select(F.col("fp").alias("u"), F.col("fp_").alias("v"))

    crowded = shared.where(F.col("members") > bucket_limit).select("fp").distinct()
    around = _surroundings(crowded, max_distance // 2)
    least = around.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = around.join(least, "point").select(F.col("fp").alias("u"), "v").where("u <> v").distinct()
    return edges.unionByName(stars)


def _surroundings(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, point) for every point within ``radius`` bits of ``fp``."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in itertools.combinations(range(64), r)]
    flips = F.array(*[F.lit(_signed(m)) for m in masks])
    return prints.select("fp", F.explode(flips).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point")
    )


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_distance: int = 2,
    width: int = 3,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, kept, row_sha256.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_distance`` bits, the row's own included. ``kept`` marks one row of
    each component: the smallest id (null last), then the smallest hash of the
    text, then the first read. A null text counts as empty; documents without
    words have fingerprint zero and are linked like any other. Rows without an
    id take part; a component without any id has a null ``component_id``.
    Equal fingerprints become one before anything is compared, so repeated
    rows cost nothing. Extra columns are ignored. An empty table gives an
    empty result.
    """
    raw = text_or_empty(text_col).cast("binary")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.sha2(raw, 256).alias("row_sha256"),
        raw.alias("raw"),
    )
    rows = cut_lineage(rows.withColumn("fp", fingerprint_column(F.col("raw"), width)).drop("raw"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_sha256", "row_id")
    prints = cut_lineage(rows.groupBy("fp").agg(F.min(rank).alias("best")))
    parts = cut_lineage(connected_components(links(prints, max_distance, bucket_limit)))
    linked = prints.join(parts, prints.fp == parts.node)
    least = linked.groupBy("component").agg(F.min("best").alias("best"))
    chosen = parts.join(least, "component").select(F.col("node").alias("fp"), F.col("best").alias("joint"))
    classes = cut_lineage(prints.join(chosen, "fp", "left").select("fp", F.coalesce("joint", "best").alias("best")))
    return rows.join(classes, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.doc_id").alias("component_id"),
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "row_sha256",
    )
