"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. Distinct
blocks are sorted and numbered, so that equal blocks and only they have one
integer name. Adjacent names are then paired, the distinct pairs sorted and
numbered in turn, until a document is down to one name. Two texts are equal
if and only if they have the same number of blocks and the same last name.

Names are joined to block positions by a digest in place of the block. That
is exact, not probable: all distinct blocks are gathered by their content, and
a digest that two different blocks share gets one variant number per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stemma.llm.tables import SPACE, text_or_empty
from stemma.operators.keys import dense_ids
from stemma.session import cut_lineage

#: Bytes in a block. Documents of one block, most of them, need no pairing.
BLOCK_BYTES = 16_384


def block_digest(block: Column) -> Column:
    return F.unhex(F.md5(block))


def _blocks(block_bytes: int) -> Column:
    """The blocks of the binary column ``norm``; an empty text has one empty block."""
    last = F.greatest(F.ceil(F.octet_length("norm") / block_bytes).cast("int") - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(F.col("norm"), i * block_bytes + 1, F.lit(block_bytes))
    )


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        text_or_empty(text_col).alias("raw"),
        F.regexp_replace(text_or_empty(text_col), SPACE, "").cast("binary").alias("norm"),
    )


def _variants(blocks: DataFrame) -> DataFrame | None:
    """(digest, block, variant from 0) of the digests that stand for several blocks; None if there are none."""
    shared = blocks.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    shared = cut_lineage(shared)
    if shared.isEmpty():
        return None
    order = W.partitionBy("digest").orderBy("block")
    return blocks.join(shared, "digest").withColumn("variant", F.row_number().over(order) - 1)


def block_names(docs: DataFrame, block_bytes: int, digest=block_digest) -> tuple[DataFrame, DataFrame]:
    """(documents, positions): one row per document, and one per block with its integer name."""
    cut = docs.select("norm").select(F.explode(_blocks(block_bytes)).alias("block"))
    distinct = cut.select(digest(F.col("block")).alias("digest"), "block").distinct()
    variants = _variants(distinct)
    light = cut_lineage(
        docs.select(
            "row_id",
            "doc_id",
            F.length("raw").alias("n_points"),
            F.sha2(F.col("raw").cast("binary"), 256).alias("row_sha256"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(_blocks(block_bytes), digest).alias("digests"),
        ).withColumn("n_blocks", F.size("digests"))
    )
    places = light.select("row_id", "n_blocks", F.posexplode("digests").alias("pos", "digest"))
    if variants is None:
        places = places.withColumn("variant", F.lit(0))
    else:
        # Only positions whose digest is shared are told apart by their content.
        texts = docs.select("row_id", F.posexplode(_blocks(block_bytes)).alias("pos", "block"))
        own = (
            texts.withColumn("digest", digest(F.col("block")))
            .join(variants, ["digest", "block"])
            .select("row_id", "pos", "variant")
        )
        places = places.join(own, ["row_id", "pos"], "left").withColumn("variant", F.coalesce("variant", F.lit(0)))
        places = cut_lineage(places)
    keys = places.select("digest", "variant").distinct()
    names = dense_ids(keys, "name", F.col("digest"), F.col("variant"))
    return light.drop("digests"), places.join(names, ["digest", "variant"]).select("row_id", "n_blocks", "pos", "name")


def document_names(places: DataFrame) -> DataFrame:
    """(row_id, n_blocks, name): adjacent names are paired and named until one is left."""
    places = cut_lineage(places.withColumn("left", F.col("n_blocks")))
    done = [places.where("left = 1")]
    most = places.agg(F.max("left")).first()[0] or 1
    while most > 1:
        at = F.col("pos") % 2
        pairs = cut_lineage(
            places.where("left > 1")
            .groupBy("row_id", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.ceil(F.max("left") / 2).cast("int").alias("left"),
                F.max(F.when(at == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(at == 1, F.col("name"))), F.lit(0)).alias("b"),
            )
        )
        names = dense_ids(pairs.select("a", "b").distinct(), "name", F.col("a"), F.col("b"))
        places = cut_lineage(pairs.join(names, ["a", "b"]).drop("a", "b"))
        done.append(places.where("left = 1"))
        most = (most + 1) // 2
    out = done[0].select("row_id", "n_blocks", "name")
    for more in done[1:]:
        out = out.unionByName(more.select("row_id", "n_blocks", "name"))
    return out


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    digest=block_digest,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_sha256, n_blocks, name.

    Texts are equal when they agree after white space is taken out; a null
    text counts as empty, and all empty texts are equal. Of equal texts the
    row with the most code points stays, then that with the smallest id (null
    last), then that with the smallest hash of its text, then the first read:
    exactly one row of each group is kept, also among repeated rows. A group
    whose staying row has no id has a null ``keep_id``. Extra columns are
    ignored. An empty table gives an empty result.
    """
    light, places = block_names(_normalised(docs, id_col, text_col), block_bytes, digest)
    rows = light.drop("n_blocks").join(document_names(places), "row_id")
    rows = cut_lineage(rows)
    rank = F.struct(
        (-F.col("n_points")).alias("shorter"),
        F.col("doc_id").isNull().alias("no_id"),
        "doc_id",
        "row_sha256",
        "row_id",
    )
    groups = rows.groupBy("n_blocks", "name").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = cut_lineage(groups)
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        "text_sha256",
        "row_sha256",
        "n_blocks",
        "name",
    )
