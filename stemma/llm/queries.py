"""The registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import oracle
from stemma.llm.conversation_trie import conversation_sequences, conversation_trie, grafted
from stemma.llm.exact_dedup import exact_dedup
from stemma.llm.html_extract import extract_main_text
from stemma.llm.labelled import fold
from stemma.llm.neighbours import nearest_neighbours
from stemma.llm.packing import pack_documents
from stemma.llm.product_quantisation import near_duplicate_vectors
from stemma.llm.quality_sites import quality_scores
from stemma.llm.sentencepiece_codec import encode_texts
from stemma.llm.simhash_dedup import simhash_dedup
from stemma.llm.tables import table
from stemma.llm.token_alignment import align_documents
from stemma.llm.toxicity import toxicity
from stemma.llm.url_filter import judge_urls, rule_table
from stemma.llm.warc import page_records, read_archives, write_archives
from stemma.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", "restored")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut_lineage(write_archives(table(spark, sf_dir, "pages")))
    return page_records(read_archives(archives))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


#: Score from which a document counts as toxic.
TOXIC = 0.7


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "row.doc_id",
        F.coalesce(fold("row.doc_id") == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


#: The rules of the URL filter.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_quality_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "document_score", "host_rate", "path_rate", "posterior", "good")


def op10_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = grafted(conversation_sequences(table(spark, sf_dir, "conversations")))
    return conversation_trie(rebuilt).drop("turn_key").withColumn("depth", F.col("depth").cast("long"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


LLM_QUERIES: dict[str, Query] = {
    "op1_html_text": op1_html_text,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_warc": op3_warc,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_packing": op5_packing,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_quality_sites": op9_quality_sites,
    "op10_forest_neighbours": op10_forest_neighbours,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_dedup": op13_vector_dedup,
}

LLM_ORACLE: dict[str, str] = {
    "op3_warc": oracle.WARC,
    "op4_exact_dedup": oracle.EXACT_DEDUP,
    "op8_url_filter": oracle.URL_FILTER,
    "op11_conversation_trie": oracle.CONVERSATION_TRIE,
    "op13_vector_dedup": oracle.VECTOR_DEDUP,
}
