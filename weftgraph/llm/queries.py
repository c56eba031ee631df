"""The registered queries of this package, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bagminhash, chat, mixing, secrets
from weftgraph.llm.common import table
from weftgraph.llm.language import identify, identify_pages
from weftgraph.llm.quality import quality_rules
from weftgraph.llm.token_counts import count_tokens
from weftgraph.llm.token_files import drop_token_files, new_folder, read_token_files, write_token_files
from weftgraph.llm.vector_graph import audited
from weftgraph.llm.word_table import decode, encode


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.replicate(docs, mixing.tempered_rates(docs))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "embeddings"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    atexit.register(drop_token_files, path)
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "lang_id", "lang_p", "lang_accepted")


def op10_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_mix_sources": op5_mix_sources,
    "op6_secret_scan": op6_secret_scan,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_token_files": op8_token_files,
    "op9_chat_format": op9_chat_format,
    "op10_language_id": op10_language_id,
    "op10_page_language": op10_page_language,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mix_sources": mixing.ORACLE_SQL,
    "op6_secret_scan": secrets.ORACLE_SQL,
    "op9_chat_format": chat.ORACLE_SQL,
}
