"""The corpus pipeline: five stages over `documents`, in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes what a stage returns to the shared folder and reads it back as the next one's docs, so no stage is worked out
twice and a lost executor costs no more than its own stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.bagminhash import deduplicate
from weftgraph.llm.common import drop, drop_at_exit, set_aside, shared_dir
from weftgraph.llm.language import identify
from weftgraph.llm.mixing import replicate, tempered_rates
from weftgraph.llm.secrets import redact
from weftgraph.llm.word_table import decode, encode


#: Rows of an Arrow batch. The pipeline runs all stages in the same executors, so it bounds what each batch takes of their
#: memory for its whole session; the operators by themselves leave the setting as they find it.
ARROW_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def heaps_back(spark: SparkSession) -> None:
    """Have every executor collect its garbage, after which its heap shrinks: one that a stage has grown would leave the next one's Python workers too little."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or with a posterior under one half go.

    Learned from the languages of all documents, judged by text and source. Null and empty texts go; null ids, sources
    and languages are no reason to go; repeated rows are judged alike; very long texts count whole; an empty table stays
    empty; extra columns of any name stay.
    """
    bounded(spark)
    held, back = set_aside(docs, ("lang_id", "lang_p", "lang_accepted"))
    return identify(held).where("lang_accepted").select(*held.columns).withColumnsRenamed(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id.

    Rows with a null id or without a word stay; of rows that repeat both id and text one stays; very long texts are
    compared whole; an empty table stays empty; extra columns of any name stay.
    """
    heaps_back(spark)
    bounded(spark)
    return deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials masked in their texts.

    A null text stays null, a null source is one owner; repeated rows are masked alike; very long texts are scanned
    whole; an empty table stays empty; extra columns of any name stay.
    """
    heaps_back(spark)
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target shares, in a global random order.

    A null source is a source; rows without an id are drawn by their text; repeated rows are repeated alike; very long
    texts go with their rows; an empty table stays empty; extra columns of any name stay.
    """
    heaps_back(spark)
    held, back = set_aside(docs, ("copy", "shuffle_key"))
    return replicate(held, tempered_rates(held)).select(*held.columns).withColumnsRenamed(back)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the hash of the decoded text of each document.

    A null id stays null, a null or empty text has no ids; repeated rows stay; very long texts are encoded whole; an
    empty table gives none; extra columns, whatever their names, are left out.
    """
    heaps_back(spark)
    bounded(spark)
    return decode(encode(docs)).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe),
]

#: The stages learn a model, hash with 64-bit arithmetic and tokenize, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root, before = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    drop_at_exit(spark, root)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if before:
            drop(spark, before)
        before = f"{root}/{k}"
    return docs
