"""Documents to packed training sequences.

1. ``language_id`` keeps documents with words of any learned languages.
2. ``line_dedup`` takes out lines that repeat an earlier line; every document stays.
3. ``simhash_near_dedup`` keeps one document of each group of near copies.
4. ``secret_scan`` replaces secrets in the texts; every document stays.
5. ``best_fit_packing`` lays the token pieces of all documents into sequences.

Every stage's result is written to the shared folder and read back as the next
one's documents, so a lost executor never repeats an earlier stage.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docintake.llm import language, line_dedup, packing, secrets, simhash
from docintake.llm.common import kept


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return language.with_language(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return simhash.without_near_copies(docs)


def scan_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return secrets.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return packing.best_fit_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", scan_secrets),
    ("best_fit_packing", pack),
]

#: SQL can't express the language model, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all documents that stay, with their places in the sequences."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
