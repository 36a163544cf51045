"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next one's documents.  All but the last keep the
columns of documents.

1. toxicity       documents that the grammar scores 0.5 or more go
2. exact_dedup    of equal texts the largest id stays
3. near_dedup     of documents linked by 5-word shingles (0.75 and more) the smallest id stays
4. personal_data  personal data and terms that reveal it are replaced in the text
5. packing        pieces of at most 1024 tokens in as few sequences as possible
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerhawk.llm import content_sort, parity_join, sanitise, slack_packing, toxic_grammar
from ledgerhawk.llm.common import documents, stored, table

#: The rows of run() have no SQL form; tests compare it with a plain version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_grammar.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.deduplicate(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = sanitise.sanitise(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return slack_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("personal_data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
