"""A corpus pipeline over ``documents``: five stages, each one operator of
``strike_analytics.llm`` applied to all that its predecessor kept.

1. Language identification: texts in no learned language, or hardly in any, go.
2. SimHash near-duplicates: one document of each group stays.
3. Benchmark decontamination: documents with a benchmark window go.
4. Secret scan: every secret in a text is replaced by a mark; documents stay.
5. Byte-level BPE: token ids and the digests of ids and decoded text.

Each stage's result is written as Parquet to the shared folder and read again
as the next one's documents, so a lost executor costs one stage's work at
most. Stages 1 to 4 return the columns they got.

Defined results: see each operator; an empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strike_analytics.llm import bpe, decontam, langid, secret_scan, simhash
from strike_analytics.llm.common import read_table
from strike_analytics.session import fresh_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: The first and the last stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, f"pipeline-{name}")
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
