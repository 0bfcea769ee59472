"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's input.

1. ``language_id``: documents without a language (no text or no letters) go.
2. ``simhash_near_dedup``: one document of each near-duplicate group stays.
3. ``benchmark_decontamination``: contaminated documents go.
4. ``pii``: entities in the texts get surrogates.
5. ``mixing``: sources are mixed to their target weights; adds the column ``copies``.

All stages but the last return the columns of documents. SQL can express neither the language
model nor SimHash, so ORACLE_SQL is None and tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from costsieve.llm import decontaminate, langid, mixing, pii, simhash
from costsieve.llm.common import crc_mod, read_table, temporary_tables
from costsieve.llm.queries import SURROGATE_KEY
from costsieve.session import materialise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(langid.training_sample(docs, crc_mod("doc_id", 3) != 1))
    return langid.keep_identified(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_entities(docs, SURROGATE_KEY)[0].select(*docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii_surrogates),
    ("mixing", mixing_to_targets),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the mix is the last one's result."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary_tables(spark):
            docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
