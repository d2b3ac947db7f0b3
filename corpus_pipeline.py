"""From raw documents to packed training sequences: named stages, each over all that its predecessor kept.

1. language_id: a document whose language cannot be told goes (no text, no letter, or a posterior below one half).
2. near_dedup: of each group of documents linked by SimHash codes and verified at a similarity of 0.8 on five-word shingles
   one row stays, that with the smallest id (null ids last).
3. secrets: spans found in the text or in its decoded layers are replaced by a mark.
4. source_mix: documents are dropped or repeated until each source meets its share.
5. packing: what is left is tokenised and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekspark.llm import language, mixing, packing, secrets, similar, simhash
from seekspark.llm.common import DOCUMENT_COLUMNS, read_table
from seekspark.session import written

COLUMNS = list(DOCUMENT_COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, COLUMNS, similar.SimilarConfig(), unnamed_apart=False, classes=similar.classes)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs, COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("secrets", mask_secrets), ("source_mix", mix_sources), ("packing", pack_sequences),
]
#: Fingerprints, models and tokens have no SQL form; tests/llm/test_pipeline.py runs the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
