"""The corpus pipeline: toxic documents go, then copies, then near copies; personal data is masked; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns the next stage's documents;
the last one returns the pieces of packed sequences. ``run`` writes the result
of every stage to the shared folder and reads it back. A stage begins by deleting
the scratch tables of the one before, so the disk holds those of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm import exact, neardup, packing, pii, toxicity
from tableflow.llm.common import cut, frees_scratch, gathered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL expresses the learned stages; tests compare them with brute force.
ORACLE_SQL = None


@frees_scratch
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models accept, row by row."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return gathered(toxicity.accepted(docs.select(*COLUMNS), labels, *toxicity.default_folds()))


@frees_scratch
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return gathered(exact.distinct(docs).select(*COLUMNS))


@frees_scratch
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return gathered(neardup.distinct(docs).select(*COLUMNS))


@frees_scratch
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and ``n_chars`` counted anew."""
    masked = gathered(pii.redact(docs.select(*COLUMNS), pii.fit(docs)))
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@frees_scratch
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens, with the mixture of sources of what is left."""
    return gathered(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, window=2048))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
