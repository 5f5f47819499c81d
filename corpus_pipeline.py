"""From raw documents to packed training sequences: five stages, each one operator over all that the stage before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of `documents`. Rows with a null text pass the filters as empty texts do; rows without an id are
never duplicates; of rows with equal ids one stays. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gridlytics
from gridlytics.llm import decontam, minhash, packing, quality, secrets, storage
from gridlytics.llm.queries import TOKENIZERS, table

# Executors need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(gridlytics)

LEAST_QUALITY = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality")
    return quality.accept(docs, model, LEAST_QUALITY)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.without_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark; `n_chars` counts the new text."""
    clean = secrets.redact(docs, secrets.train(secrets.labelled_samples(docs)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces with their places in sequences of 2048."""
    return packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("quality_classifier", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", uncontaminated),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: No SQL says what the classifier, the tokenizer and the packing do; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
