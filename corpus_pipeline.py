"""Corpus pipeline over ``documents``: language, near-duplicates, contamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import decontam, langid, packing, pii, resemblance
from lamella.llm.graph import unused
from lamella.session import shared_folder

#: A document is rejected if it has no letter, or if its pooled language probability is less than this above chance
#: (one over the number of languages learned): 0.28 for four languages. Running text of one of them gives over 0.6.
ABOVE_CHANCE = 0.03


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those in which no known language prevails."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = langid.train(docs, learn)
    least = min(1.0, 1 / max(1, len(model.labels)) + ABOVE_CHANCE)
    mark = unused(docs.columns, "_language_", langid.COLUMNS)
    found = langid.labelled(docs, model, mark)
    return found.where((F.col(f"{mark}lang_pred") != "und") & (F.col(f"{mark}score") >= least)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 or more."""
    return resemblance.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with the benchmark."""
    return decontam.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows where it was given."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into training sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL can express neither the trained model nor XXH64 fingerprints; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every result but the last is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
