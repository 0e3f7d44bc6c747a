"""A training corpus from documents: five stages, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as
Parquet in the shared folder and rereads. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, minhash, packing, pii, toxicity
from quillspark.llm.common import Scratch, small_batches, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language of the corpus."""
    return langid.keep_known(docs, langid.learn(docs))


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    out = pii.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("toxicity", clean_language),
    ("minhash_near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

#: The language and toxicity stages are learned models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
