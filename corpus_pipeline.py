"""The training-data pipeline over ``documents``: five stages, each written and read again.

The toxicity lexicon is learned from the labelled rows of the stage's own input.
Every stage but the last returns the columns of ``documents``, whatever further ones there
are. In every stage a null text counts as an empty one and stays null, an empty table gives
an empty result, and rows that repeat id and text are one document to the near-duplicates,
and rows of their own to the other stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clarion.functions.lineage import free_name, remove, stored
from clarion.llm import decontaminate, packing, secrets, simhash, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; those without words have no matches and stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    score = free_name("_score", docs.columns)
    return toxicity.scores(docs, model, into=score).where(F.col(score) < 0.5).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays; texts without words are one class."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with the benchmark go; those without words stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific credentials are replaced in the text; every document stays."""
    return secrets.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in training sequences; a document without a text is its end token."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The first stage is a learned classifier and the last a packing: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each result but the last is written to the shared folder, and goes once the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[str] = []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, written)
            if len(written) > 1:
                remove(spark, written.pop(0))
    return docs
