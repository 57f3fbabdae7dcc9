"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

1. Language: documents whose language isn't recognised go.
2. Near-duplicates (five words, a similarity of 0.8 or more): one document of each group stays.
3. Personal data: every span found is replaced by its kind; all documents stay.
4. Packing: pieces of token sequences of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import ecoc, packing, pii, setsketch
from quillspark.llm.common import stage, tuned


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the stage's own input; the rows it recognises."""
    tuned(spark)
    return ecoc.accepted(docs, ecoc.fit(ecoc.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return setsketch.deduplicated(docs, 80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Classifier, sketches and the linear program have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES):
            docs, _ = stage(docs, f"stage-{name}")
    return docs
