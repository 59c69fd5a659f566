"""The training-data pipeline: stages over ``documents``, each stored and read again by the next one.

Each stage but the first lets go of the tables that the stage before it has left: that one's result is stored by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import minhash, mixing, packing, quality_rules, suffix_array
from runlens.llm.common import table
from runlens.llm.queries import TARGETS, domains
from runlens.plans.scratch import delete, mark, release, scratch_path

#: Signatures, fitted models and token ids are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    mark(spark)
    return quality_rules.kept_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    release(spark, docs)
    return minhash.deduplicated(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice go from the texts; every document stays, with its new length."""
    release(spark, docs)
    return suffix_array.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Good documents stay; poor and toxic ones stay up to their part of the mix beside them."""
    release(spark, docs)
    return mixing.mixed_documents(docs, domains(table(spark, sf_dir, "labels")), TARGETS, most=1.0, whole="good")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of at most 2048 tokens, one row per piece."""
    import public_tokenizers

    release(spark, docs)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rules_stage),
    ("near-dedup", near_dedup_stage),
    ("suffix dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, [before])
        before = path
    release(spark, docs)
    return docs
