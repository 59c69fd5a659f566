"""Registered queries of the operators: each applies its operator to the whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language, oracles, quality_model, quality_rules, toxicity
from .common import held_out, table, whole_text  # noqa: F401

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    return scored.selectExpr("doc_id", "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false) as held_out", "score",
                             "cast(score >= 0.5 as int) as predicted", "size(hits) as n_hits")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_model.score(docs, quality_model.fit(docs, labels), ["doc_id"])
    return scored.selectExpr("doc_id", "coalesce(crc32(cast(doc_id as string)) % 5 = 0, false) as held_out", "score",
                             "cast(score >= 0.3 as int) as predicted")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = language.identify(docs, language.fit(docs), ["doc_id"])
    return named.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import suffix_tree_scores

    return suffix_tree_scores(table(spark, sf_dir, "documents"))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .neighbours import nearest_rows

    return nearest_rows(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


#: Shares of the words of a mix that documents of these labels are to have.
TARGETS = {"good": 0.97, "poor": 0.02, "toxic": 0.01}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled documents: toxic, else by quality."""
    return labels.selectExpr("doc_id", "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN quality = 1 THEN 'good' END AS domain")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS, most=1.0)


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array import without_repeats

    cut = without_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import merkle

    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.verified(table(spark, sf_dir, "documents"), F.when(tampered, merkle.leaf_digest(text=merkle.tampered_text())))


ORACLES["op13_merkle_manifest"] = oracles.MERKLE


@query
def op12_block_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op12_block_repeats"] = oracles.BLOCK_REPEATS


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives

    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", relabelled), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = oracles.HARD_NEGATIVES
