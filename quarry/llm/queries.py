"""The operators as queries over the test tables: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, jaccard, language, licenses, media, packing, secrets, tokens, toxicity, wordbpe
from quarry.llm.common import fold_of, read_table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file: in QUARRY_TOKENIZERS, or of the installed package."""
    folder = os.environ.get("QUARRY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(documents(spark, sf_dir))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary(), end_id=1, capacity=4096)


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score(documents(spark, sf_dir), toxicity_model(spark, sf_dir))
    return scores.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encode_digests(documents(spark, sf_dir), vocabulary())


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.id_file_digests(documents(spark, sf_dir), vocabulary(), end_id=2)


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), jaccard.Similarity(k=3, num=90)).drop("group")


def language_model(spark: SparkSession, sf_dir: str) -> language.LanguageModel:
    return language.fit(documents(spark, sf_dir), fold_of(F.col("doc_id"), 3) != 1)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(documents(spark, sf_dir), language_model(spark, sf_dir))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_media_columns": media_columns,
    "op2_best_fit_packing": best_fit_packing,
    "op3_toxicity": toxicity_scores,
    "op4_license_scan": license_scan,
    "op5_secret_scan": secret_scan,
    "op6_bpe": bpe_digests,
    "op7_token_files": token_files,
    "op8_nearest_vectors": nearest_vectors,
    "op9_ngram_join": ngram_join,
    "op10_language_id": language_id,
    "pipeline": pipeline,
}

#: None of the methods can be written in SQL; tests hold the queries against brute force, round trips and held-out labels.
ORACLE_SQL: dict[str, str] = {}
