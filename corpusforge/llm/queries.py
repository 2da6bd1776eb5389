"""Thin queries of the operators over the driver's tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe, hmm, jaccard, langid, mih, mixing, nndescent, quality, secret_scan, suffix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold(10) == 0)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), (5, 2, 1)).drop("copies")


def op4_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 4, 85)


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(table(spark, sf_dir, "documents"), 400)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "embeddings").select("vec_id", mih.sign_code(F.col("embedding")).alias("code"))
    return mih.topk(coded, coded.where(F.col("vec_id") % 100 == 0), 10)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    m = quality.fit(docs, labels.where(fold(5) != 0))
    return quality.score(docs, m, 0.3).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    m = langid.fit(docs, fold(4) != 2)
    return langid.predict(docs.select("doc_id", "text"), m).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {
    "op1_hmm": op1_hmm,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_nndescent": op4_nndescent,
    "op5_jaccard": op5_jaccard,
    "op6_suffix": op6_suffix,
    "op7_topk": op7_topk,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
}

ORACLE_SQL: dict[str, str] = {
    "op7_topk": """
        WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
        d AS (
            SELECT query_id, vec_id,
                   CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.a[i] > 0) <> (e.embedding[i] > 0) AS INTEGER))) AS INTEGER) AS distance
            FROM q JOIN embeddings e ON e.vec_id <> q.query_id
        )
        SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank
        FROM d QUALIFY rank <= 10
    """,
}
