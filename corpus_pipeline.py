"""Corpus pipeline: language ID, near duplicates, secrets, source mixing, BPE. Stages hand documents on as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import bpe, jaccard, langid, mixing, secret_scan
from corpusforge.llm.common import fresh, materialise


def _tagged(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells texts apart even where a doc_id is repeated, and its name."""
    name = fresh(docs, "row_key")
    return docs.withColumn(name, F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"))), name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents with a language, set each document's lang to the prediction, drop what calibrated rejection refuses."""
    m = langid.fit(docs, F.lit(True))
    names = [fresh(docs, n) for n in ("lang_pred", "lang_score", "lang_rejected")]
    out = langid.predict(docs, m, "text", *names).where(~F.col(names[2]))
    return out.withColumn("lang", F.col(names[0])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group (five-word shingles, similarity 0.8 or more); empty texts all stay."""
    tagged, key = _tagged(docs)
    groups = jaccard.near_duplicates(tagged.select(key, "text"), 5, 80, key, "text")
    keep = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias("k")).agg((F.max("n_shingles") > 0).alias("one"))
    met = tagged.join(keep, F.col(key).eqNullSafe(F.col("k")))
    # rows that are equal in id and text are one group: one of them stays
    return met.where("one").dropDuplicates([key]).unionByName(met.where("NOT one")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets, of fixed patterns and of inferred formats, by a mark; every document stays."""
    found = materialise(secret_scan.scan(docs.select("doc_id", "text")))
    return secret_scan.redact(docs, secret_scan.fit(found))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document as many times as the mix takes it (0 to 3)."""
    tagged, key = _tagged(docs)
    taken = mixing.mix(tagged.select(key, "text", "source"), (5, 2, 1), id_col=key)
    times = taken.groupBy(F.col(key).alias("k")).agg(F.sum("copies").cast("int").alias("times")).where(F.col("times") > 0)
    return tagged.dropDuplicates([key]).join(times, F.col(key).eqNullSafe(F.col("k"))).withColumn(fresh(tagged, "copy"), F.explode(F.sequence(F.lit(1), "times"))).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: models and token ids are beyond SQL; tests/llm hold the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
