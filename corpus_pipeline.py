"""A corpus pipeline: documents that pass quality rules, once each, without benchmark text
and personal data, as token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns
a DataFrame that is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderframe.llm import bpe, decontaminate, pii, quality, simhash
from wanderframe.llm.common import work_dir
from wanderframe.llm.queries import WORD_BPE, pseudonym_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the likelihood ratio reject."""
    scored = quality.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: shingles of five words, alike by 0.8."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    flagged = decontaminate.flag_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return flagged.where("NOT contaminated").select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; ``n_chars`` follows the new text."""
    clean = pii.pseudonymize_documents(docs, pseudonym_key(spark), counts=None, spans=None)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of what they decode to."""
    out = bpe.encode_documents(docs, public_tokenizers.path(WORD_BPE))
    ids = F.array_join(F.transform("token_ids", lambda i: i.cast("string")), " ")
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("tokens", tokens)]

#: SQL cannot state SimHash components or BPE merges over whole tables; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        at = work_dir(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
