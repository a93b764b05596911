"""Corpus pipeline: quality, rules, near duplicates, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. Stages work on whatever their predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoply.llm import decontamination, packing, quality, rules, similar, simhash
from chronoply.llm.common import fresh, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model doesn't score below 0.3.

    Null and empty texts are scored as empty ones. Repeated rows get one score each and go or
    stay together. Without labels every document has the same score, 0.5. An empty table stays so.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.score_column(F.col("text")) >= 0.3)  # Spark bounds an Arrow batch by its bytes


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base or further rule rejects; the cascade's order is measured.

    Null and empty texts have no words and go. Repeated rows go or stay together.
    """
    return rules.keep(docs, rules.plan(docs, rules.BASE + rules.RULES))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id (nulls last), of each group of near duplicates:
    five-word shingles, similarity 0.8 or more.

    Texts that are null or without words are one group, as are repeated rows; among rows of
    one id and text the one of the least hash of all columns stays.
    """
    return simhash.keep_one(docs, similar.one_of_each(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows over a twentieth or more of their words.

    Null and empty texts have no words and stay. Repeated rows go or stay together; rows of
    one id, or of none, are told apart by their texts. Without benchmark items all stay.
    """
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_hash=True)
    name, text = fresh(docs, "__gone"), fresh(docs, "__hash")
    gone = found.where("contaminated").select(F.col("doc_id").alias(name), F.col("text_hash").alias(text)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(text)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all that is left, packed into sequences of 1024.

    A null or empty text is one end id. Repeated rows are packed as often as they are there.
    """
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=100_000))


STAGES = [("quality", keep_quality), ("rules", keep_by_rules), ("near_duplicates", keep_one_of_each), ("decontamination", drop_contaminated), ("packing", pack)]

#: The model and the tokenizer can't be told in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
