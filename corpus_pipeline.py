"""From raw documents to packed training sequences, in five stages.

Each stage gets what its predecessor kept, reread from Parquet:

1. quality: documents that fail the quality rules go;
2. near_dedup: of each group of near copies (five-word shingles, similarity of 0.8 or
   more, found by SimHash) the row with the smallest doc_id stays;
3. decontamination: documents that share a span of ten words with `benchmark` (or a
   whole shorter item) go;
4. secrets: found spans are replaced by [SECRET], and n_chars follows;
5. packing: whole texts are tokenised and packed; a row per piece.

SQL expresses none but the first and third, so there is no SQL for the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import common, decontaminate, packing, quality, secrets, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", redact_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs
