"""One query per operator over its whole table: thin, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from keyfold.llm import common, ctw, decontaminate, licenses, packing, quality, secrets, sharding, simhash, urls, warc
from keyfold.llm.oracle import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", n_items, F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated list for the hosts of pages and their parents: dates and lists follow from a hash of the name."""
    names = pages.select(F.explode(urls.suffixes(urls.host_of(F.col("url")))).alias("pattern")).distinct()
    names = names.withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")).where("h % 5 != 0")
    name = F.element_at(F.array(*(F.lit(x) for x in ("adult", "malware", "phishing", "spam"))), (F.col("h") % 4 + 1).cast("int"))
    start = F.lit(DAY_0) + F.col("h") % 200 * 86400
    steps = F.array(
        F.struct(start.alias("at"), F.lit("add").alias("op")),
        F.struct((start + (1 + F.col("h") % 60) * 86400).alias("at"), F.lit("remove").alias("op")),
        F.when(F.col("h") % 3 == 0, F.struct((start + (100 + F.col("h") % 50) * 86400).alias("at"), F.lit("add").alias("op"))),
    )
    return names.select(name.alias("list"), "pattern", F.explode(steps).alias("step")).select("list", "pattern", "step.at", "step.op")


#: 2024-01-01 in seconds; pages are taken as fetched on one of the 365 days from then.
DAY_0 = 1_704_067_200


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.lit(DAY_0) + F.col("page_id") * 7919 % 365 * 86400).alias("fetched"))
    found = urls.evaluate(captures, list_changes(pages))
    return found.select("page_id", "host", "fetched", F.array_join("lists", ",").alias("lists"), F.array_join("patterns", ",").alias("patterns"), "blocked")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), root)
    return warc.read_archives(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.repetition_coverage(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    said = F.transform("matches", lambda m: F.concat(m["template"], F.lit(":"), F.round(m["containment"], 4).cast("string")))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), F.size("matches").cast("long").alias("n_matches"), F.array_join(said, ",").alias("matches"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_context_tree": op2_context_tree,
    "op3_url_filter": op3_url_filter,
    "op4_secrets": op4_secrets,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "pipeline": corpus_pipeline.run,
}
