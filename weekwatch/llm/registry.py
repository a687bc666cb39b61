"""The registered queries over documents and embeddings, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weekwatch.llm import (
    alignment,
    conversations,
    exact_dedup,
    licenses,
    mixing,
    near_dedup,
    neighbours,
    oracle,
    packing,
    quality,
    secrets,
    sharding,
    toxicity,
    warc,
)
from weekwatch.llm.text import table
from weekwatch.sources.scratch import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _predicted(toxicity.score(docs, toxicity.fit(docs, labels)), toxicity.THRESHOLD)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _predicted(quality.score(docs, quality.fit(docs, labels)), quality.THRESHOLD)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id").withColumnRenamed("key", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"), words=3, num=9, den=10)
    return groups.select("doc_id", "n_shingles", "component_id", "n_links")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("sentence_ids", "licences")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_tokenizer(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(spark, path))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.report(conversations.repair(rows))


def queries() -> dict[str, Query]:
    every = [
        op1_toxicity, op2_sharding, op3_quality, op4_packing, op5_mixing, op6_secrets, op7_exact_dedup, op8_neighbours,
        op9_ngram_join, op10_licenses, op11_alignment, op12_warc, op13_conversation_repair,
    ]
    return {f.__name__: f for f in every} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    piped = corpus_pipeline.ORACLE_SQL
    return oracle.SQL | ({"pipeline": piped} if piped else {})
