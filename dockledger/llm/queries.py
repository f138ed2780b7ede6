"""The text operators as named queries over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockledger.llm import (
    backoff,
    conversation_repair,
    decontaminate,
    language_mixture,
    line_templates,
    lookup_clusters,
    mixing,
    quality_model,
    repeats,
    repetition,
    simhash,
    token_machine,
    warc,
)
from dockledger.llm.common import documents, scratch


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir), weights=(1.0, 2.0, 3.0), most=3.0, carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality_model.fit(quality_model.labelled_sample(docs, labels))
    return quality_model.score(docs, weights, threshold=0.3)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(documents(spark, sf_dir), items, ["doc_id"])


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, lines, dropped = line_templates.drop_templates(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col(lines).alias("n_lines"), F.col(dropped).alias("n_dropped"), F.md5("text").alias("kept_md5"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, like = language_mixture.fit(language_mixture.training_rows(docs))
    return language_mixture.identify(docs, langs, like)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), ["doc_id"], length=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(documents(spark, sf_dir), keep=["doc_id"])


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.dedup_repeats(documents(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/archive-{uuid.uuid4().hex}"
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.resolved(warc.transactions(warc.read_archive(spark, path)))


def op10_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score(documents(spark, sf_dir), ["doc_id"])
    rounded = [F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")]
    return scored.select("doc_id", "n_words", *rounded)


CLUSTERS = {"k": 40, "rounds": 5, "dims": 64, "scale": 256, "salt": "2:"}


def op11_lookup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup_clusters.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", **CLUSTERS)
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    counted = token_machine.token_counts(documents(spark, sf_dir), ["doc_id"], "text", path)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.repair(rows, lambda text: F.sha2(text, 256)).withColumnRenamed("repaired", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_entropy_mix": op1_entropy_mix,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_line_templates": op4_line_templates,
    "op5_language_mixture": op5_language_mixture,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_repeats": op8_repeats,
    "op9_warc": op9_warc,
    "op10_backoff": op10_backoff,
    "op11_lookup_clusters": op11_lookup_clusters,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op4_line_templates": line_templates.ORACLE_SQL,
    "op7_quality_rules": repetition.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_backoff": backoff.oracle_sql(),
    "op11_lookup_clusters": lookup_clusters.oracle_sql(**CLUSTERS),
    "op13_conversation_repair": conversation_repair.ORACLE_SQL,
}
